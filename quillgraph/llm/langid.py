"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A model reads the words of a text (runs of letters, in lower case, composed), each with a begin and an end mark, and
gives every letter and end mark a probability from the letters before it in the word.  Per order there is
one sorted array of 64-bit n-gram hashes with a row of discounted probabilities, and one of context hashes
with a row of interpolation weights; a row has one entry for each language.  The language with the lowest
cross-entropy per character wins, ties to the alphabetically first.

A text without any letter (null and empty ones too) is `und` with score 0 and is rejected.  Others get a
learned language, and `rejected` if their cross-entropy lies beyond what calibration documents of that
language show for their length.  If nothing can be learned (an empty table, no labels) all are `und`.
Repeated rows get equal results; only doc_id, text and lang are read.
"""

from __future__ import annotations

import pickle
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import U64, held, mix, pieces, table, unused

ORDER = 5
#: The sample that a model is fitted on, which bounds what reaches the driver: so many documents of each language, of so many bytes
#: at most and about so many bytes together.  With more than LANGUAGES languages each has a smaller share, but FEW documents at least.
SAMPLE_DOCS, SAMPLE_BYTES, LANGUAGE_BYTES, LANGUAGES, FEW = 300, 64 << 10, 4 << 20, 128, 8
BEGIN, END = 1, 2
_WORDS = regex.compile(r"\p{L}+")


def letters(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORDS.findall((text if text.isascii() else normalize("NFC", text)).lower())


def _grams(words: list[str], order: int):
    """Positions to predict: n-gram hashes of each order, which orders reach, and each position's word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join([f"\x01{w}\x02" for w in words]).encode("utf-32-le"), "<u4").astype(U64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - begins[owner]
    hashes = [np.zeros(len(flat), U64)]
    for n in range(1, order + 1):
        back = np.zeros(len(flat), U64)
        back[n - 1 :] = flat[: len(flat) - n + 1]
        hashes.append(mix(hashes[-1] * U64(0x9FB21C651E98DF25) + back + U64(n)))
    return hashes, at, owner


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default, np.float32)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[i]
    out[keys[i] != wanted] = default
    return out


class KneserNey:
    """languages; per order (n-gram keys, probabilities, context keys, weights); calibration by language."""

    def __init__(self, words_of: dict[str, dict[str, int]], order: int = ORDER):
        self.languages = sorted(words_of)
        self.order = order
        fitted = [self._fit(words_of[x]) for x in self.languages]
        self.symbols = 1 + len({c for counts in words_of.values() for w in counts for c in w})
        self.tables = []
        for n in range(order if fitted else 0):
            out = []
            for part, default in ((0, 0.0), (2, 1.0)):
                keys = np.unique(np.concatenate([f[n][part] for f in fitted]))
                values = np.full((len(keys), len(fitted)), default, np.float32)
                for k, f in enumerate(fitted):
                    values[np.searchsorted(keys, f[n][part]), k] = f[n][part + 1]
                out += [keys, values]
            self.tables.append(out)
        self.limits = np.tile([np.inf, 0.0, 0.0], (len(fitted), 1))

    def _fit(self, counts: dict[str, int]) -> list:
        words = list(counts)
        weight = np.array([counts[w] for w in words], np.float64)
        hashes, at, owner = _grams(words, self.order)
        out = []
        for n in range(1, self.order + 1):
            reach = (at >= n - 1) & (at >= 1)
            grams, first, which = np.unique(hashes[n][reach], return_index=True, return_inverse=True)
            place = np.flatnonzero(reach)[first]
            raw = np.bincount(which, weights=weight[owner[reach]])
            if n < self.order:
                longer = np.unique(hashes[n + 1][reach & (at >= n)], return_index=True)[1]
                left = hashes[n][np.flatnonzero(reach & (at >= n))[longer]]
                known = np.bincount(np.searchsorted(grams, left), minlength=len(grams)).astype(float)
                raw = np.where(at[place] == n - 1, raw, known)
            ones, twos = (raw == 1).sum(), (raw == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = hashes[n - 1][place - 1] if n > 1 else np.zeros(len(place), U64)
            contexts, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, weights=raw)
            taken = np.bincount(back, weights=np.minimum(raw, discount))
            out.append((grams, np.maximum(raw - discount, 0) / total[back], contexts, taken / total))
        return out

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the sum of -log2 probabilities in each language, and how many characters they are."""
        hashes, at, owner = _grams(words, self.order)
        use = at >= 1
        p = np.full((int(use.sum()), len(self.languages)), 1.0 / self.symbols, np.float32)
        where = np.flatnonzero(use)
        for n, (keys, probability, contexts, weights) in enumerate(self.tables, 1):
            reach = at[where] >= n - 1
            spots = where[reach]
            context = hashes[n - 1][spots - 1] if n > 1 else np.zeros(len(spots), U64)
            p[reach] = _lookup(keys, probability, hashes[n][spots], 0.0) + _lookup(contexts, weights, context, 1.0) * p[reach]
        cost = -np.log2(np.maximum(p, 1e-12))
        sizes = np.bincount(owner[use], minlength=len(words))
        return np.add.reduceat(cost, np.cumsum(sizes) - sizes, axis=0), sizes

    def calibrate(self, texts: list[tuple[str, list[str]]]) -> None:
        """Limits from labelled documents: mean and spread of cross-entropy, and its spread within words."""
        for k, language in enumerate(self.languages):
            entropy, noise = [], []
            for name, words in texts:
                if name == language and words:
                    cost, n = self.bits(words)
                    entropy.append(cost[:, k].sum() / n.sum())
                    noise.append((cost[:, k] - n * entropy[-1]).var() / n.mean())
            if len(entropy) >= 5:
                self.limits[k] = np.mean(entropy), 6 * np.std(entropy) + 0.25, 6 * np.sqrt(np.mean(noise))


class Scorer:
    """Scores whole texts, each distinct white-space-free chunk once; remembers up to `keep` of them."""

    def __init__(self, model: KneserNey, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def chunk_rows(self, names: list[str]) -> np.ndarray:
        """Bits by language and characters of each chunk."""
        known = self.known
        fresh = [x for x in names if x not in known]
        if fresh:
            if len(known) + len(fresh) > self.keep:
                known = self.known = {}
                self.rows, fresh = self.rows[:0], names
            words = [letters(x) for x in fresh]
            flat = [w for x in words for w in x]
            owner = np.repeat(np.arange(len(fresh)), [len(x) for x in words])
            new = np.zeros((len(fresh), self.rows.shape[1]))
            for a in range(0, len(flat), 30_000):
                cost, n = self.model.bits(flat[a : a + 30_000])
                for k in range(cost.shape[1]):
                    new[:, k] += np.bincount(owner[a : a + 30_000], weights=cost[:, k], minlength=len(fresh))
                new[:, -1] += np.bincount(owner[a : a + 30_000], weights=n, minlength=len(fresh))
            known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, new])
        return self.rows[[known[x] for x in names]] if names else self.rows[:0]

    def texts(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        words = pc.list_flatten(lists).dictionary_encode()
        rows = self.chunk_rows(words.dictionary.to_pylist())
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        sums = np.zeros((len(column), rows.shape[1]))
        some = np.flatnonzero(np.diff(bounds))
        codes = words.indices.to_numpy(zero_copy_only=False)
        for k in range(rows.shape[1]):
            sums[some, k] = np.add.reduceat(rows[codes, k], bounds[some]) if len(some) else 0
        n = sums[:, -1]
        entropy = sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1) if entropy.shape[1] else np.zeros(len(n), int)
        low = entropy[np.arange(len(n)), best] if entropy.shape[1] else np.zeros(len(n))
        score = 1 / np.exp2(np.maximum((low[:, None] - entropy) * 8, -1000)).sum(1) if entropy.shape[1] else np.zeros(len(n))
        none = (n == 0) | (entropy.shape[1] == 0)
        mean, wide, noise = self.model.limits[best].T if entropy.shape[1] else np.zeros((3, len(n)))
        rejected = none | (low > mean + wide + noise / np.sqrt(np.maximum(n, 1)))
        names = ["und" if x else self.model.languages[b] for x, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), rejected


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) to fit on, of (doc_id, text, lang): of each language, the documents of the least hashes of (doc_id, text).

    Up to SAMPLE_DOCS a language while there are at most LANGUAGES of them, else a like share, but always FEW; none over
    SAMPLE_BYTES; beyond FEW only while they hold LANGUAGE_BYTES together.  Rows that repeat both doc_id and text count once.
    """
    learn = docs.where("lang is not null and crc32(doc_id) % 5 <> 0").where(F.octet_length("text") <= SAMPLE_BYTES)
    learn = learn.select("lang", "text", F.xxhash64("doc_id", F.md5("text")).alias("key"))
    # Ranked without the texts; a task sends on no more than SAMPLE_DOCS of a language.
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("key"))
    ranked = learn.select("lang", "key", F.octet_length("text").alias("size")).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    held_ = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    some = ranked.groupBy("lang", "key", "rank").agg(F.max("size").alias("size")).withColumn("before", F.coalesce(held_, F.lit(0)))
    rows = some.where((F.col("rank") <= FEW) | (F.col("before") < LANGUAGE_BYTES)).groupBy("lang").agg(F.array_sort(F.collect_list("key")).alias("keys")).collect()
    most = SAMPLE_DOCS if len(rows) <= LANGUAGES else max(FEW, SAMPLE_DOCS * LANGUAGES // len(rows))
    limits = docs.sparkSession.createDataFrame([(r["lang"], r["keys"][:most][-1]) for r in rows], "lang string, last long")
    # A row of some bytes for each language; without it all texts of a language would meet in one task.
    limits = F.broadcast(limits) if len(rows) <= 100_000 else limits
    return learn.join(limits, "lang").where("key <= last").dropDuplicates(["lang", "key"]).orderBy("key", "lang").select("lang", "text")


def fit(docs: DataFrame) -> KneserNey:
    """A model from (doc_id, text, lang): documents whose crc32(doc_id as text) mod 5 is not 0, sampled as in sample().

    A fifth of the sample calibrates.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = sample(docs).collect()
    words_of: dict[str, dict[str, int]] = {}
    checks = []
    for i, row in enumerate(rows):
        words = letters(row["text"])
        if i % 5 == 0:
            checks.append((row["lang"], words))
        else:
            own = words_of.setdefault(row["lang"], {})
            for w in words:
                own[w] = own.get(w, 0) + 1
    model = KneserNey({k: v for k, v in words_of.items() if v})
    model.calibrate(checks)
    return model


def _predictions(docs: DataFrame, model: KneserNey, kept: list[str], text: str, found: tuple[str, str, str]) -> DataFrame:
    """The kept columns of docs, and of its column `text` lang_pred, score and rejected under the names found."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own = held(("language", hash(packed.value)), lambda: Scorer(pickle.loads(packed.value)))
        for whole in batches:
            for b in pieces(whole, text, 4 << 20):
                names, score, rejected = own.texts(b[text])
                yield pa.record_batch([*(b[c] for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*kept, *found])

    fields = [*(f for f in docs.schema if f.name in kept), *(T.StructField(c, t) for c, t in zip(found, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))]
    return docs.mapInArrow(run, T.StructType(fields))


def predict(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _predictions(docs, model, ["doc_id", "held_out"], "text", ("lang_pred", "score", "rejected"))


def keep_known(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows of docs that the model does not reject, with docs' own columns, whatever their names."""
    names = docs.columns
    text, *found = (unused(c, names) for c in ("_text", "_lang", "_score", "_rejected"))
    marked = _predictions(docs.withColumn(text, F.col("text").cast("string")), model, names, text, tuple(found))
    return marked.where(~F.col(found[-1])).select(*[F.col(f"`{c}`") for c in names])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
