"""Ranked lexical search over document shards: CSR postings with integer impacts, one term at a time.

Each task cuts its documents into shards of about SHARD_BYTES of text and SHARD_DOCS documents at most.  A shard holds its
terms, where each one's postings begin, and for each posting the document's place and its impact,
`(1000000000 * tf) div (1000 * tf + 8 * m)`, which needs the corpus's N and L and the document's length alone, so that it
is computed when the shard is written.  A term's weight needs its document frequency: the lengths of its postings in all
shards, summed for the terms of the queries only.

Queries come in blocks of BLOCK_ITEMS at most.  For each item, a dense accumulator with one 64-bit cell for each document of
the shard takes each term's postings in turn, times the weight; argpartition finds the k-th score, and all documents that
reach it stay until ties are decided by doc_id.  A task merges what its shards found for a block, and Spark merges the tasks.

A term is a maximal match of TERM in the whole text, A-Z lowered.  Rows of documents without a doc_id and items without an
item_id take no part.  Null and empty texts have no term, count for nothing and find nothing.  Rows that repeat a doc_id are
documents of their own, rows that repeat an item_id queries of their own; ties go to the smaller doc_id.  Terms that nearly all
documents hold may weigh 0; documents with a score of 0 are not found.  Empty tables give no rows.  Columns but the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import from_bytes, materialize, meet, numbered, release, remove, scratch_dir, table, text_buffers, to_bytes

#: Fixed value: what a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, SHARD_DOCS, BLOCK_ITEMS, BLOCK_BYTES, HELD = 16 << 20, 1 << 16, 4096, 1 << 20, 1 << 18

_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all terms, their lengths, the number of each text's first term as len+1 offsets) of texts in UTF-8."""
    # A blank after each text keeps terms apart.
    raw = np.insert(raw, offsets[1:], 32)
    inside = _IN_TERM[raw]
    edges = np.diff(np.concatenate([[False], inside]).astype(np.int8), append=0)
    starts, ends = np.flatnonzero(edges[: len(raw)] == 1), np.flatnonzero(edges[: len(raw)] == -1)
    return _LOWER[raw[inside]], ends - starts, np.searchsorted(starts, offsets + np.arange(len(offsets)))


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _numbers(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the strings that follow one another in raw, and the strings by number."""
    found = _strings(raw, np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _packed(strings: pa.Array) -> bytes:
    raw, at = text_buffers(strings) if pa.types.is_string(strings.type) else _buffers(strings)
    return to_bytes(raw=raw, at=at.astype(np.int64))


def _buffers(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    _, off, data = strings.buffers()
    at = np.frombuffer(off, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _unpacked(data: bytes) -> pa.LargeBinaryArray:
    held_ = from_bytes(data)
    return _strings(held_["raw"], held_["at"])


def slack(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """8 * m for documents of n terms each, in whole numbers of any size on the way."""
    distinct, place = np.unique(n, return_inverse=True)
    return np.array([8 * (100 - 90 + (90 * int(x) * docs) // total) for x in distinct.tolist()], np.int64)[place]


def weight(docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency + 1)))


class Shard:
    """Postings of some documents: terms (by number), at (where each one's begin), docs (places) and impacts."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        self.ids, self.at, self.docs, self.impacts = ids, at, docs, impacts

    @staticmethod
    def built(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray, docs: int, total: int) -> tuple[pa.Array, Shard]:
        """(terms, shard) of texts, for a corpus of so many documents and terms."""
        letters, lengths, first = terms_of(raw, offsets)
        numbers, terms = _numbers(letters, lengths)
        n = np.diff(first)
        size = max(1, len(ids))
        key, tf = np.unique(numbers * size + np.repeat(np.arange(len(ids)), n), return_counts=True)
        term, doc = np.divmod(key, size)
        impacts = (1_000_000_000 * tf) // (1000 * tf + slack(n, docs, total)[doc]) if len(doc) else doc
        at = np.searchsorted(term, np.arange(len(terms) + 1))
        return terms, Shard(ids, at.astype(np.int32), doc.astype(np.uint16), impacts.astype(np.int32))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each document's score for terms (numbers here) with weights: one term after another into a dense accumulator."""
        total = np.zeros(len(self.ids), np.int64)
        for a, z, w in zip(self.at[terms].tolist(), self.at[terms + 1].tolist(), weights.tolist(), strict=True):
            total[self.docs[a:z]] += w * self.impacts[a:z].astype(np.int64)
        return total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best with a score above 0 by score, ties to the smaller id; none that ties with the k-th is lost before that."""
    least = 1
    if len(scores) > k:
        least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    some = np.flatnonzero(scores >= least)
    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
    return ids[some], scores[some]


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(N, L): documents (doc_id, text) with a term, and all their terms."""

    def run(batches):
        release()
        n = total = 0
        for b in batches:
            found = np.diff(terms_of(*text_buffers(b["text"]))[2])
            n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.record_batch([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def shards(docs: DataFrame, n: int, total: int) -> DataFrame:
    """(shard, terms, postings) of documents (doc_id, text); documents without a term are left out."""

    def run(batches):
        from pyspark import TaskContext

        release()
        number, held_, size, rows = TaskContext.get().partitionId() << 24, [], 0, 0

        def made():
            part = pa.Table.from_batches(held_).combine_chunks()
            raw, offsets = text_buffers(part["text"].chunk(0))
            terms, own = Shard.built(part["doc_id"].to_numpy(), raw, offsets, n, total)
            data = to_bytes(ids=own.ids, at=own.at, docs=own.docs, impacts=own.impacts)
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([_packed(terms)], pa.binary()), pa.array([to_bytes(at=own.at)], pa.binary()), pa.array([data], pa.binary())], ["shard", "terms", "lengths", "postings"])

        for b in batches:
            sizes = np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(sizes):
                base = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + SHARD_BYTES - size, "right")))
                stop = min(stop, start + SHARD_DOCS - rows)
                held_.append(b.slice(start, stop - start))
                size, rows = size + int(sizes[stop - 1]) - base, rows + stop - start
                start = stop
                if size >= SHARD_BYTES or rows >= SHARD_DOCS or start < len(sizes):
                    yield made()
                    number, held_, size, rows = number + 1, [], 0, 0
        if held_:
            yield made()

    return docs.mapInArrow(run, "shard long, terms binary, lengths binary, postings binary")


def blocks(items: DataFrame) -> DataFrame:
    """(block, terms, asks) of items (item_id, text): the block's distinct terms, and each item's, as numbers of those."""

    def run(batches):
        from pyspark import TaskContext

        release()
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(sizes):
                base = int(sizes[start - 1]) if start else 0
                stop = min(max(start + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, "right"))), start + BLOCK_ITEMS)
                part = b.slice(start, stop - start)
                letters, lengths, first = terms_of(*text_buffers(part["text"]))
                numbers, terms = _numbers(letters, lengths)
                size = max(1, len(terms))
                item, term = np.divmod(np.unique(np.repeat(np.arange(len(part)), np.diff(first)) * size + numbers), size)
                asks = to_bytes(ids=part["item_id"].to_numpy(), first=np.searchsorted(item, np.arange(len(part) + 1)), terms=term)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([_packed(terms)], pa.binary()), pa.array([asks], pa.binary())], ["block", "wanted", "asks"])
                number, start = number + 1, stop

    return items.mapInArrow(run, "block long, wanted binary, asks binary")


def _found(terms: bytes, wanted: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of wanted terms that a shard has, their numbers there)."""
    here = pc.index_in(_unpacked(wanted), value_set=_unpacked(terms))
    place = here.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    slots = np.flatnonzero(place >= 0)
    return slots, place[slots]


def frequencies(pairs: DataFrame) -> DataFrame:
    """(block, dfs): the document frequencies of a block's terms, by (block, wanted) met with (shard, terms, lengths)."""

    def run(batches):
        release()
        totals: dict[int, np.ndarray] = {}
        cells = lambda: pa.record_batch([pa.array(np.repeat(list(totals), [len(v) for v in totals.values()]).astype(np.int64)), pa.array(np.concatenate([np.arange(len(v)) for v in totals.values()])), pa.array(np.concatenate(list(totals.values())))], ["block", "slot", "df"])
        for b in batches:
            for row in b.to_pylist():
                slots, place = _found(row["terms"], row["wanted"])
                at = from_bytes(row["lengths"])["at"].astype(np.int64)
                own = totals.setdefault(row["block"], np.zeros(len(_unpacked(row["wanted"])), np.int64))
                own[slots] += at[place + 1] - at[place]
                if sum(map(len, totals.values())) > HELD:
                    yield cells()
                    totals.clear()
        if totals:
            yield cells()

    each = pairs.select("block", "terms", "lengths", "wanted").mapInArrow(run, "block long, slot long, df long")
    # One block's terms come from BLOCK_BYTES of text, or from one item.
    summed = each.groupBy("block", "slot").agg(F.sum("df").alias("df"))
    return summed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "df"))), lambda x: x["df"]).alias("dfs"))


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    items = items.where("item_id is not null").selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
    none = "item_id long, rank int, doc_id long, score long"
    n, total = corpus_size(docs)
    if not n:
        return spark.createDataFrame([], none)
    path = scratch_dir(spark)
    index, n_shards = numbered(materialize(shards(docs, n, total), f"{path}/index"), "shard")
    asked, n_blocks = numbered(materialize(blocks(items), f"{path}/blocks"), "block")
    if not n_blocks:
        remove(spark, path)
        return spark.createDataFrame([], none)
    dfs = materialize(frequencies(meet(index.drop("postings"), asked.drop("asks"), n_shards, n_blocks)), f"{path}/dfs")

    def weigh(batches):
        for b in batches:
            data = [to_bytes(w=np.array([weight(n, df) if df else 0 for df in x], np.int64)) for x in b["dfs"].to_pylist()]
            yield pa.record_batch([b["block"], pa.array(data, pa.binary())], ["block", "weights"])

    ready = asked.join(dfs.mapInArrow(weigh, "block long, weights binary"), "block")

    def run(batches):
        release()
        kept: dict[tuple[int, int], tuple] = {}

        def cells():
            sizes = [len(x[1]) for x in kept.values()]
            join = lambda i: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in kept.values())])
            each = lambda values: pa.array(np.repeat(np.array(values, np.int64), sizes))
            return pa.record_batch([each([b for b, _ in kept]), each([i for _, i in kept]), each([x[0] for x in kept.values()]), pa.array(join(1)), pa.array(join(2))], ["block", "place", "item_id", "doc_id", "score"])

        for b in batches:
            for row in b.to_pylist():
                slots, place = _found(row["terms"], row["wanted"])
                shard, asks, weights = Shard(**from_bytes(row["postings"])), from_bytes(row["asks"]), from_bytes(row["weights"])["w"]
                here = np.full(len(weights), -1, np.int64)
                here[slots] = place
                for i, item in enumerate(asks["ids"].tolist()):
                    terms = asks["terms"][asks["first"][i] : asks["first"][i + 1]]
                    terms = terms[(here[terms] >= 0) & (weights[terms] > 0)]
                    if not len(terms):
                        continue
                    ids, scores = best(shard.ids, shard.scores(here[terms], weights[terms]), k)
                    if (old := kept.get((row["block"], i))) is not None:
                        ids, scores = best(np.concatenate([old[1], ids]), np.concatenate([old[2], scores]), k)
                    kept[row["block"], i] = (item, ids, scores)
            if len(kept) * k > HELD:
                yield cells()
                kept.clear()
        if kept:
            yield cells()

    found = meet(index.drop("lengths"), ready, n_shards, n_blocks).mapInArrow(run, "block long, place long, item_id long, doc_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.select("item_id", "rank", "doc_id", "score"), f"{path}/out")
    for name in ("index", "blocks", "dfs"):
        remove(spark, f"{path}/{name}")
    return out


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
size AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, size GROUP BY term, n),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(terms) * n) // total) AS m FROM d, size WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS k, item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
s AS (
  SELECT k, item_id, m.r, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m ON m.r = t.r GROUP BY ALL),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
