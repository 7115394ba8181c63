"""Secret scans: base patterns, and strings in sensitive context that a primed compressor finds novel.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped: assign (a name such as
password, then : or =, then a value of 6 characters or more), access (AKIA, 20 characters or more) and
hex (24 characters or more).  Beyond these, a run of 16 or more key characters with a letter and a digit
that lies at most NEAR characters after or before a sensitive word (or is joined by dots to such a run, as the parts
of a JWT are) and outside all base spans is a candidate.

Every base span's secret and every candidate is measured: a zstandard compressor primed with a dictionary
compresses the surrounding text with and without it, and the difference in bytes is what it adds.  Other copies of
it are blanked first.  The dictionary holds common words of code and the corpus's own identifiers, counted over
all documents (`identifiers`: the DICTIONARY_WORDS most frequent, so its size is bounded).  A candidate that adds
NOVEL bytes a character or more (less for long ones: `needed_bytes`) is reported as kind novel; identifiers and
words that the surroundings repeat cost little.  Base spans are reported whatever they add; `scan` shows the bytes of all.

Null and empty texts have no spans (counts 0, digest of the empty string, spans and added empty).  Equal texts give
equal results, repeated rows are repeated, an empty table gives no rows.  `scan` reads only doc_id and text;
`redact` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import held, pieces, table

#: The base kinds in their order.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"(?ai:passw|pwd|secret|token|api|key|auth|bearer|credential|private|signature)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINED = re.compile(r"\.[A-Za-z0-9+/_=-]+")
#: What can hold any span at all, for a first look at whole texts.
ANY = r"(?i:passw|pwd|secret|token|api|key|auth|bearer|credential|private|signature)|AKIA|[0-9a-f]{24}"
#: Bytes a character from which a candidate counts as novel; characters of text on each side; how near the sensitive word is.
NOVEL, AROUND, NEAR = 0.8, 256, 40
#: Characters up to which that holds; the share of an alphabet's entropy that very long candidates need.
SHORT, RANDOM = 64, 0.97
#: Words of code that any corpus may hold.
COMMON = (
    "import from return def function class const let var public private static void string int float bool true false null "
    "None self this new try except catch finally raise throw if else elif for while break continue yield async await lambda "
    "config settings environment production development localhost http https www com org net json yaml xml html utf-8 "
    "username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret "
    "authorization bearer basic credential credentials signature session cookie header request response database connection "
    "host port user admin root test example sample value index length count total name type key id data result error message"
)
#: Identifiers in the dictionary, and how long one may be; longer or mixed ones could be keys themselves.
DICTIONARY_WORDS, LONGEST = 2048, 32
#: Names in snake or camel case, and words before an assignment or a call.
IDENTIFIER = r"""\b(?:[A-Za-z]++(?:_[A-Za-z]++)++|[a-z]++(?:[A-Z][a-z]++)++|[A-Za-z]{3,}+(?=["']?\x20*+(?:=|\()))\b"""


def identifiers(docs: DataFrame) -> str:
    """The corpus's most frequent identifiers (by documents, ties by name), the most frequent last, in one text.

    Letters and underscores alone, so that no key becomes known.  Counted over all documents with partial sums on
    the map side; DICTIONARY_WORDS names come to the driver.
    """
    names = F.array_distinct(F.filter(F.regexp_extract_all(F.col("text").cast("string"), F.lit(IDENTIFIER), F.lit(0)), lambda x: F.length(x) <= LONGEST))
    top = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(DICTIONARY_WORDS)
    return " ".join([r["name"] for r in top.collect()][::-1])


class Novelty:
    """A compressor primed with COMMON and a corpus's identifiers."""

    def __init__(self, names: str = ""):
        words = zstandard.ZstdCompressionDict(f"{names} {COMMON}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=3)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False)

    def marginal_bytes(self, text: str, start: int, end: int, first: int | None = None, last: int | None = None) -> int:
        """Compressed bytes that text[start:end] adds to what surrounds it, or surrounds the runs text[first:last] it is one of.

        Its other copies there are blanked, also where the edge of the surroundings cuts them.
        """
        first, last = start if first is None else first, end if last is None else last
        x, more = text[start:end], AROUND + end - start
        blank = lambda s: s.replace(x, " " * len(x))
        before, after = blank(text[max(0, first - more) : first])[-AROUND:], blank(text[last : last + more])[:AROUND]
        size = lambda s: len(self.compressor.compress(s.encode()))
        return size(before + after + x) - size(before + after)


def needed_bytes(x: str) -> float:
    """Bytes from which x is novel: NOVEL a character while the code of its surroundings decides what it costs, and
    nearer to what random characters of its alphabet take the longer it is, as the compressor then adapts to it."""
    if re.fullmatch("[0-9A-F]+|[0-9a-f]+", x):
        size = 16
    elif re.fullmatch("[A-Z2-7]+=*", x):
        size = 32
    else:
        size = sum(n for c, n in (("[0-9]", 10), ("[A-Z]", 26), ("[a-z]", 26)) if re.search(c, x)) + len(set(x) & set("+/_-"))
    least = min(NOVEL, RANDOM * math.log2(size) / 8)
    return len(x) * (least + (NOVEL - least) * min(1.0, SHORT / len(x)))


def _candidates(text: str):
    """Runs near sensitive words, each as a list of (start, end): itself and the runs joined to it by dots.

    A run that is not near a word but begins with or holds one counts from the end of the first on.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [z for _, z in words]
    reach = 0
    for m in CANDIDATE.finditer(text) if words else ():
        start, end = m.span()
        if start < reach:  # joined to the one before
            continue
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        if not (before and start - ends[before - 1] <= NEAR or after < len(starts) and starts[after] - end <= NEAR):
            if before == len(ends) or ends[before] + 16 > end:
                continue
            start = ends[before]
        parts = [(start, end)]
        while part := JOINED.match(text, parts[-1][1]):
            parts.append((part.start() + 1, part.end()))
        reach = parts[-1][1]
        yield parts


def find(text: str, novelty: Novelty) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's number, end, where the secret itself starts, bytes it adds), in the order of spans."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    base = sorted((a, z) for a, _, z, _ in out)
    begins = [a for a, _ in base]
    reach = [0]  # how far the base spans go that begin before the next one
    for _, z in base:
        reach.append(max(reach[-1], z))
    found = [(a, k, z, s, novelty.marginal_bytes(text, s, z)) for a, k, z, s in out]
    for parts in _candidates(text):
        for start, end in parts:
            x = text[start:end]
            if len(x) < 16 or reach[bisect_left(begins, end)] > start or not (re.search("[0-9]", x) and re.search("[A-Za-z]", x)):
                continue
            added = novelty.marginal_bytes(text, start, end, parts[0][0], parts[-1][1])
            if added >= needed_bytes(x):
                found.append((start, 3, end, start, added))
    return sorted(found)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z, _, _ in spans)


def _each(column: pa.Array, novelty: Novelty):
    """(row, text, spans) of the texts that can hold a span."""
    hit = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), ANY), False)
    for i in pc.indices_nonzero(hit).to_pylist():
        text = column[i].as_py()
        yield i, text, find(text, novelty)


def scan(docs: DataFrame) -> DataFrame:
    """What op10 returns, with n_novel and added (each span's added bytes, joined by commas), for documents (doc_id, text)."""
    empty = sha256(b"").hexdigest()
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    names = identifiers(docs)

    def run(batches):
        novelty = held(("novelty", names), lambda: Novelty(names))
        for whole in batches:
            for b in pieces(whole, "text"):
                n = len(b)
                counts, base, listed, added = [[0] * n for _ in KINDS], [empty] * n, [""] * n, [""] * n
                for i, _, spans in _each(b["text"], novelty):
                    for x in spans:
                        counts[x[1]][i] += 1
                    base[i] = sha256(_listed([s for s in spans if s[1] < 3]).encode()).hexdigest()
                    listed[i] = _listed(spans)
                    added[i] = ",".join(str(x[4]) for x in spans)
                yield pa.record_batch([b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(listed), pa.array(added)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, added string").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "added")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text (of an assignment: its value) replaced by mark; n_chars, if there, follows."""
    at_text = docs.columns.index("text")
    known = identifiers(docs)

    def run(batches):
        novelty = held(("novelty", known), lambda: Novelty(known))
        for whole in batches:
            for b in pieces(whole, "text"):
                texts = None
                for i, text, spans in _each(b["text"], novelty):
                    if not spans:
                        continue
                    texts = b["text"].to_pylist() if texts is None else texts
                    out, at = [], 0
                    for a, z in sorted((s, z) for _, _, z, s, _ in spans):
                        if a >= at:
                            out += [text[at:a], mark]
                        at = max(at, z)
                    texts[i] = "".join([*out, text[at:]])
                yield b if texts is None else b.set_column(at_text, b.schema.field("text"), pa.array(texts, b.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
