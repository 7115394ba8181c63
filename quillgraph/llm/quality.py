"""Quality rules: compression bands beside plain counts of words, symbols, repeated lines and repeated windows.

zstandard compresses each whole text, and each of its chunks of CHUNK bytes (the last one with what is left, if that is
half a chunk or more).  What a text of n bytes may come to lies in a band that depends on n: little text compresses little
whatever it says, so the limits are set for lengths that double, and between them they run straight.  A text is
`repetitive` under its band and `incompressible` over it; likewise a chunk by the band of its own length, and a text of
which more than SHARE percent of the chunks fall out on one side goes too, which catches long runs of either kind within
a text that is right as a whole.  Sizes are compared as whole numbers, so equal texts fare alike anywhere.

The counts are exact: words and lines get numbers by their bytes, and windows of 8 words get theirs by doubling
(pairs of words, of pairs, of fours), so that nothing rests on hashes.  A batch of texts is counted at once.

Null and empty texts, and those without words, have counts of 0 and fail as short; n_bytes and packed are then those of the
empty text.  Equal texts give equal results, repeated rows are repeated, an empty table gives no rows.  `measure` reads only
doc_id and text; `keep` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import _SPACE, bounded_batches, pieces, release, table, text_buffers

LEVEL, CHUNK, SHARE, WINDOW = 3, 1024, 50, 8
#: Base rule: the fewest words, and the percentage of words in repeated windows that is too much.
LEAST_WORDS, REPEATED = 20, 30
#: Bytes of text; compressed bytes a thousand of them from which prose begins and at which it ends.
BANDS = (
    (64, 400, 1250),
    (128, 280, 1100),
    (256, 200, 1010),
    (512, 150, 880),
    (1024, 120, 780),
    (2048, 100, 720),
    (4096, 85, 690),
    (16384, 65, 670),
    (65536, 50, 660),
)
SYMBOLS = b"#*$%&|<>"
VERDICTS = ("kept", "repetitive", "incompressible")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def limits(n: int, bands=BANDS) -> tuple[int, int]:
    """The least and most compressed bytes, times 1000, of n bytes of prose."""
    at = bisect_right(bands, (n, 1 << 30, 1 << 30))
    if at == 0 or at == len(bands):
        low, high = bands[min(at, len(bands) - 1)][1:]
        return low * n, high * n
    (a, low_a, high_a), (b, low_b, high_b) = bands[at - 1], bands[at]
    between = lambda x, y: x + (y - x) * (n - a) // (b - a)
    return between(low_a, low_b) * n, between(high_a, high_b) * n


def side(n: int, packed: int, bands=BANDS) -> int:
    """Which of VERDICTS n bytes are that compress to `packed`."""
    low, high = limits(n, bands)
    return 1 if packed * 1000 < low else 2 if packed * 1000 > high else 0


class Bands:
    """Judges texts by what they compress to."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, share: int = SHARE):
        self.bands, self.chunk, self.share = bands, chunk, share
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def judge(self, text: bytes) -> tuple[int, int, int, int, int]:
        """(compressed bytes, chunks, repetitive ones, incompressible ones, place in VERDICTS)."""
        packed = len(self.zstd.compress(text))
        sides = [0, 0, 0]
        for start in range(0, len(text), self.chunk):
            part = text[start : start + self.chunk]
            if 2 * len(part) >= self.chunk:
                sides[side(len(part), len(self.zstd.compress(part)), self.bands)] += 1
        verdict = side(len(text), packed, self.bands)
        for k in (1, 2):
            if not verdict and 100 * sides[k] > self.share * sum(sides):
                verdict = k
        return packed, sum(sides), sides[1], sides[2], verdict


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags hold between neighbours of at."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _numbers(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each of the strings that follow one another in raw; equal strings, equal numbers."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text (words[first[d]:first[d + 1]], numbers): words that lie in a window that the text holds twice or more."""
    now, span = words, 1
    while 2 * span <= window:
        now = now[: max(0, len(now) - span)] * (int(now.max(initial=0)) + 1) + now[span:] if len(now) > span else now[:0]
        now = pd.factorize(now)[0].astype(np.int64)
        span *= 2
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[: len(now)] == text[window - 1 :]) if len(now) else np.zeros(0, np.int64)
    codes, seen = pd.factorize(text[inside] * (int(now.max(initial=0)) + 1) + now[inside])
    again = inside[np.bincount(codes, minlength=len(seen))[codes] > 1] if len(inside) else inside
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return _sums(np.cumsum(edge)[:-1] > 0, first)


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of texts, raw[offsets[d]:offsets[d + 1]] in UTF-8."""
    size = len(offsets) - 1
    # With a line feed after each text, no word or line runs over into the next.
    raw = np.insert(raw, offsets[1:], 10)
    offsets = offsets + np.arange(size + 1)
    inside, feed = ~_SPACE[raw], raw == 10
    edges = np.diff(np.concatenate([[False], inside]).astype(np.int8), append=0)
    starts, ends = np.flatnonzero(edges[: len(raw)] == 1), np.flatnonzero(edges[: len(raw)] == -1)
    words, first = _numbers(raw[inside], ends - starts), np.searchsorted(starts, offsets)
    line_ends = np.flatnonzero(feed)
    line_starts = np.concatenate([[0], line_ends + 1])[: len(line_ends)]
    lines, text = _numbers(raw[~feed], line_ends - line_starts), np.searchsorted(offsets, line_ends, "right") - 1
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines, text = lines[wordy], text[wordy]
    fresh = np.unique(text * (int(lines.max(initial=0)) + 1) + lines, return_index=True)[1]
    return {
        "n_words": np.diff(first),
        "word_chars": _sums(inside & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[raw], offsets),
        "n_dup_lines": np.bincount(text, minlength=size) - np.bincount(text[fresh], minlength=size),
        "n_repeat_words": repeated_words(words, first),
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, packed long, n_chunks long, n_repetitive long, n_incompressible long, verdict string"


def measure(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(doc_id, MEASURES): counts, bytes, compressed bytes, chunks and how many fall out of their band, and the verdict."""

    def run(batches):
        release()
        judge = Bands(bands, chunk, share).judge
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = text_buffers(part["text"])
                found = counts(raw, offsets)
                view = memoryview(raw)
                rows = [judge(bytes(view[a:z])) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                judged = np.array(rows, np.int64).reshape(-1, 5).T
                cells = [part["doc_id"], *(pa.array(found[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                cells += [pa.array(np.diff(offsets)), *map(pa.array, judged[:4]), pa.array([VERDICTS[k] for k in judged[4]], pa.string())]
                yield pa.record_batch(cells, ["doc_id", *(c.split()[0] for c in MEASURES.split(", "))])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose texts pass the base rule and the bands; repeated rows stay repeated."""

    def run(batches):
        release()
        judge = Bands().judge
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = text_buffers(part["text"])
                found = counts(raw, offsets)
                fine = (found["n_words"] >= LEAST_WORDS) & (100 * found["n_repeat_words"] <= REPEATED * found["n_words"])
                fine &= np.array([bool(f) and judge(raw[a:z].tobytes())[4] == 0 for f, a, z in zip(fine, offsets[:-1], offsets[1:], strict=True)], bool)
                yield part.filter(pa.array(fine))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(table(spark, sf_dir, "documents"))
    verdict = F.col("verdict") == "kept"
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"),
        "verdict", "n_bytes", "packed", "n_chunks", "n_repetitive", "n_incompressible",
    )
