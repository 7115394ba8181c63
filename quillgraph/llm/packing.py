"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document over the capacity is cut into full pieces, each a bin of its own, and a rest; so nothing is
dropped.  Rests go, longest first, into the bin with the least residual that holds them and conflicts with
none: a bin carries a bitmap of its sources and one of its duplicate clusters, and has at most one document
of each.  Bins are kept in the order of (residual, bin); the search begins at the successor of the length
and goes on until a compatible bin is found, or a new one is opened.

Packing is sequential, so documents are dealt by a hash of doc_id and cluster into groups of about GROUP pieces, each
packed on its own; a source with a third of all rows is spread like any other.  A group that many rows of one key
have made much larger is dealt again by row.  Within a group the order is (words descending, doc_id, piece, source,
cluster), so the result depends on partitions only where such a group had to be dealt again.

Null and empty texts are pieces of 0 words; a null source or cluster conflicts with nothing; repeated rows
are pieces like others and, as members of one cluster, get different bins.  An empty table gives no rows.
`pack` reads only the columns it names, `pack_texts` doc_id, text and source; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, release, remove, scratch_dir, table
from quillgraph.llm.common import pieces as pieces_of

CAPACITY, GROUP = 2048, 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, position) of each (length, source, cluster), taken in the given order."""
    bits: dict = {}
    bins: list[tuple[int, int]] = []  # (residual, bin), in order
    sources, clusters, out = [], [], []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << bits.setdefault(("s", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("c", cluster), len(bits))
        at = bisect_left(bins, (length, -1))
        while at < len(bins) and (sources[bins[at][1]] & s or clusters[bins[at][1]] & c):
            at += 1
        if at < len(bins):
            residual, b = bins.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        out.append((b, capacity - residual))
        insort(bins, (residual - length, b))
    return out


def _dealt(rows: DataFrame, group_size: int, path: str) -> DataFrame:
    """rows (row, doc_id, cluster, ...) with grp and sub: groups of about group_size rows, over-full ones dealt again by row."""
    groups = max(1, -(-rows.count() // group_size))
    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))
    sizes = materialize(keyed.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > 2 * group_size), f"{path}/sizes")
    parts = F.ceil(F.col("size") / group_size)
    sub = F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), parts)).cast("int")
    return keyed.join(sizes, "grp", "left").withColumn("sub", sub).drop("size")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin, position) of rows (doc_id, n_words, source, cluster)."""
    path = scratch_dir(pieces.sparkSession)
    docs = materialize(pieces.select("doc_id", "n_words", "source", "cluster", F.monotonically_increasing_id().alias("row")), f"{path}/lengths")
    full = F.floor(F.col("n_words") / capacity).cast("int")
    whole = docs.where(full > 0).select("row", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).cast("long").alias("n_words"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("cluster"))
    rest = docs.where((F.col("n_words") % capacity > 0) | (F.col("n_words") == 0)).select("row", "doc_id", full.alias("piece"), (F.col("n_words") % capacity).alias("n_words"), "source", "cluster")
    out = _bins(whole.unionByName(rest), capacity, group_size, path)
    out = materialize(out.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), "n_words", "bin", "position"), f"{path}/out")
    for name in ("lengths", "sizes"):
        remove(pieces.sparkSession, f"{path}/{name}")
    return out


def _bins(pieces: DataFrame, capacity: int, group_size: int, path: str) -> DataFrame:
    """(row, doc_id, piece, n_words, bin, position) of rows (row, doc_id, piece, n_words, source, cluster); full pieces are bins."""
    own = F.concat(F.lit("full:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("piece").cast("string"), F.lit(":"), F.col("row").cast("string"))
    whole = pieces.where(F.col("n_words") == capacity).select("row", "doc_id", "piece", "n_words", own.alias("bin"), F.lit(0).cast("long").alias("position"))
    rest = _dealt(pieces.where(F.col("n_words") < capacity), group_size, path)

    def run(batches):
        held: dict[str, list] = {}
        now = None

        def packed():
            seen: dict = {}
            for c in held["cluster"]:
                seen[c] = seen.get(c, 0) + 1
            places = best_fit([(n, s, c if seen[c] > 1 else None) for n, s, c in zip(held["n_words"], held["source"], held["cluster"], strict=True)], capacity)
            cells = [pa.array(held[c], t) for c, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int64()))]
            return pa.record_batch([*cells, pa.array([f"{now[0]}.{now[1]}:{b}" for b, _ in places], pa.string()), pa.array([p for _, p in places], pa.int64())], ["row", "doc_id", "piece", "n_words", "bin", "position"])

        for b in batches:
            grp, sub = b["grp"].to_numpy(), b["sub"].to_numpy()
            cuts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist(), len(grp)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if now is not None and (int(grp[a]), int(sub[a])) != now:
                    yield packed()
                    held = {}
                now = int(grp[a]), int(sub[a])
                for c, values in b.slice(a, z - a).to_pydict().items():
                    held.setdefault(c, []).extend(values)
        if held:
            yield packed()

    ordered = rest.repartition("grp", "sub").sortWithinPartitions("grp", "sub", F.desc("n_words"), F.asc_nulls_first("doc_id"), "piece", "source", "cluster")
    return ordered.mapInArrow(run, "row long, doc_id long, piece int, n_words long, bin string, position long").unionByName(whole)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP) -> DataFrame:
    """(doc_id, piece, n_words, bin, position, text): documents (doc_id, text, source) cut into pieces of up to capacity
    words and packed; a bin's text is that of its pieces in the order of position.  Text between words stays as it is."""
    spark = docs.sparkSession
    path = scratch_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))

    def cut(batches):
        release()
        for whole in batches:
            for b in pieces_of(whole, "text"):
                row, piece, n_words, texts = [], [], [], []
                for i, text in enumerate(b["text"].to_pylist()):
                    begins = [m.start() for m in WORD.finditer(text or "")]
                    marks = [0, *begins[capacity::capacity], len(text or "")]
                    for k, (a, z) in enumerate(zip(marks[:-1], marks[1:], strict=True)):
                        row.append(i)
                        piece.append(k)
                        n_words.append(min(capacity, len(begins) - k * capacity))
                        texts.append(None if text is None else text[a:z])
                at = pa.array(row, pa.int64())
                yield pa.record_batch([b["doc_id"].take(at), b["source"].take(at), pa.array(piece, pa.int32()), pa.array(n_words, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "source", "piece", "n_words", "text"])

    cuts = rows.mapInArrow(cut, "doc_id long, source string, piece int, n_words long, text string")
    cuts = materialize(cuts.withColumns({"row": F.monotonically_increasing_id(), "cluster": F.md5("text")}), f"{path}/pieces")
    bins = materialize(_bins(cuts.drop("text"), capacity, group_size, path), f"{path}/bins")
    out = materialize(bins.join(cuts.select("row", "text"), "row").select("doc_id", "piece", "n_words", "bin", "position", "text"), f"{path}/out")
    for name in ("pieces", "bins", "sizes"):
        remove(spark, f"{path}/{name}")
    return out


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, source, cluster): white-space-separated words; copies of a text are a cluster."""
    text = F.col("text").cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("n_words"), F.col("source").cast("string").alias("source"), F.md5(text).alias("cluster"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(lengths(table(spark, sf_dir, "documents")))
