"""What several operators share: scratch tables in the shared folder, Arrow helpers, word and shingle hashing."""

from __future__ import annotations

import ctypes
import io
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes up to which a set of blocks is broadcast; beyond, blocks and shards meet in a join on both numbers.
BROADCAST_BYTES = 8 << 20

# Workers live on between tasks; the system's allocator gives large buffers back when they are freed.
pa.set_memory_pool(pa.system_memory_pool())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.  Where that is unset, a local one on one machine (as in tests); on a
    cluster, whose executors share no local folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/quillgraph-scratch"
    return f"{base.rstrip('/')}/quillgraph-{uuid.uuid4().hex}"


def unused(stem: str, *names: list[str]) -> str:
    """stem, or stem with as many _ before it as none of the column names has (compared as Spark does, without case)."""
    taken = {c.lower() for columns in names for c in columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet (zstd) and read back: cuts lineage so that a lost executor costs no recomputation."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks: one object at a time, so operators do not add up in a worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """For tasks that keep nothing: lets go of what an operator before has left in the worker, and has the C library
    (where it can) give free pages back; workers are many and live on between tasks."""
    _HELD.clear()
    if _TRIM:
        _TRIM(0)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Holds the session's Arrow batches to `most` bytes, so that a task's memory does not follow the rows' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bytes(**arrays: np.ndarray) -> bytes:
    """Named arrays of plain types as one value."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held_:
        return dict(held_)


def numbered(packed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A written table whose tasks numbered their rows `partition << 24 | place`, numbered from 0 on, and how many rows it has.

    What is broadcast has one row of 16 bytes for each task that wrote.
    """
    sizes = packed.groupBy(F.shiftright(name, 24).alias("_task")).agg(F.count("*").alias("_rows"))
    before = sizes.select("_task", (F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")).alias("_before"))
    dense = packed.withColumn("_task", F.shiftright(name, 24)).join(F.broadcast(before), "_task")
    dense = dense.withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << 24) - 1)))
    return dense.select(*packed.columns), packed.count()


def meet(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Each shard (shard, ...) with each block (block, ...) of a stated set of queries.

    Blocks of up to `most` bytes in all go to where the shards are; more of them meet the shards in a join on both numbers,
    so that no task holds more than a shard and a block at a time.
    """
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in blocks.schema if f.dataType.typeName() == "binary"), F.lit(0))
    held_ = blocks.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0
    copies = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if held_ <= most:
        return copies.join(F.broadcast(blocks), "block")
    return copies.join(blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))), ["shard", "block"])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the len+1 offsets of a string column; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Slices of a batch whose texts hold about max_bytes at most (one text alone may hold more)."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(col):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift), as in public splitmix generators."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _inverse_odd(a: int) -> int:
    return pow(a, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, up to n."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE, _inverse_odd(_BASE)):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POW[:] = out
    return _POW[0], _POW[1]


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


_CODES = _byte_codes()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word `[^\\x20\\x09-\\x0D]+` (A-Z lowered), and each text's first word as len+1 offsets."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_CODES[raw] * power[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))
    return words, np.searchsorted(starts, offsets)


def raw_shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of each text in reading order, repeats included, and len+1 offsets.

    With fewer words than k the whole sequence is one shingle; without words there is none.
    """
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    h = np.full(max(0, len(words) - k + 1), k, U64)
    for i in range(k):
        h = mix(h * U64(0x8EBC6AF09C88C6E3) + words[i : i + len(h)])
    full = counts >= k
    slots = np.where(full, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(slots)])
    keep = np.zeros(len(words) + 1, np.int64)
    np.add.at(keep, first[:-1][full], 1)
    np.add.at(keep, first[1:][full] - k + 1, -1)
    if full.all():
        return h[np.cumsum(keep[: len(h)]) > 0], out
    got = np.empty(out[-1], U64)
    got[np.repeat(full, slots)] = h[np.cumsum(keep[: len(h)]) > 0]
    for d in np.flatnonzero(~full & (counts > 0)):
        x = counts[d : d + 1].astype(U64)
        for w in range(first[d], first[d + 1]):
            x = mix(x * U64(0x8EBC6AF09C88C6E3) + words[w])
        got[out[d]] = x[0]
    return got, out


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-word shingle hashes of each text, sorted."""
    h, out = raw_shingles(raw, offsets, k)
    sets = []
    for d in range(len(offsets) - 1):
        x = np.sort(h[out[d] : out[d + 1]])
        sets.append(x if len(x) < 2 or (fresh := x[1:] != x[:-1]).all() else x[np.concatenate([[True], fresh])])
    return sets
