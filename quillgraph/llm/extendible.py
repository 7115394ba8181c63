"""Sharding by extendible hashing: only buckets over the byte limit split, on one more hash bit at a time.

A row's 63 hash bits are 31 of its key's md5, then 32 of its tie column's md5: rows of one hot key stay
together as long as they fit, and part by their contents beyond that.  A directory indexed by the first g
bits holds each entry's local depth: the fewest bits whose bucket fits the limit.  It comes from one
aggregation by g-bit prefix; entries that are over the limit even at g bits are taken up again with more
bits, alone, until all fit.  Rows equal in all 63 bits cannot part by bits: they are chained on overflow
pages that hold as many as fit, numbered within input partitions so that no task sees them all.

Results: one row per input row.  A row over the limit has a shard of its own, marked oversize.  Null keys
hash as the empty string, null ties too; an empty table gives no rows; key and tie are cast to strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, remove, scratch_dir, table, unused

BITS, STEP, MOST = 63, 8, 24
#: Bytes of rows in a file that shards share.
FILE_BYTES = 128 << 20


def _word(text: Column, shift: int) -> Column:
    """The first 32 bits of an md5 as a long, less `shift` low ones."""
    return F.shiftrightunsigned(F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), shift)


def hash_bits(key: Column, tie: Column) -> Column:
    return F.shiftleft(_word(key, 1), 32).bitwiseOR(_word(tie, 0))


def assign(rows: DataFrame, limit: int, path: str | None = None) -> DataFrame:
    """rows (id, bits long, bytes long) with depth, prefix, page, shard, shard_rows, shard_bytes, oversize.

    path: where the steps are kept, for a caller that removes them after the result is used; under `rows` are the rows.
    """
    spark = rows.sparkSession
    path = path or scratch_dir(spark)
    pending = materialize(rows.select("id", "bits", "bytes", F.spark_partition_id().alias("part")), f"{path}/rows")
    total = pending.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(MOST, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    placed = []
    while True:
        entry = F.shiftright("bits", BITS - high)
        counts = pending.groupBy(entry.alias("entry")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = counts.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(entry, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = levels.select("entry", "depth", "prefix").join(sums.where(F.col("shard_bytes") <= limit), ["depth", "prefix"])
        best = fits.groupBy("entry").agg(F.min(F.struct("depth", "prefix", "shard_rows", "shard_bytes")).alias("bucket"))
        directory = materialize(counts.select("entry").join(best, "entry", "left"), f"{path}/directory-{high}")
        found = pending.withColumn("entry", entry).join(directory, "entry")
        placed.append(found.where("bucket is not null").select("id", "bytes", "bucket.*", F.lit(None).cast("string").alias("page")))
        if directory.where("bucket is null").isEmpty():
            break
        pending = materialize(found.where("bucket is null").select("id", "bits", "bytes", "part"), f"{path}/rows-{high}")
        if high == BITS:
            placed.append(_pages(pending, limit))
            break
        low, high = high + 1, min(BITS, high + STEP)
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    shard = F.concat_ws(":", F.col("depth").cast("string"), F.col("prefix").cast("string"), "page")
    return out.withColumns({"shard": shard, "oversize": F.col("shard_bytes") > limit})


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows equal in all bits on pages of each input partition: as many as fit, at least one."""
    own = Window.partitionBy("bits", "part").orderBy("bytes", "id")
    most = F.max("bytes").over(Window.partitionBy("bits", "part"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(most, F.lit(1))))
    paged = rows.withColumn("page", F.floor((F.row_number().over(own) - 1) / per_page))
    page = Window.partitionBy("bits", "part", "page")
    return paged.select("id", "bytes", F.lit(BITS).alias("depth"), F.col("bits").alias("prefix"), F.count("*").over(page).alias("shard_rows"), F.sum("bytes").over(page).alias("shard_bytes"), F.concat_ws(".", F.col("part").cast("string"), F.col("page").cast("string")).alias("page"))


def write_shards(df: DataFrame, key: str, tie: str, limit: int, path: str, extra: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """df's rows as Parquet under path, and what is read back: df's columns and `shard`.

    Shards share files of about `file_bytes`, each whole in one, sorted by shard, so that a reader of one skips the row groups of
    others; shard_files() tells which file has which.  A row's size is that of its tie column's text and `extra`
    bytes.  A column of df named shard stays, and the shard's name gets a _ before it.
    """
    spark, name, steps = df.sparkSession, unused("shard", df.columns), scratch_dir(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("id"), hash_bits(F.col(f"`{key}`"), F.col(f"`{tie}`")).alias("bits"), (F.coalesce(F.octet_length(F.col(f"`{tie}`").cast("string")), F.lit(0)).cast("long") + extra).alias("bytes"))
    placed = assign(rows, limit, steps).select("id.*", F.col("shard").alias(name))
    total = spark.read.parquet(f"{steps}/rows").agg(F.sum("bytes")).first()[0] or 0
    placed.repartition(max(1, math.ceil(total / file_bytes)), name).sortWithinPartitions(name).write.parquet(path)
    remove(spark, steps)
    return spark.read.schema(placed.schema).parquet(path)


def shard_files(shards: DataFrame, name: str = "shard") -> DataFrame:
    """(shard, file, rows) of what write_shards gave back: the manifest, from the shards' names alone."""
    return shards.select(F.col(name).alias("shard"), F.input_file_name().alias("file")).groupBy("shard", "file").agg(F.count("*").alias("rows"))


OP3_LIMIT = 1 << 20


def op3_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of whole rows of documents are written; names and sizes are those of the written rows."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = write_shards(docs, "doc_id", "text", OP3_LIMIT, f"{path}/shards", 16).select("doc_id", unused("shard", docs.columns), size.alias("bytes")).toDF("doc_id", "shard", "bytes")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
    depth = F.split("shard", ":")[0].cast("int")
    return rows.join(sizes, "shard").select("doc_id", "shard", depth.alias("depth"), "shard_rows", "shard_bytes", (F.col("shard_bytes") > OP3_LIMIT).alias("oversize"))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) >> 1) * 4294967296
                 + CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS bits,
         CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS bytes
  FROM documents),
s AS (
  SELECT l.depth, d.bits >> (63 - l.depth) AS prefix, CAST(sum(d.bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM d, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS depth) l GROUP BY ALL),
b AS (
  SELECT d.doc_id, d.bits, s.depth, s.prefix, s.shard_rows, s.shard_bytes,
         row_number() OVER (PARTITION BY d.doc_id, d.bits ORDER BY s.depth) AS place, count(*) OVER (PARTITION BY d.doc_id, d.bits, s.depth) AS same
  FROM d JOIN s ON s.prefix = d.bits >> (63 - s.depth) AND s.shard_bytes <= {OP3_LIMIT})
SELECT doc_id, depth || ':' || prefix AS shard, depth, shard_rows, shard_bytes, shard_bytes > {OP3_LIMIT} AS oversize
FROM b WHERE place <= same
"""
