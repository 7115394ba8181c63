"""Graph operators.  Frontier loops cut lineage with checkpointed tables, one per hop."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import packed, unpacked


def _keep(df: DataFrame, spark_dir: str, step: str) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs one hop at most.

    zstd, as ids are hexadecimal digests, which take half the space only where symbols are coded by frequency.
    """
    path = f"{spark_dir}/{step}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files up to which a stored table may be broadcast, as the planner sees fit.
FEW = 4 << 20


def stored_bytes(spark, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def unsent(df: DataFrame, size: int) -> DataFrame:
    """df, which rests on files of so many bytes: beyond a few its joins are merged and not broadcast.

    The planner goes by the size of files, and ids in zstd take a fraction of what they are in memory and on their way through
    the driver.
    """
    return df.hint("merge") if size > FEW else df


def shared_dir(spark) -> str:
    """A new folder under spark.checkpoint.dir; unset, a local one on one machine (as in tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/quillgraph-graph"
    return f"{base.rstrip('/')}/graph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean(spark) -> None:
    """Delete all scratch tables of this application, for the end of a job: results of loops that are not written elsewhere go too."""
    drop_folder(spark, shared_dir(spark).rsplit("/", 1)[0])


def drop_folder(spark, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reachable(edges: DataFrame, starts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(id): nodes reached from the starts over (from_id, to_id), starts themselves excluded.

    Each hop joins the frontier with the edges and drops what has been seen, so cycles end.
    """
    folder = shared_dir(edges.sparkSession)
    edges = _keep(edges.select("from_id", "to_id").distinct(), folder, "edges")
    frontier = _keep(starts.select("id").distinct(), folder, "starts")
    seen, parts = None, []
    for hop in range(most):
        step = edges.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
        step = step.join(starts.select("id"), "id", "left_anti")
        if seen is not None:
            step = step.join(seen, "id", "left_anti")
        frontier = _keep(step, folder, f"hop-{hop}")
        if frontier.isEmpty():
            break
        parts.append(f"{folder}/hop-{hop}")
        seen = edges.sparkSession.read.schema(frontier.schema).parquet(*parts)
    # Of the steps only the hops are the result.
    for name in ("edges", "starts", f"hop-{len(parts)}") if parts else ("edges", "starts"):
        drop_folder(edges.sparkSession, f"{folder}/{name}")
    return seen if seen is not None else frontier


def reachable_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): what each start (id) reaches, itself excluded; for starts that are few against the graph."""
    folder = shared_dir(edges.sparkSession)
    edges = _keep(edges.select("from_id", "to_id").distinct(), folder, "edges")
    frontier = _keep(starts.select(F.col("id").alias("start"), "id").distinct(), folder, "starts")
    seen, parts, hop = None, [], 0
    while True:
        step = frontier.join(edges, frontier["id"] == edges["from_id"]).select("start", F.col("to_id").alias("id")).where("start <> id").distinct()
        if seen is not None:
            step = step.join(seen, ["start", "id"], "left_anti")
        frontier = _keep(step, folder, f"hop-{hop}")
        if frontier.isEmpty():
            for name in ("edges", "starts", f"hop-{hop}") if parts else ("edges", "starts"):
                drop_folder(edges.sparkSession, f"{folder}/{name}")
            return seen if seen is not None else frontier
        parts.append(f"{folder}/hop-{hop}")
        seen = edges.sparkSession.read.schema(frontier.schema).parquet(*parts)
        hop += 1


def is_ancestor(edges: DataFrame, ancestor: DataFrame, head: DataFrame) -> DataFrame:
    """(id): those of `ancestor` that are the head or reachable from it."""
    return ancestor.select("id").join(head.select("id").unionByName(reachable(edges, head)), "id", "left_semi")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, comp): the least id of each weakly connected component.

    A round gives a node the least label around it and then that label's label, so long chains take few rounds.
    """
    both = _keep(edges.select("from_id", "to_id").union(edges.select("to_id", "from_id")).distinct(), folder, "both")
    labels = _keep(both.groupBy(F.col("from_id").alias("id")).agg(F.min(F.least("from_id", "to_id")).alias("comp")), folder, "labels-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels.withColumnsRenamed({"id": "to_id", "comp": "near"}), "to_id").groupBy(F.col("from_id").alias("id")).agg(F.min("near").alias("near"))
        lower = labels.join(around, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = labels.withColumnsRenamed({"id": "low", "comp": "next"})
        fresh = lower.join(jump, "low").select("id", F.least("low", "next").alias("comp"), (F.least("low", "next") != F.col("comp")).alias("changed"))
        fresh = _keep(fresh, folder, f"labels-{step}")
        labels = fresh.select("id", "comp")
        drop_folder(edges.sparkSession, f"{folder}/labels-{step - 1}")
        if fresh.where("changed").isEmpty():
            return labels


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within so many undirected hops, starts at hop 0."""
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()
    found = starts.select("id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        step = both.join(found.where(F.col("hop") == hop - 1).select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
        found = found.unionByName(step.join(found, "id", "left_anti").withColumn("hop", F.lit(hop)))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    # Ids as bytes here and below, see ids.packed.
    ends = edges.select(F.explode(F.array(packed(F.col("from_id")), packed(F.col("to_id")))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).withColumn("id", unpacked(F.col("id")))


def contradicted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): ends of contradicting or refuting edges, proposals too."""
    ends = edges.where("kind in ('Contradicts', 'Refutes')").select(F.explode(F.array(packed(F.col("from_id")), packed(F.col("to_id")))).alias("id"))
    return nodes.select(packed(F.col("id")).alias("id")).join(ends, "id", "left_semi").withColumn("id", unpacked(F.col("id")))


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    edges = edges.withColumns({end: packed(F.col(end)) for end in ("from_id", "to_id")})
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(packed(F.col("id")).alias(end)), end, "left_semi")
    return edges.withColumns({end: unpacked(F.col(end)) for end in ("from_id", "to_id")})


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.filter(points, lambda x: x > 0), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)) % F.lit(1 << 32))
