"""From commits, documents, manifests, catalogs and blocks to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import logical_key, trailer_kind, trailers


def spine(commits: DataFrame) -> DataFrame:
    """(child, parent, kind) from commits (sha, parents): the first parent is TemporalNext, the others MergeParent."""
    each = commits.select(F.col("sha").alias("child"), F.posexplode("parents").alias("pos", "parent"))
    return each.select("child", "parent", F.when(F.col("pos") == 0, "TemporalNext").otherwise("MergeParent").alias("kind"))


def trailer_edges(commits: DataFrame, authorities: DataFrame) -> DataFrame:
    """(sha, author, kind, target, quarantined) of trailers in commit bodies.

    Supersedes and Refutes are proposals unless the author is an authority.
    """
    each = commits.select("sha", "author", F.explode(trailers(F.col("body"))).alias("t"))
    named = each.select("sha", "author", trailer_kind(F.col("t.key")).alias("kind"), F.col("t.value").alias("target")).where("kind is not null")
    held = named.join(authorities.select("author").distinct().withColumn("firm", F.lit(True)), "author", "left")
    return held.select("sha", "author", "kind", "target", (F.col("kind").isin("Supersedes", "Refutes") & F.col("firm").isNull()).alias("quarantined"))


def drifted(heads: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(repo, head, seen): repos whose head differs from their watermark or that have none."""
    both = heads.join(watermarks.select("repo", F.col("head").alias("seen")), "repo", "left")
    return both.where(~F.col("head").eqNullSafe(F.col("seen"))).select("repo", "head", "seen")


def reconcile(heads: DataFrame, watermarks: DataFrame, queue: DataFrame) -> DataFrame:
    """Drifted repos that are not queued yet."""
    return drifted(heads, watermarks).join(queue.select("repo"), "repo", "left_anti")


def freshness(nodes: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(repo, head, ingested_at_ms): every tenant; `-` without a watermark."""
    own = nodes.select("repo").distinct().join(watermarks.select("repo", "head", "ingested_at_ms"), "repo", "left")
    return own.select("repo", F.coalesce("head", F.lit("-")).alias("head"), F.coalesce(F.col("ingested_at_ms").cast("string"), F.lit("-")).alias("ingested_at_ms"))


def manifest_graph(repos: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tenants, DependsOn edges between declared repos, and the undeclared dependencies that were passed over."""
    known = repos.select("name").distinct()
    good = depends.join(known.withColumnRenamed("name", "consumer"), "consumer", "left_semi").join(known.withColumnRenamed("name", "dep_repo"), "dep_repo", "left_semi")
    edges = good.select(F.col("consumer").alias("from_repo"), F.col("dep_repo").alias("to_repo"), F.lit("DependsOn").alias("kind")).distinct()
    return repos, edges, depends.join(good, ["consumer", "dep_repo"], "left_anti")


def redeploys(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(new_key, old_key): active keys `name@address` that a new address of the same name supersedes."""
    now = fresh.select(F.col("key").alias("new_key"), logical_key(F.col("key")).alias("name"))
    was = stored.where("status = 'Active'").select(F.col("key").alias("old_key"), logical_key(F.col("key")).alias("name"))
    return now.join(was, "name").where("new_key <> old_key").select("new_key", "old_key")


def block_walk(blocks: DataFrame, watched: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Blocks (number, hash, parent_hash, transactions) against stored checkpoints (number, hash).

    spine: blocks whose parent hash is that of the block before; events: transactions that touch a watched
    address (either side), once a hash; orphans: stored checkpoints that another hash at their height supersedes.
    """
    known = blocks.select("number", "hash").unionByName(stored.select("number", "hash").join(blocks.select("number"), "number", "left_anti"))
    before = known.select((F.col("number") + 1).alias("number"), F.col("hash").alias("before"))
    linked = blocks.join(before, "number").where(F.col("before") == F.col("parent_hash")).select("number", "hash", "before")
    tx = blocks.select("number", F.col("hash").alias("block"), F.explode("transactions").alias("t"))
    sides = tx.select("number", "block", F.col("t.hash").alias("tx"), F.explode(F.array_compact(F.array_distinct(F.array(F.lower("t.from"), F.lower("t.to"))))).alias("address"))
    events = sides.join(watched.select(F.lower("address").alias("address")).distinct(), "address", "left_semi").distinct()
    orphans = stored.join(blocks.select("number", F.col("hash").alias("now")), "number").where("hash <> now").select("number", F.col("hash").alias("orphan"), F.col("now").alias("by"))
    return {"spine": linked, "events": events, "orphans": orphans}


def branch_states(branches: DataFrame, live: DataFrame, merged: DataFrame) -> DataFrame:
    """branches (id, name, tip) with `state`: deleted, advanced, merged or active."""
    now = branches.join(live.select("name", F.col("tip").alias("live_tip")), "name", "left").join(merged.select(F.col("sha").alias("tip"), F.lit(True).alias("in_default")), "tip", "left")
    state = F.when(F.col("live_tip").isNull(), "deleted").when(F.col("live_tip") != F.col("tip"), "advanced").when(F.col("in_default"), "merged").otherwise("active")
    return now.select("id", "name", "tip", state.alias("state"))


def embed_split(nodes: DataFrame, stored: DataFrame, model: str, dim: int, weights: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes whose stored vector may be reused (same id, model and size), and those to embed.

    weights: the digest of the model's weights, where vectors come from elsewhere: only those with that digest are reused.
    """
    fit = stored.where((F.col("model") == model) & (F.size("data") == dim))
    fit = (fit if weights is None else fit.where(F.col("weights") == weights)).select("id", "model", "data")
    return nodes.join(fit, "id"), nodes.join(fit.select("id"), "id", "left_anti")


def quantity(text: Column) -> Column:
    """A 0x quantity up to 64 bits as decimal(38,0)."""
    return F.conv(F.substring(text, 3, 64), 16, 10).cast("decimal(38,0)")


def drain(queue: DataFrame) -> DataFrame:
    """(repo, first_seen, requests): a queue coalesced per repo, in order of first request."""
    return queue.groupBy("repo").agg(F.min("seq").alias("first_seen"), F.count("*").alias("requests")).orderBy("first_seen")


def newest(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` snapshots of each table."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return snapshots.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
