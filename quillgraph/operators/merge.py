"""State-based merges of replicas: grouped aggregations that are associative, commutative and idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lattice import BOTH
from quillgraph.functions.vectors import bit_patterns
from quillgraph.operators.graph import _keep, shared_dir
from quillgraph.schema import STATUS_RANKS, TRUST_RANKS, edge_tag, lookup, status_rank, trust_rank

#: What a merge counts.
COUNTERS = ("nodes_added", "nodes_merged", "edges_added", "edges_merged", "superseded", "rejected_supersessions", "rejected_signatures", "contradictions")
_STATUS = {v: k for k, v in STATUS_RANKS.items()}
_TRUST = {v: k for k, v in TRUST_RANKS.items()}


def join_confidence(df: DataFrame, keys: list[str], column: str = "confidence") -> DataFrame:
    """(keys, confidence): OR of the vectors position by position, as long as the longest."""
    at = df.select(*keys, F.posexplode(column).alias("pos", "value"))
    cells = at.groupBy(*keys, "pos").agg(F.bit_or("value").alias("value"))
    cells = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    return cells.select(*keys, F.transform("cells", lambda c: c["value"]).alias(column))


def merge_nodes(copies: DataFrame) -> DataFrame:
    """One row per id from copies of nodes.

    status by its highest rank, with the least valid_to of the rows that hold it (null if none has one);
    the least trusted tier; the least embedding by (model, bit patterns); the least signature; the union of
    anchors; the least valid_from and observed_at; confidence joined.  Identity fields are equal in copies.
    """
    have = set(copies.columns)
    rank = status_rank(F.col("status"))
    # One pass for the highest rank and its valid_to: null counts as later than any.
    last = F.struct(rank.alias("rank"), (-F.coalesce(F.col("valid_to"), F.lit((1 << 63) - 1))).alias("later"))
    aggregates = [F.max(last).alias("_last"), F.max(trust_rank(F.col("trust_tier"))).alias("_trust")]
    aggregates += [F.min(c).alias(c) for c in ("valid_from", "observed_at", "signature") if c in have]
    if "embedding" in have:
        key = F.when(F.col("embedding").isNotNull(), F.struct(F.col("embedding.model"), bit_patterns(F.col("embedding.data")), F.col("embedding").alias("own")))
        aggregates.append(F.min(key).alias("_embedding"))
    if "anchors" in have:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("anchors")))).alias("anchors"))
    same = [c for c in ("schema_version", "plane", "kind", "repo", "author", "source_ref", "content") if c in have]
    aggregates += [F.first(c, ignorenulls=True).alias(c) for c in same]
    out = copies.groupBy("id").agg(*aggregates)
    later = -F.col("_last.later")
    out = out.withColumns({"status": lookup(F.col("_last.rank"), _STATUS), "valid_to": F.when(later != (1 << 63) - 1, later), "trust_tier": lookup(F.col("_trust"), _TRUST)})
    if "embedding" in have:
        out = out.withColumn("embedding", F.col("_embedding.own")).drop("_embedding")
    if "confidence" in have:
        out = out.join(join_confidence(copies.select("id", "confidence"), ["id"]), "id", "left")
    return out.drop("_last", "_trust")


def merge_edges(copies: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, kind): quarantined only if all copies are; confidence joined; the advisory
    fields of the least trusted copy, ties by the fields themselves."""
    keys = ["from_id", "to_id", "kind"]
    fields = [c for c in ("plane", "provenance", "signature") if c in copies.columns]
    order = F.struct((-trust_rank(F.col("trust_tier"))).alias("rank"), *fields)
    out = copies.groupBy(*keys).agg(F.bool_and("quarantined").alias("quarantined"), F.min(order).alias("_least"))
    out = out.withColumns({"trust_tier": lookup(-F.col("_least.rank"), _TRUST), **{c: F.col(f"_least.{c}") for c in fields}}).drop("_least")
    return out.join(join_confidence(copies.select(*keys, "confidence"), keys), keys, "left") if "confidence" in copies.columns else out


def merge_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: nodes inserted, changed and unchanged, and positions of confidence newly contradicted."""
    old = before.select("id", F.lit(True).alias("had"), F.struct("status", "valid_to", "trust_tier").alias("was"), F.col("confidence").alias("old"))
    both = after.select("id", F.struct("status", "valid_to", "trust_tier").alias("is"), F.col("confidence").alias("new")).join(old, "id", "left")
    fresh = F.size(F.filter(F.coalesce("new", F.array().cast("array<tinyint>")), lambda x: x == BOTH)) - F.size(F.filter(F.coalesce("old", F.array().cast("array<tinyint>")), lambda x: x == BOTH))
    changed = ~F.col("is").eqNullSafe(F.col("was")) | ~F.col("new").eqNullSafe(F.col("old"))
    return both.agg(
        F.count_if(F.col("had").isNull()).alias("inserted"),
        F.count_if(F.col("had") & changed).alias("changed"),
        F.count_if(F.col("had") & ~changed).alias("unchanged"),
        F.sum(F.when(F.col("had"), fresh).otherwise(F.lit(0))).cast("long").alias("new_contradictions"),
    )


def _classified(local: DataFrame, remote: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """merged rows of remote keys with `_had`, `_changed` and `_torn` (positions of confidence that became contradicted)."""
    columns = [c for c in local.columns if c not in keys]
    old = local.select(*keys, F.struct(*columns).alias("_old"))
    both = merged.join(remote.select(*keys).distinct(), keys, "left_semi").join(old, keys, "left_outer")
    torn = F.lit(0)
    if "confidence" in columns:
        none = F.array().cast("array<tinyint>")
        both_at = lambda c: F.size(F.filter(F.coalesce(c, none), lambda x: x == BOTH))
        torn = F.when(F.col("_old").isNotNull(), both_at(F.col("confidence")) - both_at(F.col("_old.confidence"))).otherwise(0)
    return both.withColumns({"_had": F.col("_old").isNotNull(), "_changed": ~F.struct(*columns).eqNullSafe(F.col("_old")), "_torn": torn}).drop("_old")


def merge_bundle(nodes: DataFrame, edges: DataFrame, remote_nodes: DataFrame, remote_edges: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with a replica's bundle, and one row of its eight counters.

    keys (author, key): asserted items must carry a good signature of their author's or stay out; without keys the bundle is
    the own replica's and is not asked.  Nodes and plain edges are joined with what is stored; then each confirmed
    supersession goes through the guards, in the order of (from, to), and what passes is stored and retires its target.
    What is refused is left out and counted.
    """
    from quillgraph.operators import assertions, supersede

    folder = shared_dir(nodes.sparkSession)
    keep = lambda df, step: _keep(df, folder, step)
    node_columns, edge_columns = nodes.columns, edges.columns
    bad = F.lit(False)
    if keys is not None:
        remote_nodes, remote_edges = assertions.check_nodes(remote_nodes, keys), assertions.check_edges(remote_edges, keys)
        bad = ~F.coalesce("ok", F.lit(False))
    asserted = lambda df: (F.col("plane") == "Asserted") if "plane" in df.columns else F.lit(False)
    judged_nodes = keep(remote_nodes.withColumn("_bad", F.coalesce(asserted(remote_nodes) & bad, F.lit(False))), "nodes-in")
    judged_edges = keep(remote_edges.withColumn("_bad", F.coalesce(asserted(remote_edges) & bad, F.lit(False))), "edges-in")
    refused = judged_nodes.select("_bad").unionByName(judged_edges.select("_bad")).where("_bad").count()
    fresh, links = judged_nodes.where("not _bad").select(*node_columns), judged_edges.where("not _bad").select(*edge_columns)
    # From here on ends are bytes but for the guards: every join of edges shuffles them.
    edges, links = supersede.ends_packed(edges), supersede.ends_packed(links)

    own = nodes.join(fresh.select("id"), "id", "left_semi")
    sorted_nodes = keep(_classified(own, fresh, merge_nodes(own.unionByName(fresh)).select(*node_columns), ["id"]), "nodes-sorted")
    # Stored, as the guards and what is counted read it too.
    joined = nodes.join(fresh.select("id"), "id", "left_anti").unionByName(sorted_nodes.select(*node_columns))
    joined = keep(joined, "nodes-joined")

    at = ["from_id", "to_id", "kind"]
    firm = (F.col("kind") == "Supersedes") & ~F.col("quarantined")
    plain, claims = links.where(~firm), links.where(firm)
    own_edges = edges.join(plain.select(*at), at, "left_semi")
    merged = merge_edges(own_edges.unionByName(plain))
    merged = merged.join(own_edges.unionByName(plain).groupBy(*at).agg(*[F.min_by(c, F.struct("quarantined")).alias(c) for c in edge_columns if c not in merged.columns]), at) if set(edge_columns) - set(merged.columns) else merged
    sorted_edges = keep(_classified(own_edges, plain, merged.select(*edge_columns), at), "edges-sorted")
    linked = edges.join(plain.select(*at), at, "left_anti").unionByName(sorted_edges.select(*edge_columns))

    asked = claims.dropDuplicates(at).withColumn("at", supersede.clock(claims)) if "at" not in edge_columns else claims.dropDuplicates(at)
    asked = supersede.ends_unpacked(asked)
    order = ("from_id", "to_id")
    judged = keep(supersede.judge(joined, supersede.ends_unpacked(linked), asked, order), "judged")
    fine = supersede.ends_packed(judged.where("reason is null"))
    after = keep(supersede.apply_supersessions(joined, judged, order).select(*node_columns), "nodes-out")
    known = fine.join(edges.select(*at), at, "left_semi").count()
    outcome = linked.join(fine.select(*at), at, "left_anti").unionByName(fine.select(*edge_columns))
    done, turned = fine.count(), joined.where("status = 'Active'").join(after.where("status = 'Superseded'").select("id"), "id", "left_semi").count()
    n = sorted_nodes.agg(F.count_if(~F.col("_had")).alias("nodes_added"), F.count_if(F.col("_had") & F.col("_changed")).alias("nodes_merged"), F.coalesce(F.sum("_torn"), F.lit(0)).cast("long").alias("contradictions"))
    e = sorted_edges.agg((F.count_if(~F.col("_had")) + F.lit(done - known)).alias("edges_added"), F.count_if(F.col("_had") & F.col("_changed")).alias("edges_merged"))
    rest = {"superseded": turned, "rejected_supersessions": judged.count() - done, "rejected_signatures": refused}
    one = F.lit(1).alias("_one")
    counters = n.select("*", one).join(e.select("*", one), "_one").drop("_one").withColumns({k: F.lit(v).cast("long") for k, v in rest.items()})
    return after, keep(supersede.ends_unpacked(outcome).select(*edge_columns), "edges-out"), counters.select(*COUNTERS)


def dedup(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each id in the order of the columns."""
    return nodes.groupBy("id").agg(F.min_by(F.struct(*nodes.columns), F.struct(*order)).alias("_row")).select("_row.*")


def dedup_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    return edges.groupBy("from_id", "to_id", "kind").agg(F.min_by(F.struct(*edges.columns), F.struct(*order)).alias("_row")).select("_row.*")


def export(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """A tenant's nodes by id, and the edges that leave them by key."""
    own = nodes.where(F.col("repo") == repo).dropDuplicates(["id"])
    leaving = edges.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi").dropDuplicates(["from_id", "to_id", "kind"])
    return own.orderBy("id"), leaving.orderBy("from_id", "to_id", edge_tag(F.col("kind")))


def unwritable(nodes: DataFrame, edges: DataFrame, stored: DataFrame, grants: DataFrame) -> DataFrame:
    """(repo): repos that a bundle touches without a write grant; a null row for endpoints nobody knows."""
    owner = stored.select("id", "repo").unionByName(nodes.select("id", "repo")).distinct()
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    touched = nodes.select("repo").unionByName(ends.join(owner, "id", "left").select("repo")).distinct()
    return touched.join(grants.where("can_write").select("repo"), "repo", "left_anti")
