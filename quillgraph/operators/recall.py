"""Read queries over nodes and edges.  Each returns a lazy DataFrame; budgets cut last, after filters and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import lattice, vectors
from quillgraph.functions.ids import packed, unpacked
from quillgraph.functions.text import cite, truncate
from quillgraph.operators import lineage
from quillgraph.operators.graph import _keep, shared_dir
from quillgraph.schema import edge_tag

#: How analogy weighs its two scores, and how many times the budget its shortlist is.
COSINE_WEIGHT, STRUCTURE_WEIGHT, SHORTLIST = 0.7, 0.3, 4
ITEM = ("id", "repo", "kind", "plane", "trust_tier", "status", "author", "valid_from", "valid_to", "content")


def item(nodes: DataFrame) -> DataFrame:
    """Nodes flattened to what a recall shows; title is the content as text."""
    return nodes.select(*[c for c in ITEM if c in nodes.columns and c != "content"], F.decode(F.col("content"), "UTF-8").alias("title"))


def is_stub(ref: Column) -> Column:
    return F.coalesce(F.startswith(ref["key"], F.lit("ref:")), F.lit(False))


def tenant(nodes: DataFrame, repo: str, in_flight: DataFrame | None = None) -> DataFrame:
    """A tenant's canonical nodes: no stubs, no branch markers, no unmerged commits (in_flight: their ids)."""
    own = nodes.where((F.col("repo") == repo) & (F.col("kind") != "branch"))
    own = own.where(~is_stub(F.col("source_ref"))) if "source_ref" in nodes.columns else own
    return own.join(in_flight.select("id"), "id", "left_anti") if in_flight is not None else own


def storyline(nodes: DataFrame, budget: int) -> DataFrame:
    """Newest first, ties by id."""
    return nodes.orderBy(F.desc("valid_from"), "id").limit(budget)


def current_at(t: int | Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def as_of(nodes: DataFrame, t: int, budget: int, asserted: bool = False) -> DataFrame:
    """What held at t, newest first; derived nodes only unless asserted ones are asked for."""
    held = nodes.where(current_at(t))
    return storyline(held if asserted else held.where("plane = 'Derived'"), budget)


def needs_review() -> Column:
    return (F.col("trust_tier") == "InferredAdvisory") | (F.col("status") != "Active")


def review(nodes: DataFrame, budget: int) -> DataFrame:
    """Of the newest min(4 * budget, 500), those that need review, up to the budget."""
    window = storyline(nodes, min(4 * budget, 500))
    return storyline(window.where(needs_review()), budget)


def search(nodes: DataFrame, query: list[float], model: str, budget: int) -> DataFrame:
    """Top cosine matches of embedded nodes; other models, sizes and non-finite vectors are passed over."""
    data = F.col("embedding.data")
    fit = nodes.where((F.col("embedding.model") == model) & (F.size(data) == len(query)) & vectors.finite(data))
    scored = fit.withColumn("score", vectors.cosine(data, F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("score"), "id").limit(budget)


def _directed(edges: DataFrame, node_id: str) -> DataFrame:
    keep = ["kind", "quarantined"]
    out = edges.where(F.col("from_id") == node_id).select(F.lit(0).alias("direction"), F.col("to_id").alias("far_id"), *keep)
    into = edges.where(F.col("to_id") == node_id).select(F.lit(1).alias("direction"), F.col("from_id").alias("far_id"), *keep)
    return out.unionByName(into)


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, budget: int, readable: DataFrame | None = None) -> DataFrame:
    """Out edges, then in edges, by (far id, kind tag), with the far node or nulls.

    readable: repos that may be seen; unreadable far nodes go before the budget cuts, dangling edges stay.
    """
    far = nodes.select(F.col("id").alias("far_id"), F.col("repo").alias("far_repo"), F.col("status").alias("far_status"))
    found = _directed(edges, node_id).join(far, "far_id", "left")
    if readable is not None:
        allowed = readable.select(F.col("repo").alias("far_repo"), F.lit(True).alias("ok")).distinct()
        found = found.join(allowed, "far_repo", "left").where(F.col("far_repo").isNull() | F.col("ok")).drop("ok")
    return found.orderBy("direction", "far_id", edge_tag(F.col("kind"))).limit(budget)


def edge_signatures(edges: DataFrame) -> DataFrame:
    """(id, direction, kind, n): counts of edges that are not quarantined."""
    firm = edges.where("not quarantined")
    # Ids as bytes, as counts hardly shrink what is shuffled.
    both = firm.select(packed(F.col("from_id")).alias("id"), F.lit(0).alias("direction"), "kind").unionAll(firm.select(packed(F.col("to_id")).alias("id"), F.lit(1).alias("direction"), "kind"))
    return both.groupBy("id", "direction", "kind").agg(F.count("*").alias("n")).withColumn("id", unpacked(F.col("id")))


def signature_overlap(signatures: DataFrame, anchor: DataFrame) -> DataFrame:
    """(id, structural): multiset Jaccard of each id's signature with the anchor's; ids without edges are absent."""
    own = anchor.select("direction", "kind", F.col("n").alias("m"))
    total = own.agg(F.sum("m")).first()[0] or 0
    shared = signatures.join(F.broadcast(own), ["direction", "kind"], "left")  # an anchor has 34 rows at most
    sums = shared.groupBy(packed(F.col("id")).alias("id")).agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("same"))
    union = F.col("n") + total - F.col("same")
    return sums.select(unpacked(F.col("id")).alias("id"), F.when(union > 0, F.col("same") / union).otherwise(0.0).alias("structural"))


def analogies(nodes: DataFrame, edges: DataFrame, anchor_id: str, repos: DataFrame, budget: int) -> DataFrame:
    """Nodes of other repos like the anchor: cosine shortlist, then edge-kind structure, by the weighted score."""
    anchor = nodes.where(F.col("id") == anchor_id).select("repo", "embedding").first()
    if anchor is None:
        raise LookupError("analogy anchor is not among the nodes")
    empty = nodes.where("false").select("id", "repo", *[F.lit(0.0).alias(c) for c in ("cosine", "structural", "score")])
    if anchor["embedding"] is None or not any(anchor["embedding"]["data"]):
        return empty
    data = F.col("embedding.data")
    others = nodes.where((F.col("repo") != anchor["repo"]) & (F.col("embedding.model") == anchor["embedding"]["model"]) & (vectors.norm(data) > 0)).join(repos.select("repo").distinct(), "repo", "left_semi")
    others = others.where(~is_stub(F.col("source_ref"))) if "source_ref" in nodes.columns else others
    cosine = vectors.cosine(data, F.array(*[F.lit(float(x)) for x in anchor["embedding"]["data"]]))
    short = others.select("id", "repo", cosine.alias("cosine")).orderBy(F.desc("cosine"), "id").limit(max(SHORTLIST * budget, budget))
    near = edges.join(short.select(F.col("id").alias("from_id")), "from_id", "left_semi").unionByName(edges.join(short.select(F.col("id").alias("to_id")), "to_id", "left_semi")).distinct()
    own = edge_signatures(edges.where((F.col("from_id") == anchor_id) | (F.col("to_id") == anchor_id))).where(F.col("id") == anchor_id)
    structure = signature_overlap(edge_signatures(near).join(short.select("id"), "id", "left_semi"), own)
    scored = short.join(structure, "id", "left").withColumn("structural", F.coalesce("structural", F.lit(0.0)))
    return scored.withColumn("score", COSINE_WEIGHT * F.col("cosine") + STRUCTURE_WEIGHT * F.col("structural")).orderBy(F.desc("score"), "id").limit(budget)


def resolve_prefix(nodes: DataFrame, prefix: str, visible: Column | None = None) -> DataFrame:
    """(id): the one visible id with this hex prefix; no row if there are none or several."""
    found = nodes.where(F.startswith(F.col("id"), F.lit(prefix.lower())))
    found = found.where(visible) if visible is not None else found
    return found.select("id").distinct().limit(2).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id")


def verify(nodes: DataFrame, edges: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """Per node: signature posture, superseded_by, refuted_by, contradicted, trustworthy.

    Quarantined edges never count.  With readable repos, edges from other or absent nodes do not either.
    """
    into = edges.where("not quarantined and kind in ('Supersedes', 'Refutes', 'Contradicts')").select(F.col("to_id").alias("id"), "from_id", "kind")
    if readable is not None:
        far = nodes.select(F.col("id").alias("from_id"), "repo").join(readable.select("repo").distinct(), "repo", "left_semi")
        into = into.join(far.select("from_id"), "from_id", "left_semi")
    gathered = into.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "Supersedes", F.col("from_id")))).alias("superseded_by"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "Supersedes", F.col("from_id")))).alias("refuted_by"),
    )
    none = F.array().cast("array<string>")
    out = nodes.join(gathered, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("superseded_by", "refuted_by")})
    posture = F.when(F.col("plane") == "Derived", "derived").when(F.col("signature").isNull(), "missing").otherwise("signed")
    out = out.withColumns({"posture": posture, "contradicted": lattice.contradicted(F.col("confidence"))})
    sound = (F.col("posture") != "missing") & (F.size("superseded_by") == 0) & (F.size("refuted_by") == 0) & ~F.col("contradicted") & (F.col("status") == "Active")
    return out.withColumn("trustworthy", sound)


def verdict(nodes: DataFrame, edges: DataFrame, readable: DataFrame, most: int = 64) -> DataFrame:
    """(id, verdict): superseded, contradicted or current from the first `most` readable neighbours.

    Unlike verify(), a contradiction counts in either direction.
    """
    from pyspark.sql import Window

    out = edges.select(F.col("from_id").alias("id"), F.lit(0).alias("direction"), F.col("to_id").alias("far_id"), "kind", "quarantined")
    both = out.unionByName(edges.select(F.col("to_id").alias("id"), F.lit(1).alias("direction"), F.col("from_id").alias("far_id"), "kind", "quarantined"))
    far = nodes.select(F.col("id").alias("far_id"), F.col("repo").alias("far_repo"))
    seen = both.join(far, "far_id").join(readable.select(F.col("repo").alias("far_repo")).distinct(), "far_repo", "left_semi")
    order = Window.partitionBy("id").orderBy("direction", "far_id", edge_tag(F.col("kind")))
    near = seen.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & ~F.col("quarantined"))
    flags = near.groupBy("id").agg(
        F.bool_or((F.col("kind") == "Supersedes") & (F.col("direction") == 1)).alias("superseded"),
        F.bool_or(F.col("kind").isin("Contradicts", "Refutes")).alias("contradicted"),
    )
    state = F.when(F.coalesce("superseded", F.lit(False)) | (F.col("status") == "Superseded"), "superseded").when(F.coalesce("contradicted", F.lit(False)), "contradicted").otherwise("current")
    return nodes.join(flags, "id", "left").select("id", state.alias("verdict"))


def critique(shown: DataFrame, total: int, edges: DataFrame, nodes: DataFrame | None = None, readable: DataFrame | None = None) -> DataFrame:
    """(gap, id, n): what an answer may be missing.

    truncated (n: nodes of the tenant), superseded (n: how many shown are), and one gap for each shown
    node that is contradicted or has a quarantined edge (to a readable node, where readable is given).
    """
    size = shown.agg(F.count("*").alias("n")).where(F.col("n") < total).select(F.lit("truncated").alias("gap"), F.lit(None).cast("string").alias("id"), F.lit(total).cast("long").alias("n"))
    stale = shown.where("status = 'Superseded'").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("superseded").alias("gap"), F.lit(None).cast("string").alias("id"), "n")
    torn = shown.where(lattice.contradicted(F.col("confidence"))).select(F.lit("contradicted").alias("gap"), "id", F.lit(1).cast("long").alias("n"))
    loose = edges.where("quarantined")
    ends = loose.select(F.col("from_id").alias("id"), F.col("to_id").alias("far_id")).unionByName(loose.select(F.col("to_id").alias("id"), F.col("from_id").alias("far_id")))
    if readable is not None:
        seen = nodes.select(F.col("id").alias("far_id"), "repo").join(readable.select("repo").distinct(), "repo", "left_semi")
        ends = ends.join(seen, "far_id", "left_semi")
    near = shown.join(ends, "id", "left_semi").select(F.lit("adjacent_proposal").alias("gap"), "id", F.lit(1).cast("long").alias("n"))
    return size.unionByName(stale).unionByName(torn).unionByName(near)


def completeness(gaps: DataFrame) -> DataFrame:
    return gaps.agg((1 / (1 + F.count("*"))).alias("completeness"))


def canonical(nodes: DataFrame, edges: DataFrame, heads: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id): commits reachable from the heads (id) over the commit spine, heads included.

    labelled: the spine's labels (see lineage), where they are stored; without them they are made first.
    """
    spine = edges.where("kind in ('TemporalNext', 'MergeParent')").select("from_id", "to_id", "kind")
    if labelled is not None:
        return lineage.canonical(labelled, lineage.crossings(spine.distinct(), labelled), heads)
    numbers, tips, labelled, side = numbered(spine, heads.select("id"))
    found = lineage.canonical(labelled, side, tips)
    return numbers.join(found.withColumnRenamed("id", "n"), "n", "left_semi").select(unpacked(F.col("id")).alias("id"))


def numbered(spine: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, n) of the commits in spine and in marked (id, ...), with ids as bytes; and by number marked, the labels and the crossings.

    Labels that nobody keeps are made of numbers in place of ids, as each of their rounds shuffles them.
    """
    folder = shared_dir(spine.sparkSession)
    links = spine.select(packed(F.col("from_id")).alias("from_id"), packed(F.col("to_id")).alias("to_id"), "kind")
    marked = marked.withColumn("id", packed(F.col("id")))
    numbers = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).unionByName(marked.select("id")).distinct()
    numbers = _keep(numbers.select("id", F.monotonically_increasing_id().alias("n")), folder, "numbers")
    for end in ("from_id", "to_id"):
        links = links.join(numbers.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("n", end)
    links = _keep(links, folder, "spine")
    marked = _keep(marked.join(numbers, "id").drop("id").withColumnRenamed("n", "id"), folder, "heads")
    labelled = lineage.labels(links, marked.select("id"))
    return numbers, marked, labelled, lineage.crossings(links, labelled)


def in_flight(nodes: DataFrame, edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, branch): commits that a branch holds and the canonical history does not; active branches name them first."""
    branches = nodes.where("kind = 'branch'").select(F.col("id").alias("from_id"), F.when(F.col("status") == "Active", 0).otherwise(1).alias("rank"), F.regexp_replace(F.decode("content", "UTF-8"), "@[^@]*$", "").alias("branch"))
    held = edges.where("kind = 'BranchContains'").select("from_id", packed(F.col("to_id")).alias("id")).join(branches, "from_id").select("id", "rank", "from_id", "branch")
    held = held.join(merged.select(packed(F.col("id")).alias("id")), "id", "left_anti")
    return held.groupBy("id").agg(F.min_by("branch", F.struct("rank", "from_id")).alias("branch")).withColumn("id", unpacked(F.col("id")))


def passages(nodes: DataFrame, most: int = 2000) -> DataFrame:
    """(id, text, citation) of documents."""
    text = F.decode(F.col("content"), "UTF-8")
    return nodes.select("id", F.substring(text, 1, most).alias("text"), cite(F.col("source_ref"), text).alias("citation"))


def render(items: DataFrame, width: int = 72) -> DataFrame:
    """(id, line): a short line for each item."""
    mark = F.when(F.col("status") == "Active", "").otherwise(F.concat(F.lit(" ["), F.lower("status"), F.lit("]")))
    return items.select("id", F.concat(F.substring("id", 1, 12), F.lit("  "), truncate(F.regexp_replace("title", r"\s+", " "), width), mark).alias("line"))
