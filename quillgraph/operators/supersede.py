"""Writes as set operations: supersession, confirmation, upserts and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import packed, unpacked
from quillgraph.operators.anchor import positions
from quillgraph.operators.cycles import admitted, strong_components
from quillgraph.operators.graph import _keep, drop_folder, shared_dir
from quillgraph.schema import edge_tag

SECOND_PARTY = ("Supersedes", "Refutes", "Contradicts")
AUTHORITY = ("Supersedes", "Refutes")


def assertable() -> Column:
    """Whether a signed write may carry a node's plane and tier."""
    return (F.col("plane") == "Asserted") & F.col("trust_tier").isin("AgentAsserted", "InferredAdvisory")


def _judged(nodes: DataFrame, edges: DataFrame, proposals: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """proposals with `reason`: `cycle` for all that lie on one or, with an order, for those that close one when tried in it.

    Only supersessions that may apply are looked up.  Each node has a number, so that the search for cycles shuffles pairs of
    longs and not of ids; what it finds comes back by the proposal's row.
    """
    spark, folder = nodes.sparkSession, shared_dir(nodes.sparkSession)
    early = F.when(F.col("kind") != "Supersedes", "kind").when(F.col("quarantined"), "quarantined").when(F.col("from_id") == F.col("to_id"), "self")
    # Ids as bytes, as all that fits is shuffled by its row.
    fit = _keep(ends_packed(proposals.where(early.isNull())).withColumn("_row", F.monotonically_increasing_id()), folder, "fit")
    # Never null here, so that a filter for what may apply drops this side.
    rest = proposals.where(early.isNotNull()).withColumn("reason", F.coalesce(early, F.lit("kind")))
    # Without proposals there is nothing to find, however much is stored.
    if fit.isEmpty():
        return rest
    coded = _numbered(nodes, edges, fit, folder)
    pairs = lambda df: df.select("from_id", "to_id")
    stored, asked = pairs(coded.where("_row is null")), coded.where("_row is not null and reason is null")
    # A proposal closes a cycle, alone or with others, if both of its ends lie in one component.
    comps = strong_components(stored.unionByName(pairs(asked)))
    loops = asked.join(comps.withColumnsRenamed({"id": "from_id", "scc": "_a"}), "from_id").join(comps.withColumnsRenamed({"id": "to_id", "scc": "_z"}), "to_id").where("_a = _z")
    loops = _keep(loops.select("_row", "from_id", "to_id"), folder, "loops")
    if order is not None and not loops.isEmpty():
        ends = loops.select("_row", F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
        # Unpacked before they are put in order: bytes sort like digests, but not like other texts.
        tried = ends_unpacked(fit.select("_row", *dict.fromkeys((*order, "from_id", "to_id"))).join(ends, "_row"))
        tried = tried.groupBy("_from", "_to").agg(*[F.min(c).alias(c) for c in dict.fromkeys((*order, "from_id", "to_id"))])
        places = positions(tried, [*dict.fromkeys((*order, "from_id", "to_id"))], "place").select(F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), "place")
        loops = loops.join(admitted(stored, places, comps), ["from_id", "to_id"], "left_anti")
    barred = coded.where("_row is not null and reason is not null").select("_row", "reason").unionByName(loops.select("_row", F.lit("cycle").alias("reason")))
    barred = _keep(barred, folder, "barred")
    for name in ("coded", "loops"):
        drop_folder(spark, f"{folder}/{name}")
    return ends_unpacked(fit.join(barred, "_row", "left")).select(*proposals.columns, "reason").unionByName(rest)


def _numbered(nodes: DataFrame, edges: DataFrame, fit: DataFrame, folder: str) -> DataFrame:
    """(_row, from_id, to_id, reason): the proposals (fit, with ids as bytes) and, without _row, the confirmed supersessions by the
    numbers of their ends; reason: of proposals, `missing` and `plane`."""
    numbers = _keep(nodes.select(packed(F.col("id")).alias("id"), "plane", F.monotonically_increasing_id().alias("n")), folder, "numbers")
    none = F.lit(None).cast("string")
    own = F.col("plane") if "plane" in fit.columns else none
    both = fit.select("from_id", "to_id", "_row", own.alias("own")).unionByName(ends_packed(_firm(edges)).select("from_id", "to_id", F.lit(None).cast("long").alias("_row"), none.alias("own")))
    both = both.withColumnsRenamed({"from_id": "from", "to_id": "to"})
    for end in ("from", "to"):
        both = both.join(numbers.select(F.col("id").alias(end), F.col("plane").alias(f"_{end}"), F.col("n").alias(f"{end}_id")), end, "left")
        both = both.withColumn(end, F.when(F.col(f"{end}_id").isNull(), F.col(end)))
    asserted = (F.col("own") if "plane" in fit.columns else F.col("_from")) == "Asserted"
    reason = F.when(F.col("_from").isNull() | F.col("_to").isNull(), "missing").when(asserted & (F.col("_to") == "Derived"), "plane")
    coded = _keep(both.select("_row", "from_id", "to_id", "from", "to", F.when(F.col("_row").isNotNull(), reason).alias("reason")), folder, "coded")
    drop_folder(nodes.sparkSession, f"{folder}/numbers")
    # Stored supersessions may lead through ids that are no nodes: these get numbers below zero.
    gaps = coded.where("_row is null").select(F.explode(F.array("from", "to")).alias("id")).where("id is not null").distinct()
    gaps = _keep(gaps.select("id", (-1 - F.monotonically_increasing_id()).alias("n")), folder, "gaps")
    if not gaps.isEmpty():
        for end in ("from", "to"):
            coded = coded.join(gaps.select(F.col("id").alias(end), F.col("n").alias("_n")), end, "left").withColumn(f"{end}_id", F.coalesce(f"{end}_id", "_n")).drop("_n")
    return coded.select("_row", "from_id", "to_id", "reason")


def _firm(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'Supersedes' and not quarantined")


def spine(edges: DataFrame) -> DataFrame:
    """(from_id, to_id) of the confirmed supersessions."""
    return _firm(edges).select("from_id", "to_id").distinct()


def reject_reasons(nodes: DataFrame, edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals (from_id, to_id, kind, quarantined, at) with `reason`, null if the supersession may apply whatever the order.

    An asserted supersession must not retire a derived node: by the proposal's own plane where it has that column, else by
    that of the node it comes from.
    """
    return _judged(nodes, edges, proposals)


def judge(nodes: DataFrame, edges: DataFrame, proposals: DataFrame, order: tuple[str, ...] = ("at", "from_id", "to_id")) -> DataFrame:
    """reject_reasons with the proposals on cycles tried one by one in an order: those that close one stay rejected.

    The components are found once; each is decided on its own, so unrelated cycles do not wait for one another.
    """
    return _judged(nodes, edges, proposals, order)


def apply_supersessions(nodes: DataFrame, judged: DataFrame, order: tuple[str, ...] = ("at", "from_id")) -> DataFrame:
    """nodes after the accepted supersessions: active targets become Superseded, valid_to = max(at, valid_from).

    Of several edges to a target the first in an order sets the time; the others change nothing.
    """
    first = judged.where("reason is null").groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct(*dict.fromkeys((*order, "at")))).alias("by"))
    hit = nodes.join(first, "id", "left")
    now = (F.col("status") == "Active") & F.col("by").isNotNull()
    return hit.withColumn("valid_to", F.when(now, F.greatest(F.col("by.at"), F.col("valid_from"))).otherwise(F.col("valid_to"))).withColumn("status", F.when(now, "Superseded").otherwise(F.col("status"))).drop("by")


def clock(edges: DataFrame) -> Column:
    """An edge's time: its column `at`, or that of its provenance."""
    return F.col("at") if "at" in edges.columns else F.col("provenance.at")


def confirm(edges: DataFrame, keys: DataFrame, at: int) -> DataFrame:
    """edges with those of the keys out of quarantine; a Supersedes edge gets the clock of its confirmation."""
    marked = edges.join(keys.select("from_id", "to_id", "kind").distinct().withColumn("hit", F.lit(True)), ["from_id", "to_id", "kind"], "left")
    hit = F.coalesce("hit", F.lit(False)) & F.col("quarantined")
    now = hit & (F.col("kind") == "Supersedes")
    if "at" in edges.columns:
        marked = marked.withColumn("at", F.when(now, F.lit(at).cast("long")).otherwise(F.col("at")))
    elif "provenance" in edges.columns:
        marked = marked.withColumn("provenance", F.when(now, F.col("provenance").withField("at", F.lit(at).cast("long"))).otherwise(F.col("provenance")))
    return marked.withColumn("quarantined", F.col("quarantined") & ~hit).drop("hit").select(*edges.columns)


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored with incoming by key; an incoming proposal never replaces a confirmed edge."""
    keys, columns = ["from_id", "to_id", "kind"], stored.columns
    # Ids as bytes: what is stored is shuffled whole.
    stored, incoming = ends_packed(stored), ends_packed(incoming)
    firm = stored.where("not quarantined").select(*keys)
    allowed = incoming.where("not quarantined").unionByName(incoming.where("quarantined").join(firm, keys, "left_anti"))
    return ends_unpacked(stored.join(allowed.select(*keys), keys, "left_anti").unionByName(allowed)).select(*columns)


def ends_packed(edges: DataFrame) -> DataFrame:
    """edges with their ends as bytes, see ids.packed."""
    return edges.withColumns({c: packed(F.col(c)) for c in ("from_id", "to_id")})


def ends_unpacked(edges: DataFrame) -> DataFrame:
    return edges.withColumns({c: unpacked(F.col(c)) for c in ("from_id", "to_id")})


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.join(incoming.select("id"), "id", "left_anti").unionByName(incoming)


def inserter_key() -> Column:
    """The meta key under which it is kept who brought in a contesting proposal."""
    return F.concat_ws(":", F.lit("inserter"), "from_id", "to_id", "kind")


def confirm_outcomes(nodes: DataFrame, edges: DataFrame, keys: DataFrame, at: int, writer: str | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, kind, outcome) for the keys: confirmed, already confirmed, not found, second party, or a guard's reason.

    With meta (repo, key, value, at), a proposal that supersedes, refutes or contradicts a node is confirmed by its author, or by
    a writer who neither inserted it (as meta has it) nor signed it; without a record of who inserted it, by the author alone,
    and never without a writer.  Without meta nobody is asked.  Supersessions go through judge() at the confirmation's clock.
    """
    columns = ["from_id", "to_id", "kind"]
    asserter = F.col("asserter") if "asserter" in edges.columns else F.col("provenance.asserter") if "provenance" in edges.columns else F.lit(None).cast("string")
    stored = edges.select(*columns, "quarantined", asserter.alias("_signer"), *(["plane"] if "plane" in edges.columns else []))
    asked = ends_unpacked(ends_packed(keys.select(*columns)).distinct().join(ends_packed(stored), columns, "left"))
    state = F.when(F.col("quarantined").isNull(), "not found").when(~F.col("quarantined"), "already confirmed")
    if meta is not None:
        asked = asked.join(nodes.select(F.col("id").alias("to_id"), F.col("author").alias("_author")), "to_id", "left")
        held = meta.where(F.startswith("key", F.lit("inserter:"))).groupBy(F.col("key").alias("_key")).agg(F.max_by("value", "at").alias("_inserter"))
        asked = asked.withColumn("_key", inserter_key()).join(held, "_key", "left").drop("_key")
        who = F.lit(writer).cast("string")
        allowed = F.coalesce(may_confirm(who, F.col("_author"), F.col("_inserter"), F.col("_signer")), F.lit(False)) & who.isNotNull()
        state = state.when(F.col("kind").isin(*SECOND_PARTY) & ~allowed, "second party")
    asked = asked.withColumn("_state", state).drop("_author", "_inserter", "_signer")
    folder = shared_dir(nodes.sparkSession)
    asked = _keep(asked, folder, "asked")
    ask = asked.where("_state is null and kind = 'Supersedes'").drop("_state").withColumns({"quarantined": F.lit(False), "at": F.lit(at).cast("long")})
    judged = judge(nodes, edges, ask).select(*columns, "reason")
    out = asked.join(judged, columns, "left")
    return _keep(out.select(*columns, F.coalesce("_state", "reason", F.lit("confirmed")).alias("outcome")), folder, "outcomes")


def confirm_and_apply(nodes: DataFrame, edges: DataFrame, keys: DataFrame, at: int, writer: str | None = None, meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph with the proposals of the keys confirmed: those that supersede go through the guards and, where they pass, retire
    their targets at the confirmation's clock; where they do not, they stay proposals."""
    return apply_outcomes(nodes, edges, confirm_outcomes(nodes, edges, keys, at, writer, meta), at)


def apply_outcomes(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Graph with what confirm_outcomes has confirmed."""
    fine = outcomes.where("outcome = 'confirmed'")
    retired = fine.where("kind = 'Supersedes'").select("from_id", "to_id", F.lit(at).cast("long").alias("at"), F.lit(None).cast("string").alias("reason"))
    return apply_supersessions(nodes, retired), confirm(edges, fine, at)


def set_status(nodes: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def may_confirm(writer: Column, author: Column, inserter: Column, signer: Column) -> Column:
    """The node's author, or a writer who neither inserted nor signed the proposal; who inserted it must be known."""
    return writer.eqNullSafe(author) | (inserter.isNotNull() & ~writer.eqNullSafe(inserter) & ~writer.eqNullSafe(signer))


def effective_status(nodes: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(id, effective): a node's status as of a cutoff; not yet there is `future`, and a supersession counts
    only if its successor was there."""
    later = nodes.select(F.col("id").alias("from_id"), F.col("valid_from").alias("successor_from"))
    by = edges.where("kind = 'Supersedes' and not quarantined").join(later, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("successor_from").alias("successor_from"))
    undone = (F.col("status") == "Superseded") & (F.col("successor_from") > cutoff)
    state = F.when(F.col("valid_from") > cutoff, "future").when(undone, "Active").otherwise(F.col("status"))
    return nodes.join(by, "id", "left").select("id", state.alias("effective"))


def ordered(edges: DataFrame) -> DataFrame:
    """Edges in storage order."""
    return edges.orderBy("from_id", "to_id", edge_tag(F.col("kind")))
