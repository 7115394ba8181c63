"""Ingest jobs over a versioned store: commits, branches, watermarks; and lookups of what is stored.

A job reads the store's tables as one manifest names them, derives the next ones as DataFrames, and commits them
together, so a job that dies changes nothing and one that runs again adds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.operators import corpus, graph, ingest, lineage, recall, supersede
from quillgraph.schema import lookup
from quillgraph.sources.delta import Store

NODES = "id string, repo string, kind string, plane string, author string, sha string, content binary, valid_from long, valid_to long, trust_tier string, status string"
EDGES = "from_id string, to_id string, kind string, quarantined boolean, at long"
META = "repo string, key string, value string, at long"
#: Kinds that a tool may ask for, and names beside their own (in snake case).
TOOL_EDGES = ("AnalogousTo", "Supersedes", "References", "DependsOn", "Implements", "Decides", "Refutes", "Contradicts", "CausedBy", "Motivates", "DerivedFrom", "AnchoredTo")
TOOL_EDGE_ALIASES = {"analogy": "AnalogousTo"}
TOOL_NODES = ("analogy_hypothesis", "doc", "finding", "blocker", "tech_debt", "work_package", "adr", "handoff", "benchmark", "agent_action")
TOOL_NODE_ALIASES = {"claim": "claim:confirmed", "analogy": "analogy_hypothesis", "note": "doc"}


# Lookups ---------------------------------------------------------------------------------------------------


def get_nodes(nodes: DataFrame, wanted: DataFrame, keyring: DataFrame | None = None) -> DataFrame:
    """The nodes of the ids (id); with a keyring (tenant, key) those of shredded tenants are absent."""
    found = nodes.join(wanted.select("id").distinct(), "id", "left_semi")
    return found if keyring is None else found.join(keyring.where("key is null").select(F.col("tenant").alias("repo")), "repo", "left_anti")


def have_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id) of those that are stored, also where their tenant has been shredded."""
    return wanted.select("id").distinct().join(nodes.select("id"), "id", "left_semi")


def edge_at(edges: DataFrame, from_id: str, to_id: str, kind: str) -> DataFrame:
    """The edge of one full key, or no row."""
    return edges.where((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("kind") == kind))


def embedding_models(nodes: DataFrame) -> DataFrame:
    """(repo, model): the model of each tenant's first embedded node by id."""
    return nodes.where("embedding is not null").groupBy("repo").agg(F.min_by("embedding.model", "id").alias("model"))


def meta_put(meta: DataFrame, fresh: DataFrame) -> DataFrame:
    """meta (repo, key, value, at) with fresh values over old ones; of several fresh ones of a key the latest."""
    last = fresh.groupBy("repo", "key").agg(F.max(F.struct("at", "value")).alias("m")).select("repo", "key", "m.value", "m.at")
    return meta.join(last.select("repo", "key"), ["repo", "key"], "left_anti").unionByName(last)


def meta_get(meta: DataFrame, key: str) -> DataFrame:
    """(repo, value, at) of a key in all tenants."""
    return meta.where(F.col("key") == key).select("repo", "value", "at")


def inserter_records(proposals: DataFrame, writer: str, at: int) -> DataFrame:
    """Rows of meta: who brought in each contesting proposal (repo, from_id, to_id, kind)."""
    own = proposals.where(F.col("kind").isin(*supersede.SECOND_PARTY) & F.col("quarantined"))
    return own.select("repo", F.concat_ws(":", F.lit("inserter"), "from_id", "to_id", "kind").alias("key"), F.lit(writer).alias("value"), F.lit(at).cast("long").alias("at"))


def blame(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "author", "plane", "trust_tier")


def edge_kind(text: Column) -> Column:
    """An edge kind from a tool's string, in any case, with or without _ between words; another one is an error."""
    snake = {re.sub("(?<=[a-z])(?=[A-Z])", "_", k).lower(): k for k in TOOL_EDGES}
    known = {**snake, **{k.replace("_", ""): v for k, v in snake.items()}, **TOOL_EDGE_ALIASES}
    found = lookup(F.lower(text), known)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no kind of edge: "), F.coalesce(text, F.lit("null")))))


def node_kind(text: Column) -> Column:
    """A node kind from a tool's string, likewise; an unknown one is a rationale."""
    known = {k: k for k in TOOL_NODES} | {k.replace("_", ""): k for k in TOOL_NODES if k != "analogy_hypothesis"} | TOOL_NODE_ALIASES
    return F.coalesce(lookup(F.lower(text), known), F.lit("rationale"))


def scene_filter(nodes: DataFrame, edges: DataFrame, shown: dict[str, list[str]], quarantined: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes whose columns hold one of the shown values, and the edges between them; proposals only if asked for."""
    for column, values in shown.items():
        nodes = nodes.where(F.col(column).isin(*values))
    return nodes, graph.inside(edges if quarantined else edges.where("not quarantined"), nodes)


def review_queues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(queue, id, other): proposals, confirmed supersessions, and nodes with a contradiction in their confidence."""
    loose = edges.where("quarantined").select(F.lit("proposals").alias("queue"), F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    firm = edges.where("not quarantined and kind = 'Supersedes'").select(F.lit("superseded").alias("queue"), F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    torn = nodes.where(F.exists("confidence", lambda c: c == 3)).select(F.lit("contradicted").alias("queue"), "id", F.lit(None).cast("string").alias("other"))
    return loose.unionByName(firm).unionByName(torn)


def strip_embeddings(nodes: DataFrame, kinds: tuple[str, ...] = ("branch",)) -> DataFrame:
    """nodes without the vectors of markers, which are never embedded; ids stay."""
    return nodes.withColumn("embedding", F.when(~F.col("kind").isin(*kinds), F.col("embedding")))


def backfill_embeddings(nodes: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """nodes with fresh vectors (id, data) where there is none of the model yet; markers stay bare, ids stay."""
    wanted = (F.col("kind") != "branch") & F.col("data").isNotNull() & ~F.coalesce(F.col("embedding.model") == model, F.lit(False))
    joined = nodes.join(fresh.select("id", F.col("data")), "id", "left")
    return joined.withColumn("embedding", F.when(wanted, F.struct(F.lit(model).alias("model"), F.col("data"))).otherwise(F.col("embedding"))).drop("data")


def grounded(hits: DataFrame, recent: DataFrame, most: int = 6) -> DataFrame:
    """(prompt, citations): up to six passages (id, text, citation) to ground an answer; recent ones if there are no hits."""
    some = hits.limit(most)
    some = recent.limit(most) if some.isEmpty() else some
    parts = F.array_sort(F.collect_list(F.struct("citation", "text")))
    return some.agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p["citation"], F.lit("] "), p["text"])), "\n\n").alias("prompt"), F.transform(parts, lambda p: p["citation"]).alias("citations"))


# Ingest ----------------------------------------------------------------------------------------------------


def commit_graph(commits: DataFrame, authorities: DataFrame, keep=lambda df, step: df, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of commits (repo, sha, parents, author, time_secs, subject, body).

    Ids are hashes of content.  Trailers that name a commit of the same repo are edges to it; the others lead to a
    stub of the reference, one for each name and repo.  keep(df, step) may store what several steps read; known
    (repo, sha, id): commits stored before, which parents and trailers may name.
    """
    content = F.encode(F.concat_ws("\n", "subject", "body"), "UTF-8")
    source = F.encode(F.concat(F.lit("git_commit|"), "repo", F.lit("|"), "sha"), "UTF-8")
    own = commits.withColumn("content", content).withColumn("source", F.decode(source, "UTF-8"))
    key = ids.sha2_id(ids.node_preimage(F.lit("Derived"), F.lit("commit"), F.col("repo"), F.col("author"), F.col("source"), F.col("content")))
    nodes = own.select(key.alias("id"), "repo", F.lit("commit").alias("kind"), F.lit("Derived").alias("plane"), "author", "sha", "content", (F.col("time_secs") * 1000).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit("DerivedDeterministic").alias("trust_tier"), F.lit("Active").alias("status"))
    named = nodes.select("repo", "sha", "id", "valid_from")
    ends = lambda rows: rows.join(named.select("repo", F.col("sha").alias("child"), F.col("id").alias("from_id"), F.col("valid_from").alias("at")), ["repo", "child"])
    target = named.select("repo", F.col("sha").alias("parent"), F.col("id").alias("to_id"))
    if known is not None:
        wanted = commits.select("repo", F.explode("parents").alias("parent")).unionByName(ingest.trailer_edges(commits, authorities).join(commits.select("repo", "sha"), "sha").select("repo", F.col("target").alias("parent"))).distinct()
        older = known.select("repo", F.col("sha").alias("parent"), F.col("id").alias("to_id")).join(wanted, ["repo", "parent"], "left_semi").join(target, ["repo", "parent"], "left_anti")
        target = keep(target.unionByName(older), "targets")
    repo_of = commits.select("repo", F.col("sha").alias("child"))
    lines = ends(ingest.spine(commits).join(repo_of, "child")).join(target, ["repo", "parent"])
    said = ends(keep(ingest.trailer_edges(commits, authorities), "trailers").join(commits.select("repo", "sha"), "sha").withColumnRenamed("sha", "child")).join(target.withColumnRenamed("parent", "target"), ["repo", "target"], "left")
    stub = ids.sha2_id(F.encode(F.concat(F.lit("ref:"), "repo", F.lit("|"), "target"), "UTF-8"))
    stubs = said.where("to_id is null").groupBy("repo", "target").agg(F.min("at").alias("at")).select(stub.alias("id"), "repo", F.lit("doc").alias("kind"), F.lit("Derived").alias("plane"), F.lit("ref").alias("author"), F.concat(F.lit("ref:"), "target").alias("sha"), F.encode("target", "UTF-8").alias("content"), F.col("at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit("DerivedDeterministic").alias("trust_tier"), F.lit("Active").alias("status"))
    edges = lines.select("from_id", "to_id", "kind", F.lit(False).alias("quarantined"), "at").unionByName(said.select("from_id", F.coalesce("to_id", stub).alias("to_id"), "kind", "quarantined", "at"))
    return nodes.unionByName(stubs), edges.dropDuplicates(["from_id", "to_id", "kind"])


def pending_commits(commits: DataFrame, heads: DataFrame, marks: DataFrame) -> DataFrame:
    """(sha): commits (sha, parents) that the heads (repo, head) reach and what was ingested before does not.

    A watermark (repo, head) counts only while its repo's new head still reaches it; on rewritten history, or without
    one, all of the repo's commits are due.  All repos are walked at once.
    """
    spine = ingest.spine(commits).select(F.col("child").alias("from_id"), F.col("parent").alias("to_id"), "kind")
    # The history is labelled once for both walks.
    tips = heads.select("repo", F.col("head").alias("id"), F.lit(True).alias("tip"))
    numbers, marked, labelled, side = recall.numbered(spine, tips.unionByName(marks.select("repo", F.col("head").alias("id"), F.lit(False).alias("tip"))))
    all_of_it = lineage.canonical(labelled, side, marked.where("tip"))
    held = marked.where("not tip").join(all_of_it, "id", "left_semi").join(marked.where("tip").select("repo"), "repo", "left_semi")
    done = lineage.canonical(labelled, side, held)
    due = all_of_it.join(done, "id", "left_anti").withColumnRenamed("id", "n")
    return numbers.join(due, "n", "left_semi").select(ids.unpacked(F.col("id")).alias("sha"))


def due_commits(commits: DataFrame, heads: DataFrame, held: DataFrame) -> DataFrame:
    """Those of commits (repo, sha, parents) that the heads (repo, head) reach through commits that are not held (repo, sha).

    What is stored has all of its history stored, so the walk ends there and its cost follows the push.
    """
    fresh = commits.join(held.select("repo", "sha").hint("merge"), ["repo", "sha"], "left_anti")
    spine = ingest.spine(fresh).select(F.col("child").alias("from_id"), F.col("parent").alias("to_id"), "kind")
    return fresh.join(recall.canonical(fresh, spine, heads.select(F.col("head").alias("id"))).select(F.col("id").alias("sha")), "sha", "left_semi")


def document_changes(docs: DataFrame, nodes: DataFrame, now: int, keep=lambda df, step: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (repo, path, git_sha, text) against the stored nodes: new nodes, their edges, and stored ones that are gone.

    All repos of docs are derived anew and compared by content id: what is stored stays as it is, what has vanished from its
    repo is archived.  Directives that name a commit or a stub of the repo lead to it, the others to a new stub.
    """
    found, said = corpus.document_graph(docs)
    state = F.lit(None).cast("long").alias("valid_to"), F.lit("DerivedDeterministic").alias("trust_tier")
    own = keep(found.select("id", "repo", "kind", F.lit("Derived").alias("plane"), "author", F.concat(F.lit("doc:"), "path").alias("sha"), "content", F.coalesce("created_ms", F.lit(now)).cast("long").alias("valid_from"), *state, "status").dropDuplicates(["id"]), "documents")
    held = nodes.where("startswith(sha, 'doc:')").join(docs.select("repo").distinct(), "repo", "left_semi")
    # What is stored, and what is new of a push, may be large whatever the planner takes it for: merged, not broadcast.
    fresh = own.join(held.select("id").hint("merge"), "id", "left_anti")
    gone = held.where("status <> 'Archived'").join(own.select("id"), "id", "left_anti").withColumn("status", F.lit("Archived"))
    said = keep(said.join(fresh.select(F.col("id").alias("from_id"), "repo", F.col("valid_from").alias("at")).hint("merge"), "from_id"), "directives")
    named = nodes.select("repo", F.regexp_replace("sha", "^ref:", "").alias("target"), F.col("id").alias("to_id")).join(said.select("repo", "target").distinct(), ["repo", "target"], "left_semi").groupBy("repo", "target").agg(F.min("to_id").alias("to_id"))
    led = said.join(named, ["repo", "target"], "left")
    stub = ids.sha2_id(F.encode(F.concat(F.lit("ref:"), "repo", F.lit("|"), "target"), "UTF-8"))
    stubs = led.where("to_id is null").groupBy("repo", "target").agg(F.min("at").alias("valid_from")).select(stub.alias("id"), "repo", F.lit("doc").alias("kind"), F.lit("Derived").alias("plane"), F.lit("ref").alias("author"), F.concat(F.lit("ref:"), "target").alias("sha"), F.encode("target", "UTF-8").alias("content"), "valid_from", *state, F.lit("Active").alias("status"))
    links = led.select("from_id", F.coalesce("to_id", stub).alias("to_id"), "kind", "quarantined", "at").dropDuplicates(["from_id", "to_id", "kind"])
    return fresh.unionByName(stubs.select(*fresh.columns)), links, gone


def open_store(spark, path: str) -> Store:
    """The tables of ingest jobs under a path."""
    return Store(spark, path, {"nodes": ["id"], "edges": ["from_id", "to_id", "kind"], "meta": ["repo", "key"], "labels": ["id"]})


def run_ingest(store: Store, commits: DataFrame, heads: DataFrame, authorities: DataFrame, now: int, docs: DataFrame | None = None, compact_after: int = 16) -> dict[str, int]:
    """Brings a store up to the heads (repo, head): new commits, their edges, documents, supersessions and watermarks, in one commit.

    commits may be the whole history or what is new in it; docs (repo, path, git_sha, text) are all documents of their repos
    now.  Only new and changed rows are written.  Returns how many commits were due, supersessions refused, and
    documents new and gone.
    """
    number, _ = store.state()
    nodes, edges, meta = store.read("nodes", NODES), store.read("edges", EDGES), store.read("meta", META)
    spark, folder = commits.sparkSession, graph.shared_dir(commits.sparkSession)

    def keep(df, step):
        """Each is read by several of the steps after it."""
        return graph.unsent(graph._keep(df, folder, step), graph.stored_bytes(spark, f"{folder}/{step}"))

    due = keep(due_commits(commits, heads, nodes.where("kind = 'commit'")), "due")
    found, links = commit_graph(due, authorities, keep, nodes.where("kind = 'commit'").select("repo", "sha", "id"))
    gone = None
    if docs is not None:
        named = nodes.unionByName(keep(found, "commits"))
        more, directives, gone = document_changes(docs, named, now, keep)
        found, links, gone = found.unionByName(more.select(*found.columns)), links.unionByName(directives), keep(gone, "gone")
    fresh = keep(found.dropDuplicates(["id"]).join(nodes.select("id").hint("merge"), "id", "left_anti"), "fresh")
    links = keep(links, "links")
    claims = links.where("kind = 'Supersedes'")
    known = nodes.unionByName(fresh)
    # Only the ends of what is claimed can matter.
    ends = claims.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    judged = keep(supersede.judge(keep(known.join(ends, "id", "left_semi"), "ends"), edges, claims), "judged")
    refused = judged.where("reason is not null and reason <> 'quarantined'")
    kept = links.join(refused.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")
    hit = judged.where("reason is null").select(F.col("to_id").alias("id")).distinct()
    if gone is not None:
        known = known.join(gone.select("id"), "id", "left_anti").unionByName(gone.select(*known.columns))
    turned = supersede.apply_supersessions(known.join(hit, "id", "left_semi"), judged).select(*nodes.columns)
    rest = fresh.select(*nodes.columns) if gone is None else fresh.select(*nodes.columns).unionByName(gone.select(*nodes.columns))
    changes = {"nodes": rest.join(hit, "id", "left_anti").select(*nodes.columns).unionByName(turned)}
    # A proposal never takes the place of a confirmed edge.
    firm = edges.where("not quarantined").join(kept.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_semi").select("from_id", "to_id", "kind")
    changes["edges"] = kept.where("not quarantined").unionByName(kept.where("quarantined").join(firm, ["from_id", "to_id", "kind"], "left_anti").select(*kept.columns)).select(*edges.columns)
    changes["meta"] = heads.select("repo", F.lit("watermark").alias("key"), F.col("head").alias("value"), F.lit(now).cast("long").alias("at"))
    # Labels of the new commits, from those of their parents.
    own = fresh.where("kind = 'commit'").select("id")
    changes["labels"] = lineage.labels(links.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi"), own, store.read("labels", lineage.LABELS))
    counts = {"commits": due.count(), "refused": refused.count()}
    if docs is not None:
        counts |= {"documents": fresh.where("startswith(sha, 'doc:')").count(), "gone": gone.count()}
    store.commit(changes, based_on=number)
    for name in changes:
        store.compact(name, compact_after)
    graph.drop_folder(spark, folder)
    return counts


def chain_node_id(repo: Column, kind: str, key: Column, content: Column) -> Column:
    return ids.sha2_id(ids.node_preimage(F.lit("Derived"), F.lit(kind), repo, F.lit("chain"), key, content))


def chain_graph(blocks: DataFrame, watched: DataFrame, stored: DataFrame, contracts: DataFrame, chain_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of blocks (number, hash, parent_hash, at_ms, transactions array<struct<hash, from, to, value>>).

    A checkpoint a block and an event a transaction that touches a watched address; from a checkpoint to the one before it where
    the hashes chain, to its events (Emits), from an event to each contract (address, id) on either side of it (Touches), and over
    a stored checkpoint (number, hash) of its height with another hash (Supersedes).
    """
    repo = F.lit(f"chain:{chain_id}")
    block_key = lambda number, hash_: F.concat(repo, F.lit("/block/"), number.cast("string"), F.lit("@"), hash_)
    state = F.lit(None).cast("long").alias("valid_to"), F.lit("DerivedDeterministic").alias("trust_tier"), F.lit("Active").alias("status")
    found = ingest.block_walk(blocks, watched, stored)
    # A checkpoint is named by its height and hash alone, so that the id of a stored one is known without reading it.
    at = lambda number, hash_: chain_node_id(repo, "chain_checkpoint", block_key(number, hash_), F.lit(""))
    b, h = F.col("number"), F.col("hash")
    told = F.concat(F.lit("block "), b.cast("string"), F.lit(f" on chain {chain_id} hash "), h, F.lit(" parent "), F.coalesce("parent_hash", F.lit("")))
    points = blocks.dropDuplicates(["number", "hash"]).select(at(b, h).alias("id"), repo.alias("repo"), F.lit("chain_checkpoint").alias("kind"), F.lit("Derived").alias("plane"), F.lit("chain").alias("author"), block_key(b, h).alias("sha"), F.encode(told, "UTF-8").alias("content"), F.col("at_ms").alias("valid_from"), *state)
    tx = blocks.select("number", h.alias("block"), "at_ms", F.explode("transactions").alias("t")).join(found["events"].select("number", "block", F.col("tx").alias("txh")).distinct(), (F.col("t.hash") == F.col("txh")), "left_semi")
    event_key = F.concat(repo, F.lit("/tx/"), F.col("t.hash"))
    event = chain_node_id(repo, "chain_event", event_key, F.lit(""))
    said = F.concat(F.lit("tx "), F.col("t.hash"), F.lit(": "), F.col("t.from"), F.lit(" -> "), F.coalesce("t.to", F.lit("create")), F.lit(" in block "), b.cast("string"), F.lit(f" on chain {chain_id}"))
    events = tx.select(event.alias("id"), repo.alias("repo"), F.lit("chain_event").alias("kind"), F.lit("Derived").alias("plane"), F.lit("chain").alias("author"), event_key.alias("sha"), F.encode(said, "UTF-8").alias("content"), F.col("at_ms").alias("valid_from"), *state).dropDuplicates(["id"])
    firm = F.lit(False).alias("quarantined"), F.lit(now).cast("long").alias("at")
    spine = found["spine"].select(at(b, h).alias("from_id"), at(b - 1, F.col("before")).alias("to_id"), F.lit("TemporalNext").alias("kind"), *firm)
    emits = tx.select(at(b, F.col("block")).alias("from_id"), event.alias("to_id"), F.lit("Emits").alias("kind"), *firm)
    sides = tx.select(event.alias("from_id"), F.explode(F.array_distinct(F.array_compact(F.array(F.lower("t.from"), F.lower("t.to"))))).alias("address"))
    touches = sides.join(contracts.select(F.lower("address").alias("address"), F.col("id").alias("to_id")), "address").select("from_id", "to_id", F.lit("Touches").alias("kind"), *firm)
    over = found["orphans"].select(at(b, F.col("by")).alias("from_id"), at(b, F.col("orphan")).alias("to_id"), F.lit("Supersedes").alias("kind"), *firm)
    return points.unionByName(events), spine.unionByName(emits).unionByName(touches).unionByName(over).dropDuplicates(["from_id", "to_id", "kind"])


def walk_chain(store: Store, blocks: DataFrame, watched: DataFrame, contracts: DataFrame, chain_id: int, now: int, from_block: int | None = None) -> dict[str, int]:
    """Lands a chain's blocks from a height on (by default where the last walk ended) with events, edges, re-orgs and the cursor, in one commit."""
    number, _ = store.state()
    nodes, edges, meta = store.read("nodes", NODES), store.read("edges", EDGES), store.read("meta", META)
    repo = f"chain:{chain_id}"
    if from_block is None:
        mark = meta.where((F.col("repo") == repo) & (F.col("key") == "cursor")).first()
        from_block = int(mark["value"]) if mark else 0
    folder = graph.shared_dir(blocks.sparkSession)
    keep = lambda df, step: graph._keep(df, folder, step)
    due = keep(blocks.where(F.col("number") >= from_block), "due")
    own = nodes.where((F.col("repo") == repo) & (F.col("kind") == "chain_checkpoint") & (F.col("status") == "Active"))
    height = F.regexp_extract("sha", r"/block/(\d+)@", 1).cast("long")
    held = own.where(height >= from_block - 1).select(height.alias("number"), F.regexp_extract("sha", "@(.*)$", 1).alias("hash"))
    found, links = chain_graph(due, watched, keep(held, "held"), contracts, chain_id, now)
    found, links = keep(found, "found"), keep(links, "links")
    fresh = keep(found.join(nodes.select("id"), "id", "left_anti"), "fresh")
    claims = links.where("kind = 'Supersedes'")
    ends = claims.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    known = nodes.unionByName(fresh.select(*nodes.columns))
    judged = keep(supersede.judge(keep(known.join(ends, "id", "left_semi"), "ends"), edges, claims), "judged")
    hit = judged.where("reason is null").select(F.col("to_id").alias("id")).distinct()
    turned = supersede.apply_supersessions(known.join(hit, "id", "left_semi"), judged).select(*nodes.columns)
    kept = links.join(judged.where("reason is not null").select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")
    last = due.agg(F.max("number").alias("n")).first()["n"]
    cursor = blocks.sparkSession.createDataFrame([] if last is None else [(repo, "cursor", str(last + 1), now)], META)
    counts = {"blocks": due.count(), "events": fresh.where("kind = 'chain_event'").count(), "reorgs": turned.count(), "rejected": judged.where("reason is not null").count()}
    store.commit({"nodes": fresh.join(hit, "id", "left_anti").select(*nodes.columns).unionByName(turned), "edges": kept.select(*edges.columns), "meta": cursor}, based_on=number)
    graph.drop_folder(blocks.sparkSession, folder)
    return counts


def branch_graph(branches: DataFrame, commits: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A marker for each branch (repo, name, tip) and BranchContains edges (from_id, sha) to the commits that only it has.

    merged: (sha) of the default branch's history.
    """
    key = ids.sha2_id(F.encode(F.concat(F.lit("branch:"), "repo", F.lit("|"), "name", F.lit("@"), "tip"), "UTF-8"))
    marks = branches.select(key.alias("id"), "repo", F.lit("branch").alias("kind"), "name", "tip", F.encode(F.concat("name", F.lit("@"), "tip"), "UTF-8").alias("content"), F.lit("Active").alias("status"))
    spine = ingest.spine(commits).select(F.col("child").alias("from_id"), F.col("parent").alias("to_id"))
    held = merged.select(F.col("sha").alias("to_id"))
    own = spine.join(held, "to_id", "left_anti")  # a walk ends where the default branch begins
    tips = branches.select(F.col("tip").alias("id")).distinct()
    reach = graph.reachable_pairs(own, tips).unionByName(tips.select(F.col("id").alias("start"), "id")).join(merged.select(F.col("sha").alias("id")), "id", "left_anti")
    return marks, marks.select(F.col("id").alias("from_id"), "tip").join(reach.withColumnsRenamed({"start": "tip", "id": "sha"}), "tip").select("from_id", "sha")


def run_branches(store: Store, branches: DataFrame, commits: DataFrame, merged: DataFrame, now: int) -> dict[str, int]:
    """Brings the branches (repo, name, tip) of a store up to date, in one commit: a marker, the commits that only it has, and edges
    to them, for each branch whose tip is not the one of its watermark; then the watermarks.

    merged: (sha) of the default branches' histories.  A branch without commits of its own gets a watermark alone.  Trailers of
    commits in flight are not read; they are once the commits are merged.
    """
    number, _ = store.state()
    nodes, edges, meta = store.read("nodes", NODES), store.read("edges", EDGES), store.read("meta", META)
    folder = graph.shared_dir(branches.sparkSession)
    keep = lambda df, step: graph._keep(df, folder, step)
    key = F.concat(F.lit("branch:"), "name")
    marks = meta.where("startswith(key, 'branch:')").select("repo", F.col("key"), F.col("value").alias("tip"))
    due = keep(branches.withColumn("key", key).join(marks, ["repo", "key", "tip"], "left_anti").select("repo", "name", "tip", "key"), "due")
    found, held = branch_graph(due.drop("key"), commits, merged)
    held = keep(held, "held")
    marked = found.join(held.select(F.col("from_id").alias("id")), "id", "left_semi")
    state = F.lit(None).cast("long").alias("valid_to"), F.lit("DerivedDeterministic").alias("trust_tier"), "status"
    marked = keep(marked.select("id", "repo", "kind", F.lit("Derived").alias("plane"), F.lit("branch").alias("author"), F.concat(F.lit("branch:"), "name", F.lit("@"), "tip").alias("sha"), "content", F.lit(now).cast("long").alias("valid_from"), *state), "markers")
    own = keep(commits.join(held.select("sha").distinct(), "sha", "left_semi"), "own")
    nobody = branches.sparkSession.createDataFrame([], "author string")
    made, links = commit_graph(own, nobody, keep, nodes.where("kind = 'commit'").select("repo", "sha", "id"))
    made = keep(made.where("kind = 'commit'"), "commits")
    links = links.where(F.col("kind").isin(*lineage.SPINE))
    known = made.select("repo", "sha", "id").unionByName(nodes.where("kind = 'commit'").select("repo", "sha", "id")).distinct()
    contains = held.join(marked.select(F.col("id").alias("from_id"), "repo"), "from_id").join(known, ["repo", "sha"]).select("from_id", F.col("id").alias("to_id"), F.lit("BranchContains").alias("kind"), F.lit(False).alias("quarantined"), F.lit(now).cast("long").alias("at"))
    fresh = made.select(*nodes.columns).unionByName(marked.select(*nodes.columns)).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns)
    counts = {"branches": marked.count(), "commits": own.count(), "unchanged": branches.count() - marked.count()}
    put = due.select("repo", "key", F.col("tip").alias("value"), F.lit(now).cast("long").alias("at"))
    store.commit({"nodes": fresh, "edges": links.unionByName(contains).select(*edges.columns), "meta": put}, based_on=number)
    graph.drop_folder(branches.sparkSession, folder)
    return counts


def reap_branches(nodes: DataFrame, live: DataFrame, merged: DataFrame) -> DataFrame:
    """nodes with the markers of branches that are deleted, moved on or merged archived; nodes: (id, name, tip, status, ...)."""
    states = ingest.branch_states(nodes.where("status = 'Active'").select("id", "name", "tip"), live, merged)
    return supersede.set_status(nodes, states.where("state <> 'active'").select("id"), "Archived")
