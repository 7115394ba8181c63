"""More named queries: lookups, text rules, ids, layouts and the checks of writes, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import tablefunctions
from quillgraph.functions import ids, text, tokens
from quillgraph.memory import MemoryGraph
from quillgraph.operators import access, assertions, corpus, graph, ingest, jobs, merge, recall, scene, supersede
from quillgraph.plans.adapters import LINES_SQL, NODES_SQL, SPINE_SQL, hashed, instant, line_edges, millis, order_nodes, part_nodes, spine_edges, table
from quillgraph.plans.catalogue import AT, NE, URGENT, N, query
from quillgraph.schema import status_rank, trust_rank


def _key():
    return F.col("o_orderkey")


def _listed(key: str, values: list[str]):
    """One of the values by the rest of a whole number; and the same in SQL."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _listed_sql(key: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def _le(number: str) -> str:
    """Eight bytes of a whole number, least first, in SQL."""
    return "unhex(" + " || ".join(f"substr(printf('%016x', {number}), {15 - 2 * i}, 2)" for i in range(8)) + ")"


def _field(tag: int, value: str) -> str:
    """A tagged field with its length, in SQL over a blob."""
    return f"(unhex('{tag:02x}') || {_le(f'octet_length({value})')} || {value})"


def _text(tag: int, value: str) -> str:
    return _field(tag, f"encode({value})")


# Lookups ---------------------------------------------------------------------------------------------------


@query(N + f" SELECT id, o_orderkey FROM n WHERE repo = '{URGENT}' AND o_orderkey % 17 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 1")
def tenant_scan(spark, d):
    """A tenant without branch markers, stubs and commits in flight."""
    ref = F.struct(F.when(_key() % 9 == 0, "ref:x").when(_key() % 2 == 0, "key").alias("key"))
    nodes = order_nodes(spark, d).withColumns({"kind": F.when(_key() % 17 == 0, "branch").otherwise("commit"), "source_ref": ref})
    return recall.tenant(nodes, URGENT, nodes.where(_key() % 4 == 1)).select("id", "o_orderkey")


@query(N + " SELECT id, repo FROM n WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND repo <> '2-HIGH'")
def point_read(spark, d):
    """Nodes by id; those of a shredded tenant are absent."""
    wanted = table(spark, d, "lineitem").where("l_quantity > 45").select(hashed("order:", "l_orderkey").alias("id"))
    keyring = spark.createDataFrame([(URGENT, b"k"), ("2-HIGH", None)], "tenant string, key binary")
    return jobs.get_nodes(order_nodes(spark, d), wanted, keyring).select("id", "repo")


@query(N + " SELECT DISTINCT id FROM n WHERE o_orderkey IN (SELECT 3 * l_orderkey FROM lineitem)")
def existence(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("k")).select(hashed("order:", "k").alias("id"))
    return jobs.have_nodes(order_nodes(spark, d), wanted)


@query(
    """WITH m AS (SELECT user_id, event_id % 2 = 1 AS fresh, CAST(event_id AS VARCHAR) AS value, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'click'),
    b AS (SELECT user_id, fresh, max({'t': t, 'value': value}) AS m FROM m GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS repo, arg_max(m, fresh).value AS value, arg_max(m, fresh).t AS at FROM b GROUP BY user_id"""
)
def meta_latest(spark, d):
    """Meta rows written over older ones: fresh values win whatever their clock."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), millis("ts").alias("at"), "event_id")
    old = jobs.meta_put(rows.drop("event_id").where("false"), rows.where("event_id % 2 = 0").drop("event_id"))
    return jobs.meta_get(jobs.meta_put(old, rows.where("event_id % 2 = 1").drop("event_id")), "click")


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT CAST(user_id AS VARCHAR) AS name, event_id AS version FROM s WHERE k <= 2")
def newest_snapshots(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("version"))
    return ingest.newest(rows, 2)


@query(N + f" SELECT id, substr(id, 1, 12) || '  ' || title || CASE status WHEN 'Active' THEN '' ELSE ' [' || lower(status) || ']' END AS line FROM n WHERE repo = '{URGENT}' ORDER BY valid_from DESC, id LIMIT 50")
def rendered(spark, d):
    return recall.render(recall.item(recall.storyline(order_nodes(spark, d).where(F.col("repo") == URGENT), 50)))


@query(NE + f" SELECT from_id, to_id, e.kind FROM e JOIN n ON n.id = from_id WHERE repo = '{URGENT}'")
def tenant_export(spark, d):
    """The edges that an export of a tenant carries."""
    nodes = order_nodes(spark, d)
    return merge.export(nodes, spine_edges(nodes), URGENT)[1].select("from_id", "to_id", "kind")


# Text rules ------------------------------------------------------------------------------------------------

NAMES = ["fine-name_1.x", ".", "..", "a b", "x" * 101, "é", ""]
PATHS = ["", "/abs", "a\\b", "a/../b", "a..b/c.md", "..", "a/b.md", "a/.."]
PREFIXES = ["", "/a/", "a/b", "//", "x/"]


@query(f"SELECT doc_id, coalesce(regexp_full_match({_listed_sql('doc_id', NAMES)}, '[A-Za-z0-9._-]{{1,100}}') AND {_listed_sql('doc_id', NAMES)} NOT IN ('.', '..'), false) AS name_ok, doc_id % 8 IN (4, 6) AS path_ok FROM documents")
def safe_names(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _listed("doc_id", NAMES).alias("name"), _listed("doc_id", PATHS).alias("path"))
    return rows.select("doc_id", text.safe_repo_name(F.col("name")).alias("name_ok"), text.safe_relative_path(F.col("path")).alias("path_ok"))


@query(f"SELECT doc_id, CASE WHEN trim({_listed_sql('doc_id', PREFIXES)}, '/') = '' THEN '' ELSE trim({_listed_sql('doc_id', PREFIXES)}, '/') || '/' END || 'd/' || doc_id || '.md' AS path, lower('0xAB' || doc_id) AS hex, replace(replace(source || '|' || doc_id || chr(92), chr(92), chr(92) || chr(92)), '|', chr(92) || '|') AS escaped, substr(text, 1, 512) AS preview FROM documents")
def path_rules(spark, d):
    rel = F.concat(F.lit("d/"), "doc_id", F.lit(".md"))
    raw = F.concat(F.col("source"), F.lit("|"), F.col("doc_id"), F.lit("\\"))
    return table(spark, d, "documents").select(
        "doc_id",
        text.repo_relative(_listed("doc_id", PREFIXES), rel).alias("path"),
        text.normalise_hex(F.concat(F.lit(" \t0xAB"), "doc_id", F.lit(" "))).alias("hex"),
        ids.escape(raw).alias("escaped"),
        text.preview(F.col("text")).alias("preview"),
    )


@query("SELECT doc_id, p.key, p.value || doc_id AS value, p.kind FROM documents, (VALUES ('Implements', 'X-', 'Implements'), ('DECIDES', 'Y:', 'Decides'), ('ref', 'Z', 'References'), ('other', 'W', NULL)) p(key, value, kind)")
def directives(spark, d):
    """Pairs of directive blocks under a whole text; pairs outside of blocks and lines that are no pairs do not count."""
    block = F.concat(
        F.coalesce("text", F.lit("")),
        F.lit(f"\n{text.FENCES[0]}\nImplements: X-"), "doc_id", F.lit("\nno pair here\n  DECIDES:Y:"), "doc_id", F.lit("\n```\nsupersedes: outside\n"),
        F.lit(f"{text.FENCES[1]}\n ref :  Z"), "doc_id", F.lit(" \nother: W"), "doc_id", F.lit("\n~~~\nrefutes: outside"),
    )
    each = table(spark, d, "documents").select("doc_id", F.explode(text.directive_blocks(block)).alias("p"))
    return each.select("doc_id", "p.key", "p.value", text.directive_kind(F.col("p.key")).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Real ' || doc_id WHEN 1 THEN 'named' WHEN 2 THEN 'stem.tar' WHEN 3 THEN '.hidden' ELSE 'First ' || doc_id END AS title FROM documents")
def corpus_titles(spark, d):
    k, plain = F.col("doc_id") % 5, F.concat(F.lit("plain "), "doc_id")
    body = F.when(k == 0, F.concat(F.lit("~~~\n# Fenced\n~~~\n= Real "), "doc_id", F.lit("\n# Later\n"), "text")).when(k == 4, F.concat(F.lit("# First "), "doc_id", F.lit("\n"), "text")).otherwise(plain)
    path = F.when(k == 3, ".hidden").otherwise("a/b/stem.tar.md")
    return table(spark, d, "documents").select("doc_id", text.corpus_title(path, F.when(k == 1, ' "named" '), F.coalesce(body, plain)).alias("title"))


@query("SELECT doc_id, list_reduce(list_transform(string_split('s' || doc_id, ''), lambda c: CAST(unicode(c) AS UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS UBIGINT))::BIGINT AS seed FROM documents")
def scene_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", graph.fnv1a(F.concat(F.lit("s"), "doc_id")).alias("seed"))


@query(N + " SELECT o_orderkey, CASE status WHEN 'Active' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END AS status_rank, CASE trust_tier WHEN 'DerivedDeterministic' THEN 0 WHEN 'AgentAsserted' THEN 2 ELSE 3 END AS trust_rank FROM n")
def enum_ranks(spark, d):
    return order_nodes(spark, d).select("o_orderkey", status_rank(F.col("status")).alias("status_rank"), trust_rank(F.col("trust_tier")).alias("trust_rank"))


# Ids and preimages -----------------------------------------------------------------------------------------

_NODE = " || ".join([_text(0, f"'{ids.NODE_DOMAIN}'"), _field(1, "unhex('0100')"), _text(2, "plane"), _text(3, "kind"), _text(4, "repo"), _text(5, "author"), _text(6, "'git_commit|' || repo || '|o' || o_orderkey"), _text(7, "title")])


@query(N + f" SELECT o_orderkey, sha256({_NODE}) AS content_id FROM n")
def content_ids(spark, d):
    """Ids over all that a node's id covers."""
    none = F.lit(None).cast("string")
    ref = F.struct(F.lit("git_commit").alias("tag"), "repo", none.alias("path"), none.alias("git_sha"), F.concat(F.lit("o"), _key()).alias("sha"), none.alias("byte_start"), none.alias("byte_end"), none.alias("key"))
    made = ids.node_preimage(F.col("plane"), F.col("kind"), F.col("repo"), F.col("author"), ids.source_bytes(F.col("ref")), F.col("content"))
    return order_nodes(spark, d).withColumn("ref", ref).select("o_orderkey", ids.sha2_id(made).alias("content_id"))


_AUDIT = " || ".join([_text(0, "'audit:v1'"), _field(1, _le("event_id")), _field(2, _le("epoch_us(ts) // 1000")), _field(3, "unhex(repeat('00', 32))"), _text(4, "event_type"), _text(5, "CAST(user_id AS VARCHAR)"), _text(6, "'doc-' || event_id"), _text(7, "coalesce(props, '')")])


@query(f"SELECT event_id AS sequence, sha256({_AUDIT}) AS hash FROM events")
def audit_hashes(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("sequence"), millis("ts").alias("timestamp_ms"), F.lit(access.ZERO_HASH).alias("prev_hash"), F.col("event_type").alias("event"),
        F.col("user_id").cast("string").alias("actor"), F.concat(F.lit("doc-"), "event_id").alias("resource_id"), F.coalesce("props", F.lit("")).alias("detail"),
    )
    return rows.select("sequence", F.sha2(access.audit_preimage(), 256).alias("hash"))


_GRANT = " || ".join([
    _text(0, "'grant:v1'"), _text(1, "'g' || c_custkey"), _text(2, "c_name"), _text(3, "c_mktsegment"), _text(4, "'*'"), _field(5, "unhex('0100')"), _text(4, "'n' || c_nationkey"),
    _field(5, "unhex(CASE WHEN c_custkey % 3 = 0 THEN '0101' ELSE '0100' END)"), _text(6, "'open'"), _field(7, _le("c_custkey * 1000")), _text(8, "c_mktsegment"), _field(9, _le("c_custkey")),
    _field(10, "unhex(sha256(c_name))"), f"CASE WHEN c_custkey % 7 = 0 THEN {_text(11, "'revoked'")} ELSE unhex('') END",
])


@query(f"SELECT c_custkey, sha256({_GRANT}) AS digest FROM customer")
def grant_digests(spark, d):
    """What a grant's signature covers: two scopes, one delegation, a mark on revoked ones."""
    k, yes, no = F.col("c_custkey"), F.lit(True), F.lit(False)
    scope = lambda resource, read, write: F.struct(resource.alias("resource"), read.alias("can_read"), write.alias("can_write"))
    rows = table(spark, d, "customer").select(
        k, F.concat(F.lit("g"), k).alias("grant_id"), F.col("c_name").alias("issuer"), F.col("c_mktsegment").alias("recipient"),
        F.array(scope(F.lit("*"), yes, no), scope(F.concat(F.lit("n"), "c_nationkey"), yes, k % 3 == 0)).alias("scopes"), F.lit("open").alias("policy"), (k * 1000).alias("expires_at_ms"),
        F.array(F.struct(F.col("c_mktsegment").alias("delegator"), k.alias("at_ms"))).alias("delegations"), F.unhex(F.sha2("c_name", 256)).alias("issuer_key"), (k % 7 == 0).alias("revoked"),
    )
    return rows.select("c_custkey", F.sha2(access.grant_preimage(), 256).alias("digest"))


# Writes ----------------------------------------------------------------------------------------------------


@query(N + " SELECT o_orderkey FROM n WHERE plane = 'Asserted' AND trust_tier IN ('AgentAsserted', 'InferredAdvisory')")
def assertable_nodes(spark, d):
    return order_nodes(spark, d).where(supersede.assertable()).select("o_orderkey")


@query(N + " SELECT o_orderkey FROM n WHERE NOT (plane = 'Derived' AND NOT signed AND status = 'Active' AND o_orderkey % 3 = 0)")
def corpus_violations(spark, d):
    """What an import of a corpus would refuse."""
    author = F.when(_key() % 3 == 0, F.concat(F.lit("corpus:"), "repo")).otherwise(F.col("author"))
    return corpus.violations(order_nodes(spark, d).withColumn("author", author)).select("o_orderkey")


@query("SELECT c_custkey, c_custkey % 4 = c_custkey % 3 OR (c_custkey % 5 <> 0 AND c_custkey % 4 <> c_custkey % 2 AND c_custkey % 4 <> c_custkey % 7) AS allowed FROM customer")
def second_party(spark, d):
    """Who may confirm a proposal: the target's author, or neither of those who brought it in and signed it."""
    k = F.col("c_custkey")
    who = lambda n: F.concat(F.lit("w"), k % n)
    return table(spark, d, "customer").select("c_custkey", supersede.may_confirm(who(4), who(3), F.when(k % 5 != 0, who(2)), who(7)).alias("allowed"))


@query(NE + " SELECT n.repo, 'inserter:' || from_id || ':' || to_id || ':' || e.kind AS key, 'w' AS value, CAST(5 AS BIGINT) AS at FROM e JOIN n ON n.id = from_id WHERE e.kind IN ('Supersedes', 'Refutes', 'Contradicts') AND quarantined")
def inserters(spark, d):
    nodes = order_nodes(spark, d)
    own = spine_edges(nodes).drop("at").join(nodes.select(F.col("id").alias("from_id"), "repo"), "from_id")
    return jobs.inserter_records(own, "w", 5)


@query(N + " SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Archived' ELSE status END AS status FROM n")
def status_set(spark, d):
    nodes = order_nodes(spark, d)
    return supersede.set_status(nodes, nodes.where(_key() % 6 == 0), "Archived").select("o_orderkey", "status")


def _diff(spark, d) -> tuple[DataFrame, DataFrame]:
    """A diff of every other order over a store of two orders in three, by writer w1 of three."""
    nodes = order_nodes(spark, d).withColumns({"author": F.concat(F.lit("w"), _key() % 3), "observed_at": F.col("valid_from"), "ok": _key() % 14 != 0})
    edges = spine_edges(nodes)
    stored = edges.where("kind = 'Contradicts'").withColumn("quarantined", F.lit(True))
    return assertions.judge_diff(nodes.where(_key() % 3 != 2), stored, nodes.where(_key() % 2 == 0), edges.withColumn("ok", F.col("kind") != "Refutes"), "w1", AT)


@query(
    N
    + f""" SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 0 THEN 'signature' WHEN o_orderkey % 3 = 0 THEN 'not the author'
    WHEN o_orderkey % 3 = 2 AND NOT (status = 'Active' AND valid_to IS NULL) THEN 'not as first inserted' WHEN valid_from > {AT} THEN 'time' END AS reason FROM n WHERE o_orderkey % 2 = 0"""
)
def diff_node_reasons(spark, d):
    return _diff(spark, d)[0].select("o_orderkey", "reason")


@query(
    NE
    + """, h AS (SELECT id, o_orderkey % 3 AS w FROM n WHERE o_orderkey % 3 <> 2 OR o_orderkey % 2 = 0)
    SELECT from_id, to_id, kind, CASE WHEN kind = 'Refutes' THEN 'signature' WHEN t.id IS NULL OR f.id IS NULL THEN 'endpoint'
    WHEN kind IN ('Supersedes', 'Contradicts') AND t.w <> 1 AND NOT quarantined THEN 'needs a second party' WHEN kind = 'Contradicts' AND NOT quarantined THEN 'promotion' END AS reason
    FROM e LEFT JOIN h t ON t.id = to_id LEFT JOIN h f ON f.id = from_id"""
)
def diff_edge_reasons(spark, d):
    return _diff(spark, d)[1].select("from_id", "to_id", "kind", "reason")


@query(
    NE
    + f""", o AS (SELECT id, repo, o_orderkey % 4 AS k FROM n WHERE o_orderkey % 4 < 2),
    t AS (SELECT repo FROM o WHERE k = 0 UNION SELECT o.repo FROM (SELECT from_id AS id FROM e UNION SELECT to_id FROM e) LEFT JOIN o USING (id))
    SELECT repo FROM t WHERE repo IS NULL OR repo NOT IN ('{URGENT}', '2-HIGH')"""
)
def merge_authz(spark, d):
    """Tenants that a bundle touches without a write grant, and a null row for ends that nobody knows."""
    nodes = order_nodes(spark, d)
    grants = spark.createDataFrame([(URGENT, True), ("2-HIGH", True), ("3-MEDIUM", False)], "repo string, can_write boolean")
    return merge.unwritable(nodes.where(_key() % 4 == 0), spine_edges(nodes), nodes.where(_key() % 4 == 1), grants)


@query(
    """WITH k AS (SELECT n_name AS tenant, 1 AS g, CASE WHEN n_nationkey % 3 <> 0 THEN upper(sha256('old:' || n_name)) END AS key FROM nation),
    w AS (SELECT n_name AS tenant FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region)
    SELECT tenant, CASE WHEN w.tenant IS NOT NULL AND key IS NULL THEN coalesce(g, 0) + 1 ELSE g END AS generation, CASE WHEN w.tenant IS NOT NULL AND key IS NULL THEN upper(sha256('new:' || tenant)) ELSE key END AS key
    FROM k FULL JOIN w USING (tenant)"""
)
def keys_ensured(spark, d):
    """Live keys for the wanted tenants: shredded ones and new ones get one of the next generation."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    key = F.unhex(F.sha2(F.concat(F.lit("old:"), "n_name"), 256))
    ring = nation.select(F.col("n_name").alias("tenant"), F.lit(1).alias("generation"), F.when(F.col("n_nationkey") % 3 != 0, key).alias("key"))
    wanted = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("tenant")).union(region.select("r_name"))
    made = access.ensure_keys(ring, wanted, F.unhex(F.sha2(F.concat(F.lit("new:"), "tenant"), 256)))
    return made.select("tenant", "generation", F.hex("key").alias("key"))


@query("WITH " + NODES_SQL.strip() + "," + LINES_SQL + ", p AS (SELECT sha256('part:' || p_partkey) AS id, p_brand FROM part) SELECT from_id, to_id, le.kind, coalesce(n.repo, p_brand) AS tenant FROM le LEFT JOIN n ON n.id = from_id AND o_orderkey % 2 = 0 LEFT JOIN p ON p.id = to_id")
def edge_owners(spark, d):
    nodes = order_nodes(spark, d).where(_key() % 2 == 0).select("id", "repo").union(part_nodes(spark, d).select("id", "repo"))
    return access.edge_owner(line_edges(spark, d), nodes).select("from_id", "to_id", "kind", "tenant")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'deleted' WHEN c_custkey % 3 = 0 THEN 'advanced' WHEN c_custkey % 2 = 0 THEN 'merged' ELSE 'active' END AS state FROM customer")
def branch_lifecycle(spark, d):
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("t"), k).alias("tip"))
    live = own.where("id % 5 <> 0").select("name", F.when(F.col("id") % 3 == 0, "moved").otherwise(F.col("tip")).alias("tip"))
    return ingest.branch_states(own, live, own.where("id % 2 = 0").select(F.col("tip").alias("sha"))).select("id", "state")


@query("SELECT vec_id, CASE WHEN vec_id % 7 <> 0 AND vec_id % 2 = 0 AND vec_id % 3 <> 2 THEN 'v2' WHEN vec_id % 3 > 0 THEN 'v' || vec_id % 3 END AS model FROM embeddings")
def backfilled(spark, d):
    """Vectors of a model where there is none of it; markers stay bare."""
    k = F.col("vec_id")
    old = F.when(k % 3 > 0, F.struct(F.concat(F.lit("v"), k % 3).alias("model"), F.col("embedding").alias("data")))
    nodes = table(spark, d, "embeddings").select("vec_id", k.alias("id"), F.when(k % 7 == 0, "branch").otherwise("doc").alias("kind"), old.alias("embedding"))
    fresh = table(spark, d, "embeddings").where(k % 2 == 0).select(k.alias("id"), F.col("embedding").alias("data"))
    return jobs.backfill_embeddings(nodes, fresh, "v2").select("vec_id", "embedding.model")


# Scenes ----------------------------------------------------------------------------------------------------

_PLACE = ", t AS (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS t FROM (SELECT DISTINCT repo FROM n)), p AS (SELECT id, valid_from, CAST(t AS DOUBLE) AS t, CAST(row_number() OVER (PARTITION BY repo ORDER BY valid_from, id) - 1 AS DOUBLE) AS i FROM n JOIN t USING (repo))"


@query(N + _PLACE + " SELECT id, i % 16 AS x, t * 20 + floor(i / 16) AS y FROM p")
def layout_lattice(spark, d):
    return scene.layout(order_nodes(spark, d), "lattice")


@query(N + _PLACE + " SELECT id, round(valid_from / 86400000.0::DOUBLE, 6) AS x, round(t * 4 + sin(i), 6) + 0.0 AS y FROM p")
def layout_river(spark, d):
    return scene.layout(order_nodes(spark, d), "river").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    NE
    + """, k AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id),
    c AS (SELECT from_id AS id FROM e WHERE kind IN ('Contradicts', 'Refutes') UNION SELECT to_id FROM e WHERE kind IN ('Contradicts', 'Refutes')),
    r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS m FROM n)
    SELECT n.id, repo, status, round(cos(i * 2 * pi() / m), 6) + 0.0 AS x, round(sin(i * 2 * pi() / m), 6) + 0.0 AS y, coalesce(degree, 0) AS degree, c.id IS NOT NULL AS contradicted, title
    FROM n JOIN r USING (id) LEFT JOIN k USING (id) LEFT JOIN c USING (id)"""
)
def scene_graph(spark, d):
    """The whole scene of nodes that have no vectors: places on the ring, degrees, contradictions and titles."""
    nodes = order_nodes(spark, d)
    shown, _ = scene.scene(nodes.withColumn("vector", F.array().cast("array<double>")), spine_edges(nodes), "vector", 64)
    return shown.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}).drop("z")


# Confirmation and merges through the guards ----------------------------------------------------------------

def _contested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposals beside the spine's own: some back along it, some of a node over itself, and one against each confirmed supersession."""
    some = nodes.where("o_orderkey % 42 = 0 or o_orderkey % 50 = 0").select(F.col("id").alias("from_id"), "o_orderkey")
    keyed = edges.join(some, "from_id")
    over = F.lit("Supersedes").alias("kind")
    back = lambda rows: rows.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), over)
    line = keyed.where("kind = 'TemporalNext'")
    own = line.where("o_orderkey % 50 = 0").select("from_id", F.col("from_id").alias("to_id"), over)
    made = back(line.where("o_orderkey % 42 = 0")).unionByName(own).unionByName(back(edges.where("kind = 'Supersedes' and not quarantined"))).distinct()
    return made.join(edges.where("kind = 'Supersedes'").select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").withColumns({"quarantined": F.lit(True), "at": F.lit(1).cast("long")})


_FACADE_SQL = (
    NE.replace("quarantined, valid_from AS at", "quarantined, valid_from AS at, o_orderkey AS hash_key")
    + """,
made AS (
  SELECT to_id AS from_id, from_id AS to_id, 'Supersedes' AS kind FROM e WHERE kind = 'TemporalNext' AND hash_key % 42 = 0
  UNION SELECT from_id, from_id, 'Supersedes' FROM e WHERE kind = 'TemporalNext' AND hash_key % 50 = 0
  UNION SELECT to_id, from_id, 'Supersedes' FROM e WHERE kind = 'Supersedes' AND NOT quarantined),
pr AS MATERIALIZED (
  SELECT p.*, a.plane = 'Asserted' AND b.plane = 'Derived' AS crosses, b.o_orderkey % 2 = 1 AS mine
  FROM (SELECT * FROM made UNION SELECT from_id, to_id, kind FROM e WHERE quarantined) p JOIN n a ON a.id = p.from_id JOIN n b ON b.id = p.to_id),
firm AS MATERIALIZED (SELECT from_id, to_id FROM e WHERE kind = 'Supersedes' AND NOT quarantined),
fit AS MATERIALIZED (SELECT from_id, to_id FROM pr WHERE NOT mine AND kind = 'Supersedes' AND from_id <> to_id AND NOT crosses),
o AS (
  SELECT from_id, to_id, kind, CASE WHEN mine THEN 'second party' WHEN kind <> 'Supersedes' THEN 'confirmed' WHEN from_id = to_id THEN 'self' WHEN crosses THEN 'plane'
    WHEN EXISTS (SELECT 1 FROM firm f WHERE f.from_id = pr.to_id AND f.to_id = pr.from_id) THEN 'cycle'
    WHEN EXISTS (SELECT 1 FROM fit f WHERE f.from_id = pr.to_id AND f.to_id = pr.from_id AND f.from_id < pr.from_id) THEN 'cycle' ELSE 'confirmed' END AS outcome
  FROM pr),
hit AS (SELECT DISTINCT to_id AS id FROM o WHERE outcome = 'confirmed' AND kind = 'Supersedes')
SELECT o.*, outcome <> 'confirmed' AS quarantined, CASE WHEN n.status = 'Active' AND hit.id IS NOT NULL THEN 'Superseded' ELSE n.status END AS status
FROM o JOIN n ON n.id = o.to_id LEFT JOIN hit ON hit.id = o.to_id"""
)


@query(_FACADE_SQL)
def confirm_facade(spark, d):
    """Proposals over each order confirmed by the graph's own verb: over oneself, against what is confirmed, from an asserted node over
    a derived one, and those that the one who confirms has brought in; with what became of the edge and of its target."""
    nodes = order_nodes(spark, d)
    edges = spine_edges(nodes)
    g = MemoryGraph(nodes, edges)
    # Stored, as each is read several times.
    folder = graph.shared_dir(spark)
    asked = graph._keep(_contested(nodes, edges).unionByName(edges.where("quarantined")), folder, "asked")
    mine = asked.join(nodes.where("o_orderkey % 2 = 1").select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*asked.columns)
    mine = graph._keep(mine, folder, "mine")
    g = g.propose(mine, "me", 5).propose(asked.join(mine.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").select(*asked.columns), "you", 5)
    keys = asked.select("from_id", "to_id", "kind")
    after = g.confirm(keys, 123, "me")
    state = after.edges.select("from_id", "to_id", "kind", "quarantined")
    return after.outcomes.join(state, ["from_id", "to_id", "kind"]).join(after.nodes.select(F.col("id").alias("to_id"), "status"), "to_id")


_BUNDLE_SQL = (
    NE
    + """,
l AS MATERIALIZED (SELECT * FROM n WHERE o_orderkey % 5 <> 1),
r AS MATERIALIZED (SELECT * REPLACE (CASE WHEN o_orderkey % 4 = 0 THEN 'Archived' ELSE status END AS status, list_reverse(confidence) AS confidence) FROM n WHERE o_orderkey % 3 <> 1 AND o_orderkey % 10 <> 5),
b AS (SELECT r.*, l.id IS NOT NULL AS had, l.status AS was, l.valid_to AS until, l.confidence AS old FROM r LEFT JOIN l USING (id)),
j AS MATERIALIZED (
  SELECT id, o_orderkey, had, plane,
    CASE WHEN had AND (CASE was WHEN 'Active' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END) > (CASE status WHEN 'Active' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END) THEN was ELSE status END AS now, was,
    list_transform([1, 2], lambda i: CAST(confidence[i] | coalesce(old[i], 0) AS TINYINT)) AS joined, old
  FROM b),
nn AS MATERIALIZED (SELECT l.id, coalesce(j.now, l.status) AS status, l.plane FROM l LEFT JOIN j USING (id) UNION ALL SELECT id, now, plane FROM j WHERE NOT had),
le AS MATERIALIZED (SELECT * FROM e WHERE substr(from_id, 1, 1) < 'a'),
re AS MATERIALIZED (SELECT from_id, to_id, kind, quarantined AND substr(from_id, 2, 1) < '8' AS quarantined, e.at FROM e WHERE substr(to_id, 1, 1) < 'a'),
plain AS (SELECT re.*, le.from_id IS NOT NULL AS had, le.quarantined AND NOT re.quarantined AS changed FROM re LEFT JOIN le USING (from_id, to_id, kind) WHERE NOT (re.kind = 'Supersedes' AND NOT re.quarantined)),
claim AS (
  SELECT re.from_id, re.to_id, le.from_id IS NOT NULL AS had, a.id IS NULL OR z.id IS NULL OR (a.plane = 'Asserted' AND z.plane = 'Derived') AS barred, z.status AS target
  FROM re LEFT JOIN le USING (from_id, to_id, kind) LEFT JOIN nn a ON a.id = re.from_id LEFT JOIN nn z ON z.id = re.to_id WHERE re.kind = 'Supersedes' AND NOT re.quarantined)
SELECT (SELECT count(*) FROM j WHERE NOT had) AS nodes_added,
  (SELECT count(*) FROM j WHERE had AND (now <> was OR joined <> old)) AS nodes_merged,
  (SELECT count(*) FROM plain WHERE NOT had) + (SELECT count(*) FROM claim WHERE NOT barred AND NOT had) AS edges_added,
  (SELECT count(*) FROM plain WHERE had AND changed) AS edges_merged,
  (SELECT count(DISTINCT to_id) FROM claim WHERE NOT barred AND target = 'Active') AS superseded,
  (SELECT count(*) FROM claim WHERE barred) AS rejected_supersessions,
  CAST(0 AS BIGINT) AS rejected_signatures,
  (SELECT CAST(coalesce(sum(len(list_filter(joined, lambda x: x = 3)) - len(list_filter(old, lambda x: x = 3))), 0) AS BIGINT) FROM j WHERE had) AS contradictions"""
)


@query(_BUNDLE_SQL)
def merge_counters(spark, d):
    """The eight counters of a merge: half of the orders here, another half there, archived or with other confidence on some."""
    nodes = order_nodes(spark, d)
    edges = spine_edges(nodes).withColumn("trust_tier", F.lit("DerivedDeterministic"))
    there = nodes.where("o_orderkey % 3 <> 1 and o_orderkey % 10 <> 5").withColumns({"status": F.when(_key() % 4 == 0, "Archived").otherwise(F.col("status")), "confidence": F.reverse("confidence")})
    links = edges.where("substring(to_id, 1, 1) < 'a'").withColumn("quarantined", F.col("quarantined") & (F.substring("from_id", 2, 1) < "8"))
    columns = [c for c in nodes.columns if c not in ("o_orderkey", "o_custkey")]
    # A graph is a stored table: a merge reads its own several times.
    kept = lambda df, step: graph._keep(df, folder, step)
    folder = graph.shared_dir(spark)
    g = MemoryGraph(kept(nodes.where("o_orderkey % 5 <> 1").select(*columns), "nodes"), kept(edges.where("substring(from_id, 1, 1) < 'a'"), "edges"))
    return g.merge(there.select(*columns), links).counters


@query("SELECT 'doc:docs/' || doc_id || '.md' AS sha, source AS repo, CASE WHEN doc_id % 3 = 1 THEN 'Archived' ELSE 'Active' END AS status, CAST(CASE WHEN doc_id % 3 = 0 THEN 20 ELSE 10 END AS BIGINT) AS valid_from FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 3 <> 1)")
def ingest_documents(spark, d):
    """Two pushes of documents into one store: the second lacks a third of the first's and brings a third of its own; what has
    vanished is archived, what stayed is not written again."""
    docs = table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.lit("s").alias("git_sha"), "text", "doc_id")
    store = jobs.open_store(spark, f"{graph.shared_dir(spark)}/store")
    none = spark.createDataFrame([], "repo string, sha string, parents array<string>, author string, time_secs long, subject string, body string")
    heads, who = spark.createDataFrame([], "repo string, head string"), spark.createDataFrame([], "author string")
    jobs.run_ingest(store, none, heads, who, 10, docs.where("doc_id % 3 <> 0").drop("doc_id"))
    jobs.run_ingest(store, none, heads, who, 20, docs.where("doc_id % 3 <> 1").drop("doc_id"))
    return store.read("nodes").where("startswith(sha, 'doc:')").select("sha", "repo", "status", "valid_from")


# Table functions, tokens, chains ---------------------------------------------------------------------------


@query(N + f" SELECT id, title, valid_from FROM n WHERE repo = '{URGENT}' ORDER BY valid_from DESC, id LIMIT 15")
def sql_recall(spark, d):
    """recall as a table function of SQL."""
    nodes = order_nodes(spark, d)
    tablefunctions.register(spark, MemoryGraph(nodes, spine_edges(nodes)), "orders_")
    return spark.sql(f"SELECT id, title, valid_from FROM orders_recall('{URGENT}', 15)")


@query()
def sql_chunks(spark, d):
    """Chunks of all documents by the table function; the tests compare it with the function of the API."""
    tablefunctions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_to_cut")
    return spark.sql("SELECT * FROM chunks(TABLE(SELECT doc_id, source AS title, text FROM documents_to_cut), 800)")


def _base64url(value):
    return F.translate(F.regexp_replace(F.base64(value), r"[=\r\n]", ""), "+/", "-_")


def _hmac(secret: bytes, message):
    """HMAC-SHA-256 of built-in functions."""
    pads = [F.lit(bytearray(x ^ pad for x in secret.ljust(64, b"\0"))) for pad in (0x36, 0x5C)]
    return F.unhex(F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], F.encode(message, "UTF-8")), 256))), 256))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 'malformed' WHEN c_custkey % 23 = 0 THEN 'key' WHEN c_custkey % 17 = 0 THEN 'algorithm' WHEN c_custkey % 13 = 0 THEN 'signature' WHEN c_custkey % 7 = 0 THEN 'issuer' WHEN c_custkey % 11 = 0 THEN 'audience' WHEN c_custkey % 5 = 0 THEN 'expired' ELSE 'ok' END AS verdict, CASE WHEN c_custkey % 19 * (c_custkey % 23) * (c_custkey % 17) * (c_custkey % 13) * (c_custkey % 7) * (c_custkey % 11) * (c_custkey % 5) <> 0 THEN 'customer#' || c_custkey END AS sub FROM customer")
def token_verdicts(spark, d):
    """A token a customer, with what may be wrong with one."""
    k = F.col("c_custkey")
    head = F.concat(F.lit('{"alg":"'), F.when(k % 17 == 0, "none").otherwise("HS256"), F.lit('","kid":"'), F.when(k % 23 == 0, "x").otherwise("h"), F.lit('"}'))
    body = F.concat(F.lit('{"sub":"customer#'), k.cast("string"), F.lit('","iss":"'), F.when(k % 7 == 0, "you").otherwise("me"), F.lit('","aud":'), F.when(k % 11 == 0, '"them"').when(k % 2 == 0, '["x","us"]').otherwise('"us"'), F.lit(',"exp":'), F.when(k % 5 == 0, "900").otherwise("1000"), F.lit("}"))
    rows = table(spark, d, "customer").select(k.alias("id"), k, F.concat(_base64url(F.encode(head, "UTF-8")), F.lit("."), _base64url(F.encode(body, "UTF-8"))).alias("m"))
    signature = _base64url(F.when(k % 13 == 0, _hmac(b"other", F.col("m"))).otherwise(_hmac(b"secret", F.col("m"))))
    made = rows.select("id", F.concat("m", F.when(k % 19 == 0, "").otherwise("."), signature).alias("token"))
    return tokens.verify(made, {"h": {"alg": "HS256", "secret": b"secret"}}, "me", "us", 1000).select("id", "verdict", "sub")


@query("WITH b AS (SELECT DISTINCT o_orderkey // 32 AS number FROM orders) SELECT 'Emits' AS kind, count(*) AS n FROM orders WHERE o_custkey % 50 = 0 UNION ALL SELECT 'Touches', count(*) FROM orders WHERE o_custkey % 100 = 0 UNION ALL SELECT 'TemporalNext', count(*) FROM b WHERE number - 1 IN (SELECT number FROM b) UNION ALL SELECT 'Supersedes', count(*) FROM b WHERE number % 10 = 0")
def chain_edges(spark, d):
    """Edges that a walk lands: orders as transactions, 32 keys a block, against stored checkpoints of which one in ten has another hash."""
    tx = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("hash"), F.concat(F.lit("C"), "o_custkey").alias("from"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c"), "o_custkey")).alias("to"), F.lit("1").alias("value"))
    blocks = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 32).alias("number")).agg(F.collect_list(tx).alias("transactions"))  # 32 a block at most
    blocks = blocks.select("number", F.concat(F.lit("b"), "number").alias("hash"), F.concat(F.lit("b"), F.col("number") - 1).alias("parent_hash"), (F.col("number") * 1000).alias("at_ms"), "transactions")
    address = F.concat(F.lit("c"), "c_custkey").alias("address")
    watched = table(spark, d, "customer").where("c_custkey % 50 = 0").select(address)
    contracts = table(spark, d, "customer").where("c_custkey % 100 = 0").select(address, hashed("contract:", "c_custkey").alias("id"))
    stored = blocks.select("number", F.when(F.col("number") % 10 == 0, F.concat("hash", F.lit("-old"))).otherwise(F.col("hash")).alias("hash"))
    _, links = jobs.chain_graph(blocks, watched, stored, contracts, 1, 5)
    return links.groupBy("kind").agg(F.count("*").alias("n"))
