"""Named queries over the driver's tables, and the same in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import lattice, text, vectors
from quillgraph.operators import access, anchor, ann, cycles, graph, ingest, jobs, merge, recall, scene, supersede
from quillgraph.plans.adapters import (
    GEO_SQL,
    LINES_SQL,
    NODES_SQL,
    SPINE_SQL,
    document_nodes,
    geography_edges,
    hashed,
    instant,
    line_edges,
    millis,
    order_nodes,
    part_nodes,
    spine_edges,
    table,
    vector_nodes,
)
from quillgraph.schema import EDGE_TAGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
URGENT = "1-URGENT"


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _tags(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EDGE_TAGS.items()) + " END"


N, NE = _with(NODES_SQL), _with(NODES_SQL, SPINE_SQL)

# Recall ----------------------------------------------------------------------------------------------------


@query(N + f" SELECT id, title, valid_from, status FROM n WHERE repo = '{URGENT}' ORDER BY valid_from DESC, id LIMIT 15")
def storyline(spark, d):
    nodes = order_nodes(spark, d).where(F.col("repo") == URGENT)
    return recall.item(recall.storyline(nodes, 15)).select("id", "title", "valid_from", "status")


@query(N + " SELECT repo, count(*) AS total, max(valid_from) AS newest FROM n GROUP BY repo")
def storyline_total(spark, d):
    return order_nodes(spark, d).groupBy("repo").agg(F.count("*").alias("total"), F.max("valid_from").alias("newest"))


AT = 820_454_400_000  # 1996-01-01


@query(N + f" SELECT id, repo, valid_from, valid_to FROM n WHERE plane = 'Derived' AND valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) ORDER BY valid_from DESC, id LIMIT 100")
def as_of(spark, d):
    return recall.as_of(order_nodes(spark, d), AT, 100).select("id", "repo", "valid_from", "valid_to")


@query(N + f" SELECT id, plane, valid_from FROM n WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) ORDER BY valid_from DESC, id LIMIT 100")
def as_of_asserted(spark, d):
    return recall.as_of(order_nodes(spark, d), AT, 100, asserted=True).select("id", "plane", "valid_from")


@query(N + ", w AS (SELECT * FROM n ORDER BY valid_from DESC, id LIMIT 200) SELECT id, trust_tier, status FROM w WHERE trust_tier = 'InferredAdvisory' OR status <> 'Active' ORDER BY valid_from DESC, id LIMIT 50")
def review_window(spark, d):
    return recall.review(order_nodes(spark, d), 50).select("id", "trust_tier", "status")


_RESOLVE = "SELECT min(id) AS id FROM (SELECT DISTINCT sha256('doc:' || doc_id) AS id FROM documents) WHERE starts_with(id, '{}') HAVING count(*) = 1"
_UNIQUE = "09ffccc88c6f"


@query(_RESOLVE.format(_UNIQUE))
def resolve_prefix_unique(spark, d):
    return recall.resolve_prefix(document_nodes(spark, d), _UNIQUE)


@query(_RESOLVE.format("a"))
def resolve_prefix_ambiguous(spark, d):
    return recall.resolve_prefix(document_nodes(spark, d), "a")


def _busiest(edges: DataFrame) -> str:
    """The id with most edges in or out, ties by id."""
    return graph.degrees(edges).orderBy(F.desc("degree"), "id").first()["id"]


_NEAR = """
, hub AS (SELECT id FROM (SELECT from_id AS id FROM le UNION ALL SELECT to_id FROM le) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1),
f AS (
  SELECT 0 AS direction, to_id AS far_id, kind, quarantined FROM le, hub WHERE from_id = hub.id
  UNION ALL SELECT 1, from_id, kind, quarantined FROM le, hub WHERE to_id = hub.id),
g AS (SELECT f.*, repo AS far_repo, status AS far_status FROM f LEFT JOIN (SELECT id, repo, status FROM n UNION ALL SELECT sha256('part:' || p_partkey), p_brand, 'Active' FROM part) x ON x.id = far_id)
"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes = order_nodes(spark, d).select("id", "repo", "status").unionByName(part_nodes(spark, d).select("id", "repo", "status"))
    return nodes, line_edges(spark, d)


@query(_with(NODES_SQL, LINES_SQL) + _NEAR + f" SELECT direction, far_id, kind, quarantined, far_repo, far_status FROM g ORDER BY direction, far_id, {_tags('kind')} LIMIT 20")
def neighbors_out_in(spark, d):
    nodes, edges = _graph(spark, d)
    return recall.neighbors(nodes, edges, _busiest(edges), 20).select("direction", "far_id", "kind", "quarantined", "far_repo", "far_status")


@query(_with(NODES_SQL, LINES_SQL) + _NEAR + f" SELECT direction, far_id, kind, far_repo FROM g WHERE far_repo IS NULL OR far_repo IN ('1-URGENT', '3-MEDIUM', 'Brand#11') ORDER BY direction, far_id, {_tags('kind')} LIMIT 20")
def neighbors_readable(spark, d):
    nodes, edges = _graph(spark, d)
    readable = spark.createDataFrame([("1-URGENT",), ("3-MEDIUM",), ("Brand#11",)], "repo string")
    return recall.neighbors(nodes, edges, _busiest(edges), 20, readable).select("direction", "far_id", "kind", "far_repo")


def _spine(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes = order_nodes(spark, d)
    return nodes, spine_edges(nodes)


_VERIFY = """
, v AS (SELECT to_id AS id, count(*) FILTER (kind = 'Supersedes') AS s, count(*) FILTER (kind <> 'Supersedes') AS r, min(from_id) AS first_from
        FROM e {} WHERE NOT quarantined AND kind IN ('Supersedes', 'Refutes', 'Contradicts') GROUP BY 1),
o AS (SELECT n.id, CASE WHEN plane = 'Derived' THEN 'derived' WHEN signed THEN 'signed' ELSE 'missing' END AS posture, coalesce(s, 0) AS superseded_by, coalesce(r, 0) AS refuted_by,
      list_contains(confidence, 3) AS contradicted, status FROM n LEFT JOIN v USING (id))
SELECT id, posture, superseded_by, refuted_by, contradicted, posture <> 'missing' AND superseded_by = 0 AND refuted_by = 0 AND NOT contradicted AND status = 'Active' AS trustworthy FROM o
"""


def _flags(df):
    return df.select("id", "posture", F.size("superseded_by").cast("long").alias("superseded_by"), F.size("refuted_by").cast("long").alias("refuted_by"), "contradicted", "trustworthy")


@query(NE + _VERIFY.format(""))
def verify_flags(spark, d):
    return _flags(recall.verify(*_spine(spark, d)))


@query(NE + _VERIFY.format("JOIN (SELECT id AS far FROM n WHERE repo IN ('1-URGENT', '2-HIGH')) ON far = from_id"))
def verify_readable(spark, d):
    return _flags(recall.verify(*_spine(spark, d), spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "repo string")))


@query(
    NE
    + f""", b AS (SELECT from_id AS id, 0 AS direction, to_id AS far, kind, quarantined FROM e UNION ALL SELECT to_id, 1, from_id, kind, quarantined FROM e),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY direction, far, {_tags('b.kind')}) AS place FROM b JOIN n ON n.id = far WHERE repo IN ('1-URGENT', '2-HIGH', '5-LOW')),
    f AS (SELECT id, bool_or(kind = 'Supersedes' AND direction = 1) AS s, bool_or(kind IN ('Contradicts', 'Refutes')) AS c FROM r WHERE place <= 64 AND NOT quarantined GROUP BY id)
    SELECT n.id, CASE WHEN coalesce(s, false) OR status = 'Superseded' THEN 'superseded' WHEN coalesce(c, false) THEN 'contradicted' ELSE 'current' END AS verdict FROM n LEFT JOIN f USING (id)"""
)
def verify_verdict(spark, d):
    return recall.verdict(*_spine(spark, d), spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "repo string"))


_SHOWN = NE + f", w AS (SELECT * FROM n WHERE repo = '{URGENT}' ORDER BY valid_from DESC, id LIMIT 200)"


@query(
    _SHOWN
    + f""" SELECT 'truncated' AS gap, CAST(NULL AS VARCHAR) AS id, count(*) AS n FROM n WHERE repo = '{URGENT}' HAVING count(*) > (SELECT count(*) FROM w)
    UNION ALL SELECT 'superseded', NULL, count(*) FROM w WHERE status = 'Superseded' HAVING count(*) > 0
    UNION ALL SELECT 'contradicted', id, 1 FROM w WHERE list_contains(confidence, 3)
    UNION ALL SELECT 'adjacent_proposal', id, 1 FROM w WHERE EXISTS (SELECT 1 FROM e WHERE quarantined AND (from_id = w.id OR to_id = w.id))"""
)
def critique_gaps(spark, d):
    nodes, edges = _spine(spark, d)
    own = nodes.where(F.col("repo") == URGENT)
    return recall.critique(recall.storyline(own, 200), own.count(), edges)


@query(
    _SHOWN
    + f""", g AS (SELECT CASE WHEN (SELECT count(*) FROM n WHERE repo = '{URGENT}') > (SELECT count(*) FROM w) THEN 1 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM w WHERE status = 'Superseded') THEN 1 ELSE 0 END
    + (SELECT count(*) FROM w WHERE list_contains(confidence, 3)) + (SELECT count(*) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE quarantined AND (from_id = w.id OR to_id = w.id))) AS k)
    SELECT round(1 / (1 + k), 9) AS completeness FROM g"""
)
def critique_completeness(spark, d):
    return recall.completeness(critique_gaps(spark, d)).select(F.round("completeness", 9).alias("completeness"))


_SIG = ", s AS (SELECT id, direction, kind, count(*) AS n FROM (SELECT from_id AS id, 0 AS direction, kind FROM le WHERE NOT quarantined UNION ALL SELECT to_id, 1, kind FROM le WHERE NOT quarantined) GROUP BY ALL)"


@query(_with(LINES_SQL) + _SIG + " SELECT id, direction, kind, n FROM s")
def edge_signature(spark, d):
    return recall.edge_signatures(line_edges(spark, d))


@query(
    _with(LINES_SQL)
    + _SIG
    + """, a AS (SELECT s.direction, s.kind, s.n AS m FROM s, (SELECT min(id) AS id FROM s) x WHERE s.id = x.id),
    o AS (SELECT s.id, sum(s.n) AS n, sum(least(s.n, coalesce(a.m, 0))) AS same FROM s LEFT JOIN a USING (direction, kind) GROUP BY s.id)
    SELECT id, round(same / (n + (SELECT sum(m) FROM a) - same), 9) AS structural FROM o"""
)
def signature_overlap(spark, d):
    signatures = recall.edge_signatures(line_edges(spark, d))
    first = signatures.agg(F.min("id")).first()[0]
    return recall.signature_overlap(signatures, signatures.where(F.col("id") == first)).select("id", F.round("structural", 9).alias("structural"))


@query("SELECT source AS repo, count(*) AS nodes FROM documents GROUP BY source")
def tenant_counts(spark, d):
    return document_nodes(spark, d).groupBy("repo").agg(F.count("*").alias("nodes"))


@query(NE + " SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM events) AS audit, (SELECT count(*) FROM e WHERE quarantined) AS proposals")
def ops_snapshot(spark, d):
    nodes, edges = _spine(spark, d)
    one = lambda df, *aggs: df.agg(*aggs).withColumn("one", F.lit(1))
    out = one(nodes, F.count("*").alias("nodes")).join(one(edges, F.count("*").alias("edges"), F.count_if("quarantined").alias("proposals")), "one")
    return out.join(one(table(spark, d, "events"), F.count("*").alias("audit")), "one").select("nodes", "edges", "audit", "proposals")


@query("SELECT source AS repo, lang AS kind, count(*) AS unembedded FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY GROUPING SETS ((source), (lang))")
def backfill_report(spark, d):
    bare = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return bare.groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("unembedded")).select(F.col("source").alias("repo"), F.col("lang").alias("kind"), "unembedded")


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def kind_histogram(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT source || ':docs/' || doc_id || '.md' AS citation, substr(text, 1, 2000) AS passage FROM documents")
def passages(spark, d):
    nodes = document_nodes(spark, d)
    return recall.passages(nodes.withColumn("content", F.encode("text", "UTF-8"))).select("citation", F.col("text").alias("passage"))


# Vectors ---------------------------------------------------------------------------------------------------

_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"


@query(f"SELECT b.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_COS.format('a.embedding', 'b.embedding')} DESC, sha256('vec:' || b.vec_id) LIMIT 10")
def cosine_topk(spark, d):
    nodes = vector_nodes(spark, d)
    first = nodes.where("vec_id = 0").first()["embedding"]["data"]
    return recall.search(nodes, first, "v1", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN 'model' WHEN vec_id % 5 = 0 THEN 'dim' WHEN vec_id % 7 = 0 THEN 'finite' END AS reason, count(*) AS n FROM embeddings GROUP BY 1")
def cosine_guarded(spark, d):
    rows = table(spark, d, "embeddings")
    key = F.col("vec_id")
    data = F.when(key % 5 == 0, F.slice("embedding", 1, 32)).when(key % 7 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return rows.select(vectors.guard(data, F.when(key % 3 == 0, "other").otherwise("v1"), "v1", 64).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS first_value, round(embedding[64] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS last_value FROM embeddings")
def l2_normalize(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 9).alias("first_value"), F.round(F.element_at("u", -1), 9).alias("last_value"))


_EDGES_OF_VECTORS = "SELECT sha256('vec:' || a.vec_id) AS from_id, sha256('vec:' || b.vec_id) AS to_id, CASE WHEN a.vec_id % 2 = 0 THEN 'References' ELSE 'DependsOn' END AS kind, a.vec_id % 5 = 0 AS quarantined FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 OR b.vec_id = a.vec_id * 2"


def vector_edges(spark, d) -> DataFrame:
    ids = table(spark, d, "embeddings").select("vec_id")
    each = ids.select("vec_id", F.explode(F.array_distinct(F.array(F.col("vec_id") + 1, F.col("vec_id") * 2))).alias("other"))
    linked = each.join(ids.withColumnRenamed("vec_id", "other"), "other", "left_semi")
    kind = F.when(F.col("vec_id") % 2 == 0, "References").otherwise("DependsOn")
    return linked.select(hashed("vec:", "vec_id").alias("from_id"), hashed("vec:", "other").alias("to_id"), kind.alias("kind"), (F.col("vec_id") % 5 == 0).alias("quarantined"))


@query(
    f"""WITH ve AS ({_EDGES_OF_VECTORS}), a AS (SELECT * FROM embeddings WHERE vec_id = 1),
    c AS (SELECT b.vec_id, sha256('vec:' || b.vec_id) AS id, {_COS.format('a.embedding', 'b.embedding')} AS cosine FROM a, embeddings b WHERE b.label <> a.label AND b.label IN (0, 1, 2, 3, 4, 5)),
    k AS (SELECT * FROM c ORDER BY cosine DESC, id LIMIT 20),
    s AS (SELECT id, direction, kind, count(*) AS n FROM (SELECT from_id AS id, 0 AS direction, kind FROM ve WHERE NOT quarantined UNION ALL SELECT to_id, 1, kind FROM ve WHERE NOT quarantined) GROUP BY ALL),
    w AS (SELECT direction, kind, n AS m FROM s WHERE id = sha256('vec:1')),
    o AS (SELECT s.id, sum(s.n) AS n, sum(least(s.n, coalesce(w.m, 0))) AS same FROM s LEFT JOIN w USING (direction, kind) GROUP BY s.id),
    z AS (SELECT k.vec_id, k.id, cosine, coalesce(same / (n + (SELECT sum(m) FROM w) - same), 0) AS structural FROM k LEFT JOIN o USING (id))
    SELECT vec_id, round(cosine, 6) AS cosine, round(structural, 6) AS structural, round(0.7 * cosine + 0.3 * structural, 6) AS score FROM z ORDER BY 0.7 * cosine + 0.3 * structural DESC, id LIMIT 5"""
)
def analogies(spark, d):
    nodes = vector_nodes(spark, d)
    repos = spark.createDataFrame([(f"label{i}",) for i in range(6)], "repo string")
    anchor_id = nodes.where("vec_id = 1").first()["id"]
    found = recall.analogies(nodes, vector_edges(spark, d), anchor_id, repos, 5)
    return found.join(nodes.select("id", "vec_id"), "id").select("vec_id", *[F.round(c, 6).alias(c) for c in ("cosine", "structural", "score")])


@query()
def ann_topk(spark, d):
    nodes = vector_nodes(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding.data").alias("data"))
    return ann.CellIndex(nodes, "data").search_each(nodes.where("id % 50 = 0"), 10).withColumn("score", F.round("score", 6))


@query()
def hash_embed_all(spark, d):
    """Every document; SQL lower-cases and splits some letters in another way, so the tests compare with a plain version."""
    return vectors.hash_embedding(table(spark, d, "documents"), "doc_id", "text", 256).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("SELECT count(*) FILTER (e.vec_id IS NOT NULL) AS reused, count(*) FILTER (e.vec_id IS NULL) AS to_embed FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE label < 5) e ON e.vec_id = d.doc_id")
def embed_reuse_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("one"))
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "v1").otherwise("v0").alias("model"), F.col("embedding").alias("data"))
    reused, rest = ingest.embed_split(docs, stored, "v1", 64)
    n = reused.agg(F.count("*").alias("reused"), F.lit(1).alias("one")).join(rest.agg(F.count("*").alias("to_embed"), F.lit(1).alias("one")), "one")
    return n.select("reused", "to_embed")


@query("SELECT label, min(vec_id) FILTER (v = m) AS vec_id FROM (SELECT label, vec_id, embedding AS v, min(list_transform(embedding, lambda x: CASE WHEN x < 0 OR (x = 0 AND CAST(x AS VARCHAR) = '-0.0') THEN 10 - x ELSE x END)) OVER (PARTITION BY label) AS k, list_transform(embedding, lambda x: CASE WHEN x < 0 OR (x = 0 AND CAST(x AS VARCHAR) = '-0.0') THEN 10 - x ELSE x END) AS own, (own = k) AS hit, CASE WHEN own = k THEN embedding END AS m FROM embeddings) WHERE hit GROUP BY label")
def embedding_min(spark, d):
    rows = table(spark, d, "embeddings").withColumn("bits", vectors.bit_patterns(F.col("embedding")))
    return rows.groupBy("label").agg(F.min(F.struct("bits", "vec_id")).alias("m")).select("label", F.col("m.vec_id").alias("vec_id"))


# Lattice and merge -----------------------------------------------------------------------------------------

_PAIR = "(SELECT doc_id, CAST(quality + 1 AS TINYINT) AS a, CAST(toxic * 2 + quality AS TINYINT) AS b FROM labels)"


def _pair(spark, d):
    return table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).cast("tinyint").alias("a"), (F.col("toxic") * 2 + F.col("quality")).cast("tinyint").alias("b"))


@query(f"SELECT doc_id, a | b AS joined FROM {_PAIR}")
def belnap_join(spark, d):
    return _pair(spark, d).select("doc_id", lattice.join(F.col("a"), F.col("b")).alias("joined"))


@query(f"SELECT doc_id, a & b AS met FROM {_PAIR}")
def belnap_meet(spark, d):
    return _pair(spark, d).select("doc_id", lattice.meet(F.col("a"), F.col("b")).alias("met"))


@query(f"SELECT doc_id, a | b AS v1, a AS v2, a & b AS m1 FROM {_PAIR}")
def belnap_vector(spark, d):
    long, short = F.array("a", "a"), F.array("b")
    both = _pair(spark, d).select("doc_id", lattice.vector_join(long, short).alias("j"), lattice.vector_meet(long, short).alias("m"))
    return both.select("doc_id", F.element_at("j", 1).cast("tinyint").alias("v1"), F.element_at("j", 2).cast("tinyint").alias("v2"), F.element_at("m", 1).cast("tinyint").alias("m1"))


def _replicas(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the orders: the second knows other statuses, times, tiers and confidence of every third."""
    own = order_nodes(spark, d).select("id", "repo", "status", "valid_from", "valid_to", F.lit(0).cast("long").alias("observed_at"), "trust_tier", "confidence", "o_orderkey")
    third = own.where("o_orderkey % 3 = 0")
    other = third.withColumns({"status": F.when(F.col("o_orderkey") % 2 == 0, "Archived").otherwise(F.col("status")), "valid_to": F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("valid_to") - 1000), "valid_from": F.col("valid_from") - 5, "trust_tier": F.lit("AgentAsserted"), "confidence": F.array((F.col("o_orderkey") % 2 + 1).cast("tinyint"), F.lit(2).cast("tinyint"), F.lit(1).cast("tinyint"))})
    return own, other


_REPLICAS = N + """, r AS (SELECT id, status, valid_from, valid_to, trust_tier, confidence, o_orderkey FROM n UNION ALL
  SELECT id, CASE WHEN o_orderkey % 2 = 0 THEN 'Archived' ELSE status END, valid_from - 5, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE valid_to - 1000 END, 'AgentAsserted', [CAST(o_orderkey % 2 + 1 AS TINYINT), 2, 1], o_orderkey FROM n WHERE o_orderkey % 3 = 0),
k AS (SELECT *, CASE status WHEN 'Active' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END AS rank, CASE trust_tier WHEN 'DerivedDeterministic' THEN 0 WHEN 'HumanConfirmed' THEN 1 WHEN 'AgentAsserted' THEN 2 ELSE 3 END AS trust FROM r),
m AS (SELECT id, max(rank) AS rank, max(trust) AS trust, min(valid_from) AS valid_from, bit_or(confidence[1]) AS c1, bit_or(confidence[2]) AS c2, bit_or(confidence[3]) AS c3 FROM k GROUP BY id),
t AS (SELECT k.id, min(valid_to) AS valid_to FROM k JOIN m ON m.id = k.id AND m.rank = k.rank GROUP BY k.id)"""


@query(_REPLICAS + " SELECT m.id, ['Active', 'Superseded', 'Archived'][rank + 1] AS status, t.valid_to, m.valid_from, ['DerivedDeterministic', 'HumanConfirmed', 'AgentAsserted', 'InferredAdvisory'][trust + 1] AS trust_tier, c1, c2, c3 FROM m JOIN t ON t.id = m.id")
def crdt_node_merge(spark, d):
    own, other = _replicas(spark, d)
    merged = merge.merge_nodes(own.drop("o_orderkey").unionByName(other.drop("o_orderkey")))
    return merged.select("id", "status", "valid_to", "valid_from", "trust_tier", *[F.try_element_at("confidence", F.lit(k)).alias(f"c{k}") for k in (1, 2, 3)])


@query(NE + ", x AS (SELECT from_id, to_id, kind, quarantined, 'DerivedDeterministic' AS trust_tier, 'a' AS plane FROM e UNION ALL SELECT from_id, to_id, kind, NOT quarantined, 'AgentAsserted', 'b' FROM e WHERE e.at % 2 = 0) SELECT from_id, to_id, kind, bool_and(quarantined) AS quarantined, CASE WHEN bool_or(trust_tier = 'AgentAsserted') THEN 'AgentAsserted' ELSE 'DerivedDeterministic' END AS trust_tier, CASE WHEN bool_or(plane = 'b') THEN 'b' ELSE 'a' END AS plane FROM x GROUP BY ALL")
def crdt_edge_merge(spark, d):
    _, edges = _spine(spark, d)
    one = edges.withColumns({"trust_tier": F.lit("DerivedDeterministic"), "plane": F.lit("a")})
    two = edges.where("at % 2 = 0").withColumns({"quarantined": ~F.col("quarantined"), "trust_tier": F.lit("AgentAsserted"), "plane": F.lit("b")})
    return merge.merge_edges(one.unionByName(two).drop("at")).select("from_id", "to_id", "kind", "quarantined", "trust_tier", "plane")


@query(
    _REPLICAS
    + """, w AS (SELECT m.id, n.id IS NOT NULL AS had, rank IS DISTINCT FROM CASE n.status WHEN 'Active' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END OR t.valid_to IS DISTINCT FROM n.valid_to
      OR trust IS DISTINCT FROM CASE n.trust_tier WHEN 'DerivedDeterministic' THEN 0 WHEN 'HumanConfirmed' THEN 1 WHEN 'AgentAsserted' THEN 2 ELSE 3 END OR c1 <> n.confidence[1] OR c2 <> n.confidence[2] OR c3 IS NOT NULL AS changed,
      (c1 = 3)::INT + (c2 = 3)::INT - (n.confidence[1] = 3)::INT - (n.confidence[2] = 3)::INT AS fresh FROM m JOIN t ON t.id = m.id LEFT JOIN (SELECT * FROM n WHERE o_orderkey % 2 = 0) n ON n.id = m.id)
    SELECT count(*) FILTER (NOT had) AS inserted, count(*) FILTER (had AND changed) AS changed, count(*) FILTER (had AND NOT changed) AS unchanged, CAST(sum(CASE WHEN had THEN fresh ELSE 0 END) AS BIGINT) AS new_contradictions FROM w"""
)
def crdt_counters(spark, d):
    own, other = _replicas(spark, d)
    merged = merge.merge_nodes(own.drop("o_orderkey").unionByName(other.drop("o_orderkey")))
    return merge.merge_counters(own.where("o_orderkey % 2 = 0"), merged)


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def anchor_union(spark, d):
    sets = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("lang"))))).alias("langs"))
    return sets.select("source", F.array_join("langs", ",").alias("langs"))


@query("SELECT sha256(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def corpus_dedup(spark, d):
    return merge.dedup(table(spark, d, "documents").select(F.sha2("text", 256).alias("id"), "doc_id"), ["doc_id"]).select("id", "doc_id")


def _merkle_sql(leaves: str, count: int) -> str:
    """Levels of a tree over `leaves` (pos, h as hex)."""
    out, level = f"WITH l0 AS ({leaves})", 0
    while count > 1:
        out += f", l{level + 1} AS (SELECT a.pos // 2 AS pos, sha256(from_hex(a.h || coalesce(b.h, ''))) AS h FROM l{level} a LEFT JOIN l{level} b ON b.pos = a.pos + 1 WHERE a.pos % 2 = 0)"
        count, level = -(-count // 2), level + 1
    return out + f" SELECT h AS root FROM l{level}"


@query(_merkle_sql("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, sha256(n_nationkey || ':' || n_name) AS h FROM nation", 25))
def merkle_root(spark, d):
    leaves = table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("hash"))
    root = anchor.merkle_root(anchor.positions(leaves, ["n_nationkey"]).select("pos", "hash"), "geo")
    return spark.createDataFrame([(root,)], "root string")


# Graph -----------------------------------------------------------------------------------------------------

_REACH = ", r(id) AS (SELECT to_id FROM ge WHERE from_id IN ('c1', 's1') UNION SELECT to_id FROM ge JOIN r ON from_id = id)"


@query(_with(GEO_SQL) + _REACH + " SELECT id FROM r")
def reachable_via(spark, d):
    return graph.reachable(geography_edges(spark, d), spark.createDataFrame([("c1",), ("s1",)], "id string"))


@query(_with(GEO_SQL) + _REACH + " SELECT id FROM (SELECT 'r' || r_regionkey AS id FROM region) x WHERE id IN (SELECT id FROM r)")
def ancestor_set(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.is_ancestor(geography_edges(spark, d), regions, spark.createDataFrame([("c1",), ("s1",)], "id string"))


@query(_with(GEO_SQL) + ", p AS (SELECT to_id AS from_id, from_id AS to_id FROM ge WHERE from_id LIKE 'n%' UNION ALL SELECT 'r0', 'r1') SELECT from_id, to_id FROM p WHERE from_id <> 'r0' OR to_id <> 'r1'")
def cycle_guard(spark, d):
    edges = geography_edges(spark, d)
    back = edges.where("from_id like 'n%'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return cycles.closes_cycle(edges, back.unionByName(spark.createDataFrame([("r0", "r1")], "from_id string, to_id string")))


@query(_with(GEO_SQL) + ", u AS (SELECT from_id, to_id FROM ge UNION SELECT to_id, from_id FROM ge), h1 AS (SELECT DISTINCT to_id AS id FROM u WHERE from_id = 'r0'), h2 AS (SELECT DISTINCT to_id AS id FROM u WHERE from_id IN (SELECT id FROM h1)) SELECT 'r0' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 'r0' AND id NOT IN (SELECT id FROM h1)")
def khop(spark, d):
    return graph.neighbourhood(geography_edges(spark, d), spark.createDataFrame([("r0",)], "id string"), 2)


def _heads(nodes: DataFrame) -> DataFrame:
    """The watermark of each customer: the newest order but one in ten is not merged yet."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("valid_from"), F.desc("o_orderkey"))
    placed = nodes.select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place")).where("place = 1 + (o_custkey % 3)")
    return placed.select(hashed("order:", "o_orderkey").alias("id"))


_MERGED = ", o AS (SELECT id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from DESC, o_orderkey DESC) AS place FROM n), c AS (SELECT id FROM o WHERE place >= 1 + (o_custkey % 3))"


@query(N + _MERGED + " SELECT id FROM c")
def canonical_only(spark, d):
    nodes, edges = _spine(spark, d)
    return recall.canonical(nodes, edges, _heads(nodes))


@query(N + _MERGED + " SELECT o.id, 'cust-' || o_custkey AS branch FROM o WHERE id NOT IN (SELECT id FROM c)")
def in_flight(spark, d):
    nodes, edges = _spine(spark, d)
    tips = nodes.select("o_custkey").distinct()
    mark = F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"), F.lit("@tip"))
    branches = tips.select(F.concat(F.lit("branch:"), "o_custkey").alias("id"), F.lit("branch").alias("kind"), F.lit("Active").alias("status"), F.encode(mark, "UTF-8").alias("content"))
    held = nodes.select(F.concat(F.lit("branch:"), "o_custkey").alias("from_id"), F.col("id").alias("to_id"), F.lit("BranchContains").alias("kind"))
    return recall.in_flight(branches, held, recall.canonical(nodes, edges, _heads(nodes)))


@query(_with(LINES_SQL) + " SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM le UNION ALL SELECT to_id FROM le) GROUP BY id")
def degree(spark, d):
    return graph.degrees(line_edges(spark, d))


@query(NE + " SELECT id FROM n WHERE id IN (SELECT from_id FROM e WHERE kind IN ('Contradicts', 'Refutes') UNION SELECT to_id FROM e WHERE kind IN ('Contradicts', 'Refutes'))")
def contradicted(spark, d):
    return graph.contradicted(*_spine(spark, d))


@query(NE + f" SELECT from_id, to_id, kind FROM e WHERE from_id IN (SELECT id FROM n WHERE repo = '{URGENT}') AND to_id IN (SELECT id FROM n WHERE repo = '{URGENT}')")
def dangling_filter(spark, d):
    nodes, edges = _spine(spark, d)
    return graph.inside(edges, nodes.where(F.col("repo") == URGENT)).select("from_id", "to_id", "kind")


@query("WITH p AS (SELECT 'vec' || vec_id AS id, row_number() OVER (ORDER BY 'vec' || vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT id, round(cos(i * 2 * pi() / n), 9) + 0.0 AS x, round(sin(i * 2 * pi() / n), 9) + 0.0 AS y FROM p")
def scene_ring(spark, d):
    ids = table(spark, d, "embeddings").select(F.concat(F.lit("vec"), "vec_id").alias("id"))
    return scene.ring(ids).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query()
def scene_pca(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return scene.project(rows, "embedding", 64).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(NE + ", g AS (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e), k AS (SELECT id, count(*) AS degree FROM g GROUP BY id) SELECT n.id, coalesce(degree, 0) AS degree FROM n LEFT JOIN k USING (id) WHERE repo <> (SELECT repo FROM n WHERE o_orderkey = 1) ORDER BY coalesce(degree, 0) DESC, n.id LIMIT 4")
def scene_analogues(spark, d):
    nodes, edges = _spine(spark, d)
    return scene.analogues(nodes, edges, nodes.where("o_orderkey = 1").first()["id"])


# Supersession ----------------------------------------------------------------------------------------------


@query(NE + " , f AS (SELECT e.*, a.plane AS fp, b.plane AS tp FROM e JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id) SELECT from_id, to_id, kind, CASE WHEN kind <> 'Supersedes' THEN 'kind' WHEN quarantined THEN 'quarantined' WHEN from_id = to_id THEN 'self' WHEN fp = 'Asserted' AND tp = 'Derived' THEN 'plane' END AS reason FROM f")
def supersede_rejects(spark, d):
    nodes, edges = _spine(spark, d)
    return supersede.reject_reasons(nodes, edges.where("false"), edges).select("from_id", "to_id", "kind", "reason")


@query(NE + " , f AS (SELECT to_id AS id, min({'t': e.at, 'from_id': from_id}).t AS t FROM e JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE e.kind = 'Supersedes' AND NOT quarantined AND NOT (a.plane = 'Asserted' AND b.plane = 'Derived') GROUP BY 1) SELECT n.id, CASE WHEN f.id IS NOT NULL AND status = 'Active' THEN 'Superseded' ELSE status END AS status, CASE WHEN f.id IS NOT NULL AND status = 'Active' THEN greatest(t, valid_from) ELSE valid_to END AS valid_to FROM n LEFT JOIN f USING (id)")
def supersede_apply(spark, d):
    nodes, edges = _spine(spark, d)
    judged = supersede.judge(nodes, edges.where("false"), edges)
    return supersede.apply_supersessions(nodes, judged).select("id", "status", "valid_to")


@query(NE + """ SELECT from_id, to_id, kind, quarantined AND (e.at // 86400000) % 2 = 1 AS quarantined, CASE WHEN quarantined AND (e.at // 86400000) % 2 = 0 AND kind = 'Supersedes' THEN 123 ELSE e.at END AS at FROM e""")
def confirm_edge(spark, d):
    _, edges = _spine(spark, d)
    return supersede.confirm(edges, edges.where("quarantined and floor(at / 86400000) % 2 = 0"), 123)


@query(NE + " SELECT from_id, to_id, kind, quarantined AND kind <> 'Supersedes' AS quarantined FROM e")
def demotion_guard(spark, d):
    _, edges = _spine(spark, d)
    edges = edges.drop("at")
    incoming = edges.where("kind = 'Supersedes'").withColumn("quarantined", F.lit(False)).unionByName(edges.where("kind = 'Refutes'").withColumn("quarantined", F.lit(True)))
    return supersede.upsert_edges(edges, incoming)


@query(NE + f" , s AS (SELECT to_id AS id, min(a.valid_from) AS at FROM e JOIN n a ON a.id = from_id WHERE e.kind = 'Supersedes' AND NOT quarantined GROUP BY 1) SELECT n.id, CASE WHEN valid_from > {AT} THEN 'future' WHEN status = 'Superseded' AND s.at > {AT} THEN 'Active' ELSE status END AS effective FROM n LEFT JOIN s USING (id)")
def effective_status(spark, d):
    return supersede.effective_status(*_spine(spark, d), AT)


_SINCE = 788_918_400_000  # 1995-01-01


@query(NE + f"""
, st AS (SELECT from_id, to_id FROM e WHERE kind = 'Supersedes' AND NOT quarantined),
pr AS (SELECT from_id, to_id FROM e WHERE kind = 'TemporalNext' AND NOT EXISTS (SELECT 1 FROM st WHERE st.from_id = e.from_id AND st.to_id = e.to_id)
       UNION ALL SELECT to_id, from_id FROM e WHERE kind = 'Supersedes' AND NOT quarantined AND e.at >= {_SINCE}),
k AS (SELECT pr.*, a.plane AS fp, b.plane AS tp FROM pr JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id)
SELECT from_id, to_id, CASE WHEN fp = 'Asserted' AND tp = 'Derived' THEN 'plane' WHEN EXISTS (SELECT 1 FROM st WHERE st.from_id = k.to_id AND st.to_id = k.from_id) THEN 'cycle' END AS reason FROM k""")
def supersede_stored(spark, d):
    """Proposals against stored supersessions: along the spine, and back over each newer stored edge, which closes a cycle."""
    nodes, edges = _spine(spark, d)
    stored = edges.where("kind = 'Supersedes' and not quarantined")
    pairs = supersede.ends_packed(stored.select("from_id", "to_id"))
    ahead = supersede.ends_unpacked(supersede.ends_packed(edges.where("kind = 'TemporalNext'")).join(pairs, ["from_id", "to_id"], "left_anti"))
    back = stored.where(F.col("at") >= _SINCE).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "at")
    asked = ahead.select("from_id", "to_id", "at").unionByName(back).select("from_id", "to_id", F.lit("Supersedes").alias("kind"), F.lit(False).alias("quarantined"), "at")
    return supersede.judge(nodes, stored, asked).select("from_id", "to_id", "reason")


@query(NE + """, f AS (SELECT e.from_id, e.to_id, a.plane = 'Asserted' AND b.plane = 'Derived' AS bad FROM e JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE e.kind = 'Supersedes' AND quarantined),
h AS (SELECT DISTINCT to_id AS id FROM f WHERE NOT bad)
SELECT n.id, CASE WHEN h.id IS NOT NULL AND status = 'Active' THEN 'Superseded' ELSE status END AS status, (SELECT count(*) FROM f WHERE bad) AS still FROM n LEFT JOIN h USING (id)""")
def confirm_and_apply(spark, d):
    nodes, edges = _spine(spark, d)
    after, links = supersede.confirm_and_apply(nodes, edges, edges.where("kind = 'Supersedes' and quarantined"), 1)
    still = links.where("kind = 'Supersedes' and quarantined").agg(F.count("*").alias("still"), F.lit(1).alias("one"))
    return after.select("id", "status", F.lit(1).alias("one")).join(still, "one").drop("one")


@query(N + " SELECT repo, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END, id) AS model FROM n WHERE o_orderkey % 3 = 0 GROUP BY repo")
def model_detect(spark, d):
    key = F.col("o_orderkey")
    model = F.when(key % 2 == 0, "v1").otherwise("v2")
    return jobs.embedding_models(order_nodes(spark, d).withColumn("embedding", F.when(key % 3 == 0, F.struct(model.alias("model"), F.array(F.lit(1.0)).alias("data")))))


@query(NE + " SELECT from_id, to_id, kind, quarantined FROM e ORDER BY from_id, to_id, kind LIMIT 1")
def edge_by_key(spark, d):
    _, edges = _spine(spark, d)
    first = edges.orderBy("from_id", "to_id", "kind").first()
    return jobs.edge_at(edges, first["from_id"], first["to_id"], first["kind"]).select("from_id", "to_id", "kind", "quarantined")


@query("SELECT doc_id, ['AnalogousTo', 'DependsOn', 'Supersedes', 'AnchoredTo'][1 + doc_id % 4] AS edge, ['claim:confirmed', 'tech_debt', 'doc', 'rationale'][1 + doc_id % 4] AS node FROM documents")
def kind_from_string(spark, d):
    at = (F.col("doc_id") % 4 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), at)
    return table(spark, d, "documents").select("doc_id", jobs.edge_kind(pick("Analogy", "depends_on", "SUPERSEDES", "anchoredto")).alias("edge"), jobs.node_kind(pick("claim", "TechDebt", "note", "other")).alias("node"))


@query(N + " SELECT id, author, plane, trust_tier FROM n")
def blame(spark, d):
    return jobs.blame(order_nodes(spark, d))


@query(NE + ", s AS (SELECT id FROM n WHERE repo IN ('1-URGENT', '2-HIGH') AND status = 'Active') SELECT from_id, to_id, kind FROM e WHERE NOT quarantined AND from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)")
def scene_filter(spark, d):
    nodes, edges = _spine(spark, d)
    return jobs.scene_filter(nodes, edges, {"repo": ["1-URGENT", "2-HIGH"], "status": ["Active"]}, False)[1].select("from_id", "to_id", "kind")


@query(NE + " SELECT 'proposals' AS queue, from_id AS id, to_id AS other FROM e WHERE quarantined UNION ALL SELECT 'superseded', from_id, to_id FROM e WHERE NOT quarantined AND kind = 'Supersedes' UNION ALL SELECT 'contradicted', id, NULL FROM n WHERE list_contains(confidence, 3)")
def review_queues(spark, d):
    return jobs.review_queues(*_spine(spark, d))


@query(N + " SELECT id, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS embedded FROM n")
def strip_markers(spark, d):
    key = F.col("o_orderkey")
    nodes = order_nodes(spark, d).withColumns({"kind": F.when(key % 4 == 0, "branch").otherwise("commit"), "embedding": F.lit(None).cast("struct<model:string,data:array<double>>")})
    fresh = nodes.where(key % 3 == 0).select("id", F.array(F.lit(1.0)).alias("data"))
    return jobs.strip_embeddings(jobs.backfill_embeddings(nodes, fresh, "v1")).select("id", F.col("embedding").isNotNull().alias("embedded"))


# Access ----------------------------------------------------------------------------------------------------

_GRANTS = [("g1", False, None, True, [("src0", True, False), ("*", True, True)]), ("g2", False, 1000, True, [("*", True, True)]), ("g3", True, None, True, [("*", True, True)]), ("g4", False, None, False, [("src1", True, True)]), ("g5", False, 5000, True, [("src1", True, True), ("src2", False, True)])]
_GRANTS_SQL = "g(grant_id, revoked, expires, signed, pos, resource, can_read, can_write) AS (VALUES " + ", ".join(f"('{g}', {r}, {'NULL' if e is None else e}::BIGINT, {s}, {i}, '{a}', {b}, {c})" for g, r, e, s, scopes in _GRANTS for i, (a, b, c) in enumerate(scopes)) + ")"


def _grants(spark):
    return spark.createDataFrame(_GRANTS, "grant_id string, revoked boolean, expires_at_ms long, signed boolean, scopes array<struct<resource:string,can_read:boolean,can_write:boolean>>")


@query(
    f"""WITH {_GRANTS_SQL}, q AS (SELECT s.source AS resource, o.op, x.grant_id, s.source || '/' || o.op || '/' || x.grant_id AS request_id FROM (SELECT DISTINCT source FROM documents) s, (VALUES ('read'), ('write')) o(op), (SELECT DISTINCT grant_id FROM g UNION SELECT 'g9') x),
    m AS (SELECT request_id, arg_min(CASE q.op WHEN 'write' THEN can_write ELSE can_read END, pos) AS ok FROM q JOIN g ON g.grant_id = q.grant_id AND (g.resource = '*' OR g.resource = q.resource) GROUP BY 1),
    h AS (SELECT DISTINCT grant_id, revoked, expires, signed FROM g)
    SELECT q.request_id, q.resource, q.op, CASE WHEN revoked IS NULL THEN 'no grant' WHEN revoked THEN 'revoked' WHEN expires <= 2000 THEN 'expired' WHEN NOT signed THEN 'bad signature' WHEN m.ok IS NULL THEN 'out of scope' WHEN NOT m.ok THEN 'not permitted' ELSE 'allowed' END AS decision
    FROM q LEFT JOIN h USING (grant_id) LEFT JOIN m USING (request_id)"""
)
def grant_check(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("resource")).distinct()
    each = sources.withColumn("op", F.explode(F.array(F.lit("read"), F.lit("write")))).withColumn("grant_id", F.explode(F.array(*[F.lit(f"g{i}") for i in (1, 2, 3, 4, 5, 9)])))
    requests = each.withColumn("request_id", F.concat_ws("/", "resource", "op", "grant_id"))
    return access.check_grants(requests, _grants(spark), 2000)


@query(f"WITH {_GRANTS_SQL}, f AS (SELECT grant_id, source AS repo, arg_min(can_read, pos) AS ok FROM g, (SELECT DISTINCT source FROM documents) WHERE resource = '*' OR resource = source GROUP BY ALL) SELECT grant_id, repo FROM f WHERE ok")
def readable_tenants(spark, d):
    scopes = _grants(spark).select("grant_id", F.posexplode("scopes").alias("pos", "s")).select("grant_id", "pos", "s.resource", "s.can_read")
    return access.readable_repos(scopes, table(spark, d, "documents").select(F.col("source").alias("repo")).distinct())


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders),
    s AS (SELECT 'u' || k AS principal, CASE WHEN k % 3 = 0 THEN '*' ELSE 'repo' || (k % 4) END AS resource, k % 3 <> 2 AS can_write, CASE WHEN k % 2 = 0 THEN 'read write' END AS scope, CASE WHEN k % 5 = 0 THEN ['repo0', 'repo1'] END AS tenants FROM p),
    w AS (SELECT principal, resource, can_write, scope, unnest(coalesce(tenants, [resource])) AS tenant FROM s)
    SELECT principal, CASE WHEN resource = '*' THEN tenant ELSE resource END AS resource, true AS can_read, can_write AND scope IS NOT NULL AS can_write FROM w WHERE resource = '*' OR tenant = '*' OR resource = tenant"""
)
def attenuate(spark, d):
    k = F.col("o_custkey")
    people = table(spark, d, "orders").select("o_custkey").distinct()
    members = people.select(F.concat(F.lit("u"), k).alias("principal"), F.when(k % 3 == 0, "owner").when(k % 3 == 2, "read_only").otherwise("member").alias("role"), F.array(F.concat(F.lit("repo"), (k % 4).cast("string"))).alias("scopes"))
    tokens = people.select(F.concat(F.lit("u"), k).alias("principal"), F.when(k % 5 == 0, F.array(F.lit("repo0"), F.lit("repo1"))).alias("tenants"), F.when(k % 2 == 0, "read write").alias("scope"))
    return access.attenuate(access.role_scopes(members), tokens)


@query(
    """WITH a(pos, name, email, wallet, role) AS (VALUES (0, 'one', 'User1@x.org', '0xA', 'owner'), (1, 'two', 'user2@x.org', '0xB', 'member'), (2, 'three', NULL, '0x3', 'member')),
    l AS (SELECT c_custkey AS login_id, ' USER' || (c_custkey % 4) || '@X.org ' AS email, c_custkey % 2 = 0 AS ok, '0x' || (CASE c_custkey % 5 WHEN 0 THEN 'b' ELSE CAST(c_custkey % 5 AS VARCHAR) END) AS wallet FROM customer),
    m AS (SELECT login_id, min(pos) AS pos FROM l JOIN a ON (ok AND lower(trim(l.email)) = lower(a.email)) OR lower(l.wallet) = lower(a.wallet) GROUP BY 1)
    SELECT login_id, name, role FROM m JOIN a USING (pos)"""
)
def allowlist_match(spark, d):
    k = F.col("c_custkey")
    logins = table(spark, d, "customer").select(k.alias("login_id"), F.concat(F.lit(" USER"), (k % 4).cast("string"), F.lit("@X.org ")).alias("email"), (k % 2 == 0).alias("email_verified"), F.concat(F.lit("0x"), F.when(k % 5 == 0, "b").otherwise((k % 5).cast("string"))).alias("wallet"))
    entries = spark.createDataFrame([(0, "one", "User1@x.org", "0xA", "owner"), (1, "two", "user2@x.org", "0xB", "member"), (2, "three", None, "0x3", "member")], "pos int, name string, email string, wallet string, role string")
    return access.match_allowlist(logins, entries)


def _audit(spark, d, broken: int | None = None) -> DataFrame:
    """events as an audit log whose records hash themselves; the chain is by sequence."""
    e = table(spark, d, "events")
    seq = e.select(F.col("event_id").alias("sequence"), millis("ts").alias("timestamp_ms"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("actor"))
    own = seq.withColumn("hash", F.sha2(F.concat_ws("|", "sequence", "timestamp_ms", "event", "actor"), 256))
    link = own.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("prev_hash"))
    log = own.join(link, "sequence", "left").withColumn("prev_hash", F.when(F.col("sequence") == 0, F.lit(access.ZERO_HASH)).otherwise(F.col("prev_hash")))
    return log if broken is None else log.withColumn("prev_hash", F.when(F.col("sequence") == broken, F.lit(access.ZERO_HASH)).otherwise(F.col("prev_hash")))


@query("SELECT count(*) AS records, CAST(NULL AS BIGINT) AS first_break, CAST(NULL AS VARCHAR) AS reason FROM events")
def audit_chain_verify(spark, d):
    return access.verify_audit(_audit(spark, d).drop("hash"), F.sha2(F.concat_ws("|", "sequence", "timestamp_ms", "event", "actor"), 256))


@query("SELECT count(*) AS records, CAST(17 AS BIGINT) AS first_break, 'prev_hash' AS reason FROM events")
def audit_break(spark, d):
    return access.verify_audit(_audit(spark, d, 17).drop("hash"), F.sha2(F.concat_ws("|", "sequence", "timestamp_ms", "event", "actor"), 256))


@query("SELECT count(*) + 1 AS records, CAST(23 AS BIGINT) AS first_break, 'sequence' AS reason FROM events")
def audit_duplicate(spark, d):
    log = _audit(spark, d).drop("hash")
    return access.verify_audit(log.unionByName(log.where("sequence = 23")), F.sha2(F.concat_ws("|", "sequence", "timestamp_ms", "event", "actor"), 256))


@query("SELECT event_id AS sequence FROM events WHERE event_type = 'purchase' AND contains(CAST(user_id AS VARCHAR) || chr(10) || 'Doc-' || (event_id % 10), '7')")
def audit_filter(spark, d):
    log = _audit(spark, d).withColumns({"resource_id": F.concat(F.lit("Doc-"), F.col("sequence") % 10), "detail": F.lit("")})
    return access.filter_audit(log, event="purchase", text="7").select("sequence")


@query("SELECT c_custkey AS request_id, c_custkey % 4 <> 0 AND c_custkey % 3 = 1 AS allowed, CASE WHEN c_custkey % 4 = 0 THEN 'session: no grant' WHEN c_custkey % 3 = 0 THEN 'request: expired' WHEN c_custkey % 3 = 2 THEN 'request: not permitted' END AS reason FROM customer")
def session_request(spark, d):
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k.alias("request_id"), F.when(k % 3 == 0, "expired").when(k % 3 == 1, "allowed").otherwise("not permitted").alias("decision"))
    return access.both_allow(own, own.where("request_id % 4 <> 0").withColumn("decision", F.lit("allowed")))


@query("SELECT c_custkey AS request_id, 'p' || c_custkey AS principal, 'n' || c_nationkey AS org, CASE WHEN c_nationkey % 5 = 0 THEN 'unknown org' WHEN c_nationkey % 3 = 0 THEN 'inactive org' WHEN c_custkey % 2 = 0 THEN 'no member' ELSE 'allowed' END AS decision FROM customer")
def org_gate(spark, d):
    asks = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("p"), "c_custkey").alias("principal"), F.concat(F.lit("n"), "c_nationkey").alias("org"))
    orgs = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("org"), F.when(F.col("n_nationkey") % 3 == 0, "Closed").otherwise("Active").alias("status"))
    return access.org_gate(asks, orgs, asks.where("request_id % 2 = 1"))


@query("SELECT 'acme' AS org, CAST(c_custkey AS VARCHAR) AS principal, CASE WHEN c_custkey % 3 = 0 THEN 'owner' ELSE 'member' END AS role FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def jit_membership(spark, d):
    k = F.col("c_custkey")
    people = table(spark, d, "customer")
    members = people.where(k % 3 == 0).select(F.lit("acme").alias("org"), k.cast("string").alias("principal"), F.lit("owner").alias("role"))
    return access.join_members(members, people.where(k % 2 == 0).select(k.alias("login_id"), F.lit("member").alias("role")), "acme")


@query("WITH c AS (SELECT user_id AS principal, event_id AS call_id, CAST(floor(epoch_us(ts) / 3600e6) * 3600 AS BIGINT) AS window_start, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 3600e6) ORDER BY ts, event_id) AS place, ts FROM events) SELECT principal, call_id, window_start, CAST(place AS INTEGER) AS place, place <= 1 AS allowed, CASE WHEN place > 1 THEN CAST(ceil(window_start + 3600 - epoch_us(ts) / 1000000) AS BIGINT) END AS retry_after FROM c")
def fixed_window_quota(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("principal"), F.col("event_id").alias("call_id"), instant("ts").alias("ts"))
    return access.fixed_window(calls, 3600, 1)


@query(
    """WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT user_id, event_id, t, i, CAST(2 AS DOUBLE) AS level FROM c WHERE i = 1
      UNION ALL SELECT c.user_id, c.event_id, c.t, c.i, least(2, b.level - CASE WHEN b.level >= 1 THEN 1 ELSE 0 END + greatest(0, c.t - b.t) * (1 / CAST(7200 AS DOUBLE))) FROM b JOIN c ON c.user_id = b.user_id AND c.i = b.i + 1)
    SELECT user_id AS principal, event_id AS call_id, round(level, 6) AS level, level >= 1 AS allowed FROM b"""
)
def token_bucket(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("principal"), F.col("event_id").alias("call_id"), (F.unix_micros(instant("ts")) / 1e6).alias("ts"), F.lit(1).alias("cost"))
    return access.token_bucket(e, 2.0, 1 / 7200).select("principal", "call_id", F.round("level", 6).alias("level"), "allowed")


@query(N + ", i AS (SELECT o_custkey AS principal, valid_from AS a, valid_to AS z FROM n WHERE valid_to IS NOT NULL), s AS (SELECT principal, t, sum(d) AS d FROM (SELECT principal, a AS t, 1 AS d FROM i UNION ALL SELECT principal, z, -1 FROM i) GROUP BY ALL), r AS (SELECT principal, sum(d) OVER (PARTITION BY principal ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT principal, CAST(max(n) AS BIGINT) AS most FROM r GROUP BY principal")
def concurrency_overlap(spark, d):
    spans = order_nodes(spark, d).where("valid_to is not null").select(F.col("o_custkey").alias("principal"), F.col("valid_from").alias("start"), F.col("valid_to").alias("stop"))
    return access.overlaps(spans)


def _keys(spark, sources: DataFrame) -> DataFrame:
    return sources.select(F.col("repo").alias("tenant"), F.lit(1).alias("generation"), F.unhex(F.sha2(F.concat(F.lit("key:"), "repo"), 256)).alias("key"))


@query("SELECT source AS tenant, CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents")
def seal_roundtrip(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content"))
    ring = _keys(spark, docs.select(F.col("tenant").alias("repo")).distinct())
    return access.unseal(access.seal(docs, ring), ring).select("tenant", "id", F.md5("content").alias("digest"))


@query("SELECT source AS tenant, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY source")
def shred_forgets(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content"))
    ring = _keys(spark, docs.select(F.col("tenant").alias("repo")).distinct())
    return access.unseal(access.seal(docs, ring), access.shred(ring, "src0")).groupBy("tenant").agg(F.count("*").alias("n"))


@query(NE + " SELECT from_id || to_id || e.kind AS id, repo AS tenant, sha256(e.kind || '|' || quarantined) AS digest FROM e JOIN n ON n.id = from_id")
def edge_seal_roundtrip(spark, d):
    nodes, edges = _spine(spark, d)
    rows = access.edge_owner(edges, nodes).select("tenant", F.concat("from_id", "to_id", "kind").alias("id"), F.encode(F.concat_ws("|", "kind", F.col("quarantined").cast("string")), "UTF-8").alias("content"))
    ring = _keys(spark, nodes.select("repo").distinct())
    return access.unseal(access.seal(rows, ring, "edges"), ring, "edges").select("id", "tenant", F.sha2("content", 256).alias("digest"))


@query("SELECT count(*) FILTER (doc_id % 3 <> 0 AND source <> 'src0') AS sealed, count(*) FILTER (doc_id % 3 = 0 AND source <> 'src0') AS kept, count(*) FILTER (source = 'src0') AS skipped, count(*) FILTER (source <> 'src0') AS after FROM documents")
def seal_migration(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    ring = access.shred(_keys(spark, docs.select(F.col("tenant").alias("repo")).distinct()), "src0")
    old = access.seal(docs.where("doc_id % 3 = 0"), ring)
    bare = docs.join(old.select("tenant", "id"), ["tenant", "id"], "left_anti").select("tenant", "id", "content", F.lit(None).cast("int").alias("generation"), F.lit(None).cast("binary").alias("sealed"))
    rows, counts = access.seal_migration(bare.unionByName(old.select("tenant", "id", F.lit(None).cast("binary").alias("content"), "generation", "sealed")), ring)
    after = rows.where("sealed is not null").agg(F.count("*").alias("after"), F.lit(1).alias("one"))
    return counts.withColumn("one", F.lit(1)).join(after, "one").drop("one")


# Ingest ----------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT user_id AS k, max(event_id) AS head FROM events GROUP BY 1), w AS (SELECT user_id AS k, max(event_id) AS seen, max(epoch_us(ts) // 1000) AS t FROM events WHERE event_type <> 'purchase' AND user_id % 7 <> 0 GROUP BY 1) SELECT 'u' || h.k AS repo, coalesce(CAST(seen AS VARCHAR), '-') AS head, coalesce(CAST(t AS VARCHAR), '-') AS ingested_at_ms FROM h LEFT JOIN w USING (k)")
def freshness(spark, d):
    heads, marks = _marks(spark, d)
    return ingest.freshness(heads, marks)


def _marks(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("repo", F.concat(F.lit("u"), "user_id"))
    heads = e.groupBy("repo").agg(F.max("event_id").cast("string").alias("head"))
    marks = e.where("event_type <> 'purchase' and user_id % 7 <> 0").groupBy("repo").agg(F.max("event_id").cast("string").alias("head"), F.max(millis("ts")).alias("ingested_at_ms"))
    return heads, marks


_DRIFT = "WITH h AS (SELECT user_id AS k, max(event_id) AS head FROM events GROUP BY 1), w AS (SELECT user_id AS k, max(event_id) AS seen FROM events WHERE event_type <> 'purchase' AND user_id % 7 <> 0 GROUP BY 1), x AS (SELECT 'u' || h.k AS repo, CAST(head AS VARCHAR) AS head, CAST(seen AS VARCHAR) AS seen, h.k FROM h LEFT JOIN w USING (k) WHERE head IS DISTINCT FROM seen)"


@query(_DRIFT + " SELECT repo, head, seen FROM x")
def drift(spark, d):
    return ingest.drifted(*_marks(spark, d))


@query(_DRIFT + " SELECT repo, head, seen FROM x WHERE k % 2 = 1")
def reconcile(spark, d):
    queue = table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("u"), "user_id").alias("repo")).distinct()
    return ingest.reconcile(*_marks(spark, d), queue)


@query("WITH q AS (SELECT 'u' || user_id AS repo, event_id AS seq FROM events) SELECT repo, min(seq) AS first_seen, count(*) AS requests FROM q GROUP BY repo")
def queue_drain(spark, d):
    return ingest.drain(table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("repo"), F.col("event_id").alias("seq")))


@query("SELECT 'o' || o_orderkey AS child, 'o' || p AS parent, CASE WHEN i = 1 THEN 'TemporalNext' ELSE 'MergeParent' END AS kind FROM (SELECT o_orderkey, unnest([o_orderkey - 1, o_orderkey - 7]) AS p, unnest([1, 2]) AS i FROM orders)")
def spine_build(spark, d):
    k = F.col("o_orderkey")
    commits = table(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("sha"), F.array(F.concat(F.lit("o"), k - 1), F.concat(F.lit("o"), k - 7)).alias("parents"))
    return ingest.spine(commits)


@query("WITH c AS (SELECT 'o' || o_orderkey AS sha, 'u' || (o_custkey % 9) AS author, o_orderkey FROM orders) SELECT sha, author, k.kind, 'o' || (o_orderkey - k.m) AS target, k.kind IN ('Supersedes', 'Refutes') AND author <> 'u1' AS quarantined FROM c, (VALUES ('Supersedes', 1), ('References', 2)) k(kind, m) WHERE o_orderkey % 2 = 0")
def trailer_gate(spark, d):
    k = F.col("o_orderkey")
    block = F.concat(F.lit("\n\nAgentile-Supersedes: o"), k - 1, F.lit("\nagentile-see-also: o"), k - 2, F.lit("\nSigned-off-by: x"))
    body = F.concat(F.lit("Change of order.\n\nnote: in prose"), F.when(k % 2 == 0, block).otherwise(F.lit("\n\nno trailer here: at all\nreally")))
    commits = table(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("sha"), F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("author"), body.alias("body"))
    return ingest.trailer_edges(commits, spark.createDataFrame([("u1",)], "author string"))


_LINE = ", o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from DESC, o_orderkey DESC) AS back FROM n)"


def _commits(spark, d) -> DataFrame:
    """Orders as commits of their customers' repos, each with the customer's order before as its parent, and its place from the newest."""
    line = Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.desc("valid_from"), F.desc("o_orderkey"))
    sha = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    rows = order_nodes(spark, d).select("o_custkey", "valid_from", sha.alias("sha"), F.lag(sha).over(line).alias("before"), F.row_number().over(back).alias("back"))
    return rows.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("repo"), "o_custkey", "sha", F.array_compact(F.array("before")).alias("parents"), "back")


@query(N + _LINE + ", c AS (SELECT o_custkey, count(*) AS k FROM o GROUP BY 1) SELECT 'o' || o_orderkey AS sha FROM o JOIN c USING (o_custkey) WHERE o_custkey % 5 = 0 OR k <= o_custkey % 4 OR back <= o_custkey % 4")
def ingest_incremental(spark, d):
    """Each repo's watermark lies some commits back; one in five names a commit that its history no longer has."""
    # Stored, as a history is: it is read several times.
    commits = graph._keep(_commits(spark, d), graph.shared_dir(spark), "commits")
    lost = F.col("o_custkey") % 5 == 0
    marks = commits.where("back = 1 + o_custkey % 4").select("repo", F.when(lost, F.concat(F.lit("gone-"), "sha")).otherwise(F.col("sha")).alias("head"))
    return jobs.pending_commits(commits, commits.where("back = 1").select("repo", F.col("sha").alias("head")), marks)


@query(N + _LINE + " SELECT 'b' || o_custkey AS id, CASE WHEN o_custkey % 5 = 0 OR o_custkey % 3 = 0 OR o_custkey % 2 = 0 THEN 'Archived' ELSE 'Active' END AS status FROM o WHERE back = 1")
def reap_branches(spark, d):
    """Branches that are deleted, have another tip, or are merged are archived."""
    k = F.col("o_custkey")
    tips = _commits(spark, d).where("back = 1")
    branches = tips.select(F.concat(F.lit("b"), k.cast("string")).alias("id"), F.col("repo").alias("name"), F.col("sha").alias("tip"), F.lit("Active").alias("status"))
    live = tips.where(k % 5 != 0).select(F.col("repo").alias("name"), F.when(k % 3 == 0, "moved").otherwise(F.col("sha")).alias("tip"))
    return jobs.reap_branches(branches, live, tips.where(k % 2 == 0).select("sha")).select("id", "status")


@query("SELECT s_name || '@' || (s_suppkey + 1) AS new_key, s_name || '@' || s_suppkey AS old_key FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def redeploy_supersede(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier")
    stored = rows.select(F.concat("s_name", F.lit("@"), k).alias("key"), F.when(k % 2 == 0, "Active").otherwise("Superseded").alias("status"))
    fresh = rows.select(F.concat("s_name", F.lit("@"), k + F.when(k % 3 == 0, 1).otherwise(0)).alias("key"))
    return ingest.redeploys(stored, fresh)


@query("SELECT o_orderkey // 32 AS number, 'b' || (o_orderkey // 32) AS block, 't' || o_orderkey AS tx, 'c' || o_custkey AS address FROM orders WHERE o_custkey % 50 = 0")
def event_walk(spark, d):
    tx = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("hash"), F.concat(F.lit("C"), "o_custkey").alias("from"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c"), "o_custkey")).alias("to"))
    number = F.floor(F.col("o_orderkey") / 32)
    blocks = table(spark, d, "orders").groupBy(number.alias("number")).agg(F.collect_list(tx).alias("transactions"))
    blocks = blocks.select("number", F.concat(F.lit("b"), "number").alias("hash"), F.concat(F.lit("b"), F.col("number") - 1).alias("parent_hash"), "transactions")
    watched = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("address"))
    return ingest.block_walk(blocks, watched, spark.createDataFrame([], "number long, hash string"))["events"].select("number", "block", "tx", "address")


@query("SELECT n_name AS from_repo, r_name AS to_repo, 'DependsOn' AS kind FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 0")
def manifest_edges(spark, d):
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    repos = nations.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name")).unionByName(regions.select(F.col("r_name").alias("name")))
    depends = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("consumer"), F.col("r_name").alias("dep_repo"))
    return ingest.manifest_graph(repos, depends)[1]


# Text ------------------------------------------------------------------------------------------------------

_PATH = "CASE doc_id % 6 WHEN 0 THEN 'docs/adrs/x.md' WHEN 1 THEN 'a/sprints/RETRO.md' WHEN 2 THEN 'j/journal/d.md' WHEN 3 THEN 'e/essays/d.md' WHEN 4 THEN 'h/handoff-1.md' ELSE 'd/plain.md' END"


def _paths(spark, d):
    k = F.col("doc_id") % 6
    path = F.when(k == 0, "docs/adrs/x.md").when(k == 1, "a/sprints/RETRO.md").when(k == 2, "j/journal/d.md").when(k == 3, "e/essays/d.md").when(k == 4, "h/handoff-1.md").otherwise("d/plain.md")
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "text")


def _empty_map():
    return F.create_map().cast("map<string,string>")


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'adr' WHEN 1 THEN 'sprint:close' WHEN 2 THEN 'narrative:journal' WHEN 3 THEN 'narrative:essay' WHEN 4 THEN 'handoff' ELSE 'doc' END AS kind FROM documents WHERE {_PATH} <> ''")
def classify_doc(spark, d):
    return _paths(spark, d).select("doc_id", text.classify(F.col("path"), _empty_map(), F.col("text")).alias("kind"))


@query("SELECT doc_id, 'Title ' || doc_id AS title, source AS owner, CASE WHEN doc_id % 2 = 0 THEN 'Archived' ELSE 'Active' END AS status FROM documents")
def frontmatter(spark, d):
    head = F.concat(F.lit("---\ntitle: Title "), "doc_id", F.lit("\nowner:  "), "source", F.lit(" \nstatus: "), F.when(F.col("doc_id") % 2 == 0, "archived").otherwise("other"), F.lit("\nnot a pair\n---\n"), "text")
    fm = text.frontmatter(F.col("full"))
    return table(spark, d, "documents").select("doc_id", head.alias("full")).select("doc_id", fm["title"].alias("title"), fm["owner"].alias("owner"), text.status_of(fm).alias("status"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Heading ' || doc_id WHEN 1 THEN 'named' ELSE 'plain' END AS title FROM documents")
def doc_title(spark, d):
    k = F.col("doc_id") % 3
    fm = F.when(k == 1, F.create_map(F.lit("title"), F.lit("named"))).otherwise(_empty_map())
    own = F.when(k == 0, F.concat(F.lit("intro\n  # Heading "), "doc_id", F.lit(" \nx"))).otherwise(F.lit("#none\nx"))
    return table(spark, d, "documents").select("doc_id", text.doc_title(F.lit("a/plain.md"), fm, own).alias("title"))


@query("SELECT o_orderkey, epoch_ms(date_trunc('second', o_orderdate)) AS ms FROM orders")
def iso_ms(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.concat(stamp, F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, ".250Z").otherwise("+02:00"))
    return table(spark, d, "orders").select("o_orderkey", text.iso_ms(written).alias("ms"))


@query("SELECT doc_id, lower(source) || '-' || doc_id || '-x_y' AS slug, source || ':a.md#' || lower(source) || '-' || doc_id || '-x_y' AS citation FROM documents")
def slug_and_cite(spark, d):
    heading = F.concat("source", F.lit(" "), "doc_id", F.lit("! X_y"))
    ref = F.struct(F.lit("artifact").alias("tag"), F.col("source").alias("repo"), F.lit("a.md").alias("path"))
    return table(spark, d, "documents").select("doc_id", text.slug(heading).alias("slug"), text.cite(ref, F.concat(F.lit("Title › "), heading, F.lit("\nbody"))).alias("citation"))


@query("SELECT doc_id, CASE WHEN length(text) > 72 THEN substr(text, 1, 72) || '…' ELSE text END AS title FROM documents")
def truncate_title(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 72).alias("title"))


@query()
def chunk_documents(spark, d):
    from quillgraph.functions.chunk import chunks

    return chunks(table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("title"), "text"), "doc_id", 400)


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) <= 16000 AS fits FROM t WHERE back <= 20 GROUP BY conv_id")
def chat_window(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("back", place).where("back <= 20")
    chars = F.sum(F.length("text"))
    return kept.groupBy("conv_id").agg(F.count("*").alias("messages"), chars.alias("chars"), (chars <= 16000).alias("fits"))


@query("SELECT conv_id, coalesce(nullif(substr(trim(arg_min(text, turn) FILTER (role = 'user')), 1, 80), ''), 'Untitled') AS title FROM conversations GROUP BY conv_id")
def chat_title(spark, d):
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.nullif(F.substring(F.trim(first), 1, 80), F.lit("")), F.lit("Untitled")).alias("title"))


@query("SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id DESC LIMIT 200")
def conversation_list(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).orderBy(F.desc("turns"), F.desc("conv_id")).limit(200)


# Extras on events: windows that the engine offers beyond the graph ------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start FROM events, range(4) r(k)) SELECT start, count(*) AS n FROM w GROUP BY start")
def sliding(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes")["start"].alias("start")).agg(F.count("*").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM (SELECT event_id, epoch_us(ts) // 1000 AS t, user_id FROM events) e LEFT JOIN orders ON o_custkey = user_id AND epoch_ms(o_orderdate) <= t GROUP BY event_id")
def nearest_asof(spark, d):
    """The customer's last order at or before each event: both sides in one ordered window per customer."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), millis("ts").alias("t"), F.lit(1).alias("side"), F.col("event_id"), F.lit(None).cast("long").alias("o_orderkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), millis("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    last = F.last("o_orderkey", ignorenulls=True).over(Window.partitionBy("k").orderBy("t", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return e.unionByName(o).withColumn("found", last).where("side = 1").select("event_id", F.col("found").alias("o_orderkey"))


@query("SELECT o_orderpriority AS repo, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_report(spark, d):
    return table(spark, d, "orders").cube(F.col("o_orderpriority").alias("repo"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
