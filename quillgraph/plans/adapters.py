"""The driver's tables as graph tables: orders are bitemporal nodes, lines are edges, documents are passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str) -> Column:
    """A time stamp without zone, which the tables mean as UTC, as an instant in any session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def millis(column: str) -> Column:
    return F.unix_millis(instant(column))


def hashed(prefix: str, column: str):
    return F.sha2(F.concat(F.lit(prefix), F.col(column).cast("string")), 256)


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit of its customer in the tenant of its priority; it holds until its last shipment."""
    orders = table(spark, sf_dir, "orders")
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    status = F.when(F.col("o_orderstatus") == "F", "Superseded").when(F.col("o_orderstatus") == "P", "Archived").otherwise("Active")
    key = F.col("o_orderkey")
    return orders.join(ships, key == F.col("l_orderkey"), "left").select(
        hashed("order:", "o_orderkey").alias("id"),
        F.when(key % 5 == 0, "Asserted").otherwise("Derived").alias("plane"),
        F.lit("commit").alias("kind"),
        F.col("o_orderpriority").alias("repo"),
        F.concat(F.lit("customer#"), F.col("o_custkey").cast("string")).alias("author"),
        F.encode(F.concat(F.lit("order "), key.cast("string")), "UTF-8").alias("content"),
        millis("o_orderdate").alias("valid_from"),
        millis("shipped").alias("valid_to"),
        F.when(key % 5 == 0, F.when(key % 2 == 0, "AgentAsserted").otherwise("InferredAdvisory")).otherwise("DerivedDeterministic").alias("trust_tier"),
        F.when(key % 10 == 0, F.encode(F.lit("sig"), "UTF-8")).alias("signature"),
        F.array((key % 4).cast("tinyint"), (key % 3).cast("tinyint")).alias("confidence"),
        status.alias("status"),
        F.col("o_orderkey"),
        F.col("o_custkey"),
    )


#: The same in SQL, for the oracle.
NODES_SQL = """
n AS (
  SELECT sha256('order:' || o_orderkey) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Asserted' ELSE 'Derived' END AS plane, 'commit' AS kind,
         o_orderpriority AS repo, 'customer#' || o_custkey AS author, 'order ' || o_orderkey AS title,
         epoch_ms(o_orderdate) AS valid_from, epoch_ms(shipped) AS valid_to,
         CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'AgentAsserted' ELSE 'InferredAdvisory' END ELSE 'DerivedDeterministic' END AS trust_tier,
         o_orderkey % 10 = 0 AS signed, [CAST(o_orderkey % 4 AS TINYINT), CAST(o_orderkey % 3 AS TINYINT)] AS confidence,
         CASE o_orderstatus WHEN 'F' THEN 'Superseded' WHEN 'P' THEN 'Archived' ELSE 'Active' END AS status, o_orderkey, o_custkey
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def spine_edges(nodes: DataFrame) -> DataFrame:
    """From each order to the customer's order before it: the spine, and on some a claim about it."""
    # Keys are shuffled and made ids afterwards: a digest takes eight times the space of a key and does not compress.
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey"))
    linked = nodes.select("o_orderkey", "valid_from", before.alias("before")).where("before is not null")
    key = F.col("o_orderkey")
    kinds = F.array_compact(F.array(F.lit("TemporalNext"), F.when(key % 7 == 0, "Supersedes"), F.when(key % 11 == 0, "Refutes"), F.when(key % 13 == 0, "Contradicts")))
    each = linked.select(hashed("order:", "o_orderkey").alias("from_id"), hashed("order:", "before").alias("to_id"), F.explode(kinds).alias("kind"), key, F.col("valid_from").alias("at"))
    return each.select("from_id", "to_id", "kind", ((F.col("kind") != "TemporalNext") & (key % 3 == 0)).alias("quarantined"), "at")


SPINE_SQL = """
p AS (SELECT id, o_orderkey, valid_from, lag(id) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderkey) AS to_id FROM n),
e AS (
  SELECT id AS from_id, to_id, k.kind, k.kind <> 'TemporalNext' AND o_orderkey % 3 = 0 AS quarantined, valid_from AS at
  FROM p, (VALUES ('TemporalNext', 1), ('Supersedes', 7), ('Refutes', 11), ('Contradicts', 13)) k(kind, m)
  WHERE to_id IS NOT NULL AND o_orderkey % k.m = 0)"""


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders to parts: kind by return flag, a proposal for large open lines."""
    kind = F.when(F.col("l_returnflag") == "A", "Touches").when(F.col("l_returnflag") == "N", "DependsOn").otherwise("References")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", kind.alias("kind"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).alias("quarantined"))
    # Grouped by the keys and made ids afterwards, see spine_edges.
    rows = rows.groupBy("l_orderkey", "l_partkey", "kind").agg(F.bool_and("quarantined").alias("quarantined"))
    return rows.select(hashed("order:", "l_orderkey").alias("from_id"), hashed("part:", "l_partkey").alias("to_id"), "kind", "quarantined")


LINES_SQL = """
le AS (
  SELECT sha256('order:' || l_orderkey) AS from_id, sha256('part:' || l_partkey) AS to_id,
         CASE l_returnflag WHEN 'A' THEN 'Touches' WHEN 'N' THEN 'DependsOn' ELSE 'References' END AS kind,
         bool_and(l_linestatus = 'O' AND l_quantity > 45) AS quarantined
  FROM lineitem GROUP BY ALL)"""


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(hashed("part:", "p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.lit("doc").alias("kind"), F.lit("Active").alias("status"))


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as nodes of the tenant of their label."""
    data = F.struct(F.lit("v1").alias("model"), F.col("embedding").alias("data"))
    return table(spark, sf_dir, "embeddings").select(hashed("vec:", "vec_id").alias("id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("repo"), data.alias("embedding"), "vec_id")


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a passage of the tenant of its source."""
    ref = F.struct(F.lit("artifact").alias("tag"), F.col("source").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return table(spark, sf_dir, "documents").select(hashed("doc:", "doc_id").alias("id"), F.col("source").alias("repo"), F.lit("doc").alias("kind"), F.col("lang").alias("author"), ref.alias("source_ref"), "text", "doc_id")


def geography_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers depend on nations, nations on regions."""
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("from_id"), F.concat(F.lit("n"), "c_nationkey").alias("to_id"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("from_id"), F.concat(F.lit("n"), "s_nationkey").alias("to_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("from_id"), F.concat(F.lit("r"), "n_regionkey").alias("to_id"))
    return customer.union(supplier).union(nation)


GEO_SQL = """
ge AS (
  SELECT 'c' || c_custkey AS from_id, 'n' || c_nationkey AS to_id FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
