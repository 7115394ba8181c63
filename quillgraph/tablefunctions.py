"""The graph's read verbs as table functions of SQL, and chunking of any table of documents.

    register(spark, graph)
    spark.sql("select * from recall('repo', 5)")
    spark.sql("select t.id, n.* from tenants t, lateral neighbors(t.id, 20) n")
    spark.sql("select * from chunks(table(select id, title, text from docs), 400)")

Those over the graph are SQL functions over views that the DataFrame verbs' own parts make, so a call is inlined in the query
that holds it and planned with it: filters reach the scan, and a budget is a top-k.  chunks() is a Python table function,
whose rows depend on one document each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillgraph.functions.chunk import chunk_text
from quillgraph.memory import MemoryGraph
from quillgraph.operators import recall
from quillgraph.schema import edge_tag


class Chunks:
    """chunks(table(key, title, text), most): (key, chunk, breadcrumb, text, byte_start, byte_end), see functions.chunk.

    The key is the table's first column, with its own name and type; other columns beside title and text are not read.
    """

    @staticmethod
    def analyze(docs: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not docs.isTable or not isinstance(docs.dataType, T.StructType):
            raise ValueError("chunks: the first argument is a table")
        if missing := {"title", "text"} - {c.lower() for c in docs.dataType.names}:
            raise ValueError(f"chunks: the table has no column {', '.join(sorted(missing))}")
        if not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1:
            raise ValueError("chunks: the second argument is a whole number of characters from 1 on")
        key = docs.dataType.fields[0]
        made = {"chunk": T.IntegerType(), "breadcrumb": T.StringType(), "text": T.StringType(), "byte_start": T.LongType(), "byte_end": T.LongType()}
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), *(T.StructField(k, v) for k, v in made.items())]))

    def eval(self, docs: Row, most: int) -> Iterator[tuple]:
        by_name = {k.lower(): v for k, v in docs.asDict().items()}
        for i, found in enumerate(chunk_text(by_name["title"] or "", by_name["text"] or "", most)):
            yield docs[0], i, *found


def register(spark: SparkSession, graph: MemoryGraph | None = None, prefix: str = "") -> None:
    """Makes chunks() known, and with a graph, under names with a prefix, its views and the functions recall(repo, budget),
    as_of(repo, at_ms, budget), neighbors(id, budget), verify(id) and resolve(prefix).

    What the graph's readable repos do not allow is not in the views.
    """
    spark.udtf.register("chunks", F.udtf(Chunks))
    if graph is None:
        return
    graph.register(spark, prefix)
    seen = graph._seen()
    own = seen.where(F.col("kind") != "branch")
    own = own.where(~recall.is_stub(F.col("source_ref"))) if "source_ref" in seen.columns else own
    recall.item(own).createOrReplaceTempView(f"{prefix}items")
    both = graph.edges.select(F.col("from_id").alias("id"), F.lit(0).alias("direction"), F.col("to_id").alias("far_id"), "kind", "quarantined")
    both = both.unionAll(graph.edges.select(F.col("to_id").alias("id"), F.lit(1).alias("direction"), F.col("from_id").alias("far_id"), "kind", "quarantined"))
    far = both.join(graph.nodes.select(F.col("id").alias("far_id"), F.col("repo").alias("far_repo"), F.col("status").alias("far_status")), "far_id", "left")
    if graph.readable is not None:
        allowed = graph.readable.select(F.col("repo").alias("far_repo"), F.lit(True).alias("ok")).distinct()
        far = far.join(allowed, "far_repo", "left").where(F.col("far_repo").isNull() | F.col("ok")).drop("ok")
    far.select("id", "direction", "far_id", "kind", "quarantined", "far_repo", "far_status", edge_tag(F.col("kind")).alias("tag")).createOrReplaceTempView(f"{prefix}adjacent")
    graph.verify().createOrReplaceTempView(f"{prefix}verdicts")
    _function(spark, f"{prefix}recall", "p_repo STRING, p_budget INT", f"{prefix}items", "repo = p_repo", "valid_from DESC, id")
    _function(spark, f"{prefix}as_of", "p_repo STRING, p_at BIGINT, p_budget INT", f"{prefix}items", "repo = p_repo AND plane = 'Derived' AND valid_from <= p_at AND (valid_to IS NULL OR valid_to > p_at)", "valid_from DESC, id")
    _function(spark, f"{prefix}neighbors", "p_id STRING, p_budget INT", f"{prefix}adjacent", "id = p_id", "direction, far_id, tag", ("id", "tag"))
    _function(spark, f"{prefix}verify", "p_id STRING", f"{prefix}verdicts", "id = p_id")
    _function(spark, f"{prefix}resolve", "p_prefix STRING", f"{prefix}items", "startswith(id, p_prefix)")


def _function(spark: SparkSession, name: str, takes: str, view: str, where: str, order: str | None = None, leave: tuple[str, ...] = ()) -> None:
    """A temporary table function: the rows of a view where a condition on its parameters holds, the first of them by an order."""
    kinds = [f for f in spark.table(view).schema if f.name not in leave]
    shown = ", ".join(f"`{f.name}`" for f in kinds)
    rows = f"SELECT * FROM {view} WHERE {where}"
    if order:
        rows = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS _place FROM {view} WHERE {where}) WHERE _place <= p_budget"
    returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({returns}) RETURN SELECT {shown} FROM ({rows})")
