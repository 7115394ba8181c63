"""Corpus builds and imports: documents to nodes, chunks and edges, and checks of what is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.functions.chunk import chunks
from quillgraph.functions.ids import node_preimage, sha2_id, source_bytes
from quillgraph.sources.files import Snapshots


def _with_id(rows: DataFrame) -> DataFrame:
    made = node_preimage(F.lit("derived"), F.col("kind"), F.col("repo"), F.col("author"), source_bytes(F.col("source_ref")), F.col("content"))
    return rows.withColumn("id", sha2_id(made))


def _ref(start, end):
    return F.struct(F.lit("artifact").alias("tag"), F.col("repo"), F.col("path"), F.col("git_sha"), F.lit(None).cast("string").alias("sha"), start.cast("long").alias("byte_start"), end.cast("long").alias("byte_end"), F.lit(None).cast("string").alias("key"))


def document_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (repo, path, git_sha, text): kind and title by content, directives as edges.

    A document is never an authority: its Supersedes and Refutes directives are proposals.
    """
    fm, body = text.frontmatter(F.col("text")), text.body(F.col("text"))
    parsed = docs.withColumn("fm", fm).withColumn("body", body)
    title = text.doc_title(F.col("path"), F.col("fm"), F.col("body"))
    rows = parsed.select("repo", "path", "git_sha", text.classify(F.col("path"), F.col("fm"), F.col("body")).alias("kind"), F.lit("docs").alias("author"), title.alias("title"), text.status_of(F.col("fm")).alias("status"), text.iso_ms(F.try_element_at("fm", F.lit("created"))).alias("created_ms"), text.preview(F.col("body")).alias("preview"), text.directive_blocks(F.col("body")).alias("pairs"))
    rows = rows.withColumn("source_ref", _ref(F.lit(0), F.lit(0))).withColumn("content", F.encode("title", "UTF-8"))
    nodes = _with_id(rows)
    each = nodes.select(F.col("id").alias("from_id"), F.explode("pairs").alias("p"))
    edges = each.select("from_id", F.col("p.value").alias("target"), text.directive_kind(F.col("p.key")).alias("kind")).where("kind is not null")
    return nodes.drop("pairs"), edges.withColumn("quarantined", F.col("kind").isin("Supersedes", "Refutes"))


def build(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """File and chunk nodes of documents (repo, path, git_sha, text), chunks DerivedFrom their file."""
    title = text.corpus_title(F.col("path"), F.try_element_at(text.frontmatter(F.col("text")), F.lit("title")), text.body(F.col("text")))
    named = docs.select("repo", "path", "git_sha", title.alias("title"), "text", F.concat(F.lit("corpus:"), "repo").alias("author"))
    files = _with_id(named.select("repo", "path", "git_sha", "author", F.lit("doc").alias("kind"), F.encode("title", "UTF-8").alias("content"), F.octet_length("text").alias("size")).withColumn("source_ref", _ref(F.lit(0), F.col("size"))))
    key = named.withColumn("_key", F.to_json(F.struct("repo", "path", "git_sha", "author")))
    parts = chunks(key.select("_key", "title", "text"), "_key", most)
    own = parts.withColumn("k", F.from_json("_key", "repo string, path string, git_sha string, author string")).select("k.*", F.lit("doc").alias("kind"), F.encode(F.concat_ws("\n", "breadcrumb", "text"), "UTF-8").alias("content"), "byte_start", "byte_end")
    pieces = _with_id(own.withColumn("source_ref", _ref(F.col("byte_start"), F.col("byte_end"))))
    columns = ["id", "repo", "path", "kind", "author", "source_ref", "content"]
    edges = pieces.join(files.select("repo", "path", F.col("id").alias("to_id")), ["repo", "path"]).select(F.col("id").alias("from_id"), "to_id", F.lit("DerivedFrom").alias("kind"))
    return files.select(*columns).unionByName(pieces.select(*columns)), edges


def violations(nodes: DataFrame) -> DataFrame:
    """Nodes that an import must not carry: only derived, deterministic, unsigned, active corpus nodes may come."""
    plain = (F.col("plane") == "Derived") & (F.col("trust_tier") == "DerivedDeterministic") & F.col("signature").isNull() & (F.col("status") == "Active") & F.startswith(F.col("author"), F.lit("corpus:"))
    return nodes.where(~F.coalesce(plain, F.lit(False)))


def import_tenant(store: Snapshots, repo: str, digest: str, nodes: DataFrame, edges: DataFrame) -> bool:
    """Lands a tenant unless this digest already has; nodes, edges and the digest count together, with one manifest."""
    spark = nodes.sparkSession
    done = store.current("imports", "repo string, digest string")
    if not done.where((F.col("repo") == repo) & (F.col("digest") == digest)).isEmpty():
        return False
    if not violations(nodes).isEmpty():
        raise ValueError(f"{repo}: nodes that are no plain corpus nodes")
    marks = done.where(F.col("repo") != repo).unionByName(spark.createDataFrame([(repo, digest)], "repo string, digest string"))
    store.commit_all({f"nodes-{repo}": nodes, f"edges-{repo}": edges, "imports": marks})
    return True
