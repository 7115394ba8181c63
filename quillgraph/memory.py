"""One object with the read and write verbs over a graph's tables; every verb returns a DataFrame."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import vectors
from quillgraph.operators import ann, assertions, graph, jobs, merge, recall, scene, supersede

#: Budgets of the verbs, and the most that may be asked for.
BUDGETS = {"recall": 15, "search": 10, "neighbors": 20, "as_of": 15, "critique": 15, "analogy": 5}
MOST, MOST_ANALOGIES, MOST_NODES, MOST_EDGES, MOST_BYTES = 500, 50, 10_000, 50_000, 4 << 20


class MemoryGraph:
    """nodes and edges with the columns of quillgraph.schema; readable: repos (repo) that may be seen, or None for all;
    meta (repo, key, value, at): watermarks and who brought in which proposal."""

    counters: DataFrame | None = None
    outcomes: DataFrame | None = None

    def __init__(self, nodes: DataFrame, edges: DataFrame, readable: DataFrame | None = None, meta: DataFrame | None = None):
        self.nodes, self.edges, self.readable = nodes, edges, readable
        self.meta = nodes.sparkSession.createDataFrame([], jobs.META) if meta is None else meta

    def _budget(self, verb: str, asked: int | None) -> int:
        most = MOST_ANALOGIES if verb == "analogy" else MOST
        return min(most, max(1, asked if asked is not None else BUDGETS[verb]))

    def _seen(self) -> DataFrame:
        return self.nodes if self.readable is None else self.nodes.join(self.readable.select("repo").distinct(), "repo", "left_semi")

    def recall(self, repo: str, budget: int | None = None, in_flight: DataFrame | None = None) -> DataFrame:
        return recall.item(recall.storyline(recall.tenant(self._seen(), repo, in_flight), self._budget("recall", budget)))

    def search(self, repo: str, query: list[float], model: str, budget: int | None = None) -> DataFrame:
        return recall.search(recall.tenant(self._seen(), repo), query, model, self._budget("search", budget))

    def search_cached(self, repo: str, query: list[float], model: str, path: str, watermark: str, budget: int | None = None) -> DataFrame:
        """search() through an index of the tenant's vectors as of a watermark, kept under path: only cells that may hold
        one of the nearest are read."""
        most, data = self._budget("search", budget), F.col("embedding.data")
        own = recall.tenant(self._seen(), repo).where((F.col("embedding.model") == model) & (F.size(data) == len(query)) & vectors.finite(data))
        if own.isEmpty():
            return recall.search(own, query, model, most)
        place = hashlib.sha256(json.dumps([repo, model, len(query)]).encode()).hexdigest()[:32]
        index = ann.CellIndex.cached(own.select("id", data.alias("data")), "data", f"{path}/{place}", watermark)
        return own.join(index.search(query, most), "id").orderBy(F.desc("score"), "id")

    def neighbors(self, node_id: str, budget: int | None = None) -> DataFrame:
        return recall.neighbors(self.nodes, self.edges, node_id, self._budget("neighbors", budget), self.readable)

    def as_of(self, repo: str, at_ms: int, budget: int | None = None, asserted: bool = False) -> DataFrame:
        return recall.item(recall.as_of(recall.tenant(self._seen(), repo), at_ms, self._budget("as_of", budget), asserted))

    def verify(self, node_id: str | None = None) -> DataFrame:
        nodes = self._seen() if node_id is None else self._seen().where(F.col("id") == node_id)
        edges = self.edges if node_id is None else self.edges.where(F.col("to_id") == node_id)
        return recall.verify(nodes, edges, self.readable) if node_id is None or self.readable is None else recall.verify(self.nodes, edges, self.readable).where(F.col("id") == node_id)

    def critique(self, repo: str, budget: int | None = None) -> DataFrame:
        own = recall.tenant(self._seen(), repo)
        return recall.critique(recall.storyline(own, self._budget("critique", budget)), own.count(), self.edges, self.nodes, self.readable)

    def analogy(self, anchor_id: str, budget: int | None = None) -> DataFrame:
        repos = self.readable if self.readable is not None else self.nodes.select("repo").distinct()
        return recall.analogies(self.nodes, self.edges, anchor_id, repos, self._budget("analogy", budget))

    def resolve(self, prefix: str) -> DataFrame:
        return recall.resolve_prefix(self._seen(), prefix)

    def reachable(self, node_id: str, kind: str) -> DataFrame:
        start = self.nodes.sparkSession.createDataFrame([(node_id,)], "id string")
        return graph.reachable(self.edges.where(F.col("kind") == kind), start)

    def _with(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, meta: DataFrame | None = None) -> MemoryGraph:
        return MemoryGraph(self.nodes if nodes is None else nodes, self.edges if edges is None else edges, self.readable, self.meta if meta is None else meta)

    def propose(self, edges: DataFrame, writer: str | None = None, at_ms: int = 0) -> MemoryGraph:
        """With the edges as proposals; confirmed ones stay confirmed.  Who brings in a proposal that contests a node is kept."""
        loose = edges.withColumn("quarantined", F.lit(True))
        meta = self.meta
        if writer is not None:
            repos = self.nodes.select(F.col("id").alias("to_id"), "repo")
            records = jobs.inserter_records(loose.drop("repo").join(repos, "to_id"), writer, at_ms)
            meta = jobs.meta_put(meta, records)
        # Stored, as each verb after it reads them several times.
        return self._with(edges=self._stored(supersede.upsert_edges(self.edges, loose)), meta=self._stored(meta))

    def _stored(self, df: DataFrame) -> DataFrame:
        return graph._keep(df, graph.shared_dir(self.nodes.sparkSession), "stored")

    def confirm(self, keys: DataFrame, at_ms: int, writer: str | None = None) -> MemoryGraph:
        """With the proposals of the keys confirmed that the writer may confirm and that pass the guards; supersessions retire
        their targets.  The others stay proposals; `outcomes` of the result has each key's fate, see supersede.confirm_outcomes."""
        outcomes = supersede.confirm_outcomes(self.nodes, self.edges, keys, at_ms, writer, self.meta)
        out = self._with(*supersede.apply_outcomes(self.nodes, self.edges, outcomes, at_ms))
        out.outcomes = outcomes
        return out

    def merge(self, nodes: DataFrame, edges: DataFrame, grants: DataFrame | None = None, keys: DataFrame | None = None) -> MemoryGraph:
        """With another replica's nodes and edges merged in, see merge.merge_bundle; `counters` of the result has what was done.

        grants (repo, can_write) must cover every repo that the bundle touches, keys (author, key) verify its asserted items;
        None on either is for a replica of one's own.
        """
        if grants is not None:
            self._authorize(nodes, edges, grants)
        after, links, counters = merge.merge_bundle(self.nodes, self.edges, nodes, edges, keys)
        out = self._with(after, links)
        out.counters = counters
        return out

    def _authorize(self, nodes: DataFrame, edges: DataFrame, grants: DataFrame) -> None:
        barred = merge.unwritable(nodes, edges, self.nodes, grants).agg(F.count("*").alias("n"), F.min("repo").alias("repo")).first()
        if barred["n"]:
            raise PermissionError(f"no write grant for {barred['n']} repos, such as {barred['repo']}")

    def assert_diff(self, nodes: DataFrame, edges: DataFrame, keys: DataFrame, writer: str, at_ms: int) -> MemoryGraph:
        """With a signed diff of a writer (keys: author, key): all of it, or an error that names a reason."""
        judged = assertions.judge_diff(self.nodes, self.edges, assertions.check_nodes(nodes, keys), assertions.check_edges(edges, keys), writer, at_ms)
        repos = self.nodes.select("id", "repo").unionByName(nodes.select("id", "repo")).dropDuplicates(["id"])
        records = jobs.inserter_records(edges.drop("repo").join(repos.withColumnRenamed("id", "to_id"), "to_id"), writer, at_ms)
        return self._with(*assertions.apply_diff(self.nodes, self.edges, judged, at_ms), jobs.meta_put(self.meta, records))

    def merge_diff(self, nodes: DataFrame, edges: DataFrame, grants: DataFrame, keys: DataFrame, writer: str, at_ms: int) -> MemoryGraph:
        """assert_diff of some items, at most MOST_NODES, MOST_EDGES and MOST_BYTES as JSON, if the grants (repo, can_write) cover every repo that it touches."""
        if nodes.count() > MOST_NODES or edges.count() > MOST_EDGES:
            raise ValueError("a diff may hold 10,000 nodes and 50,000 edges")
        held = [df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] for df in (nodes, edges)]
        if held == [None, None]:
            raise ValueError("an empty diff")
        if sum(n or 0 for n in held) > MOST_BYTES:
            raise ValueError("a diff may hold 4 MiB")
        self._authorize(nodes, edges, grants)
        return self.assert_diff(nodes, edges, keys, writer, at_ms)

    def review(self, repo: str, budget: int | None = None) -> DataFrame:
        return recall.review(recall.tenant(self._seen(), repo), self._budget("recall", budget))

    def total(self, repo: str) -> int:
        """How many nodes a tenant has, whatever a recall or as_of shows of them."""
        return recall.tenant(self._seen(), repo).count()

    def health(self) -> DataFrame:
        """(nodes, edges, proposals, tenants)."""
        edges = self.edges.agg(F.count("*").alias("edges"), F.count_if("quarantined").alias("proposals"), F.lit(1).alias("one"))
        nodes = self._seen().agg(F.count("*").alias("nodes"), F.count_distinct("repo").alias("tenants"), F.lit(1).alias("one"))
        return nodes.join(edges, "one").select("nodes", "edges", "proposals", "tenants")

    def layout(self, dim: int = 256) -> tuple[DataFrame, DataFrame]:
        """The scene's nodes with places by their vectors of this size (or on a ring), and the edges between them."""
        return scene.scene(self._seen().withColumn("vector", F.col("embedding.data")), self.edges, "vector", dim)

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        """Temporary views for SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
