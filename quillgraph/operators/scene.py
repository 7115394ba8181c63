"""Layouts: ring, principal components, and a scene of nodes and edges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import packed, unpacked
from quillgraph.functions.text import truncate
from quillgraph.operators.anchor import positions
from quillgraph.operators.graph import contradicted, degrees, inside


def ring(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """(id, x, y, z): nodes around a circle in order of id, numbered by range partitions."""
    n = total if total is not None else nodes.count()
    angle = F.col("pos").cast("double") * F.lit(2 * math.pi / max(n, 1))
    return positions(nodes.select("id"), ["id"]).select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"), (F.sin(angle * 2) * 0.3).alias("z"))


def moments(vectors: DataFrame, column: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of array columns: dim * dim sums, added up in the executors."""

    def run(batches):
        import pyarrow as pa

        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, c = n + len(flat), s + flat.sum(0), c + flat.T @ flat
        yield pa.record_batch([pa.array(range(dim + 1), pa.int32()), pa.array([[float(n)], *c.tolist()], pa.list_(pa.float64())), pa.array([s.tolist(), *[[]] * dim], pa.list_(pa.float64()))], ["row", "values", "sums"])

    fit = vectors.where(F.size(column) == dim).select(F.transform(column, lambda x: x.cast("double")).alias("v"))
    parts = fit.mapInArrow(run, "row int, values array<double>, sums array<double>")
    cells = parts.select("row", F.posexplode("values").alias("k", "v")).groupBy("row", "k").agg(F.sum("v").alias("v")).collect()  # dim * dim + 1 rows
    sums = parts.where("row = 0").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    n = int(next((r["v"] for r in cells if r["row"] == 0), 0))
    total, squares = np.zeros(dim), np.zeros((dim, dim))
    for r in sums:
        total[r["k"]] = r["v"]
    for r in cells:
        if r["row"]:
            squares[r["row"] - 1, r["k"]] = r["v"]
    mean = total / max(n, 1)
    return n, mean, squares - n * np.outer(mean, mean)


def components(covariance: np.ndarray, count: int = 3, steps: int = 64) -> np.ndarray:
    """Leading directions by power iteration with deflation; a zero matrix gives zero directions."""
    left, out = covariance.copy(), []
    for k in range(count):
        v = np.cos(np.arange(len(left)) + 1.0 + k)
        v /= np.linalg.norm(v)
        for _ in range(steps):
            w = left @ v
            size = np.linalg.norm(w)
            if size < 1e-12:
                v = np.zeros(len(left))
                break
            v = w / size
        out.append(v)
        left = left - (v @ left @ v) * np.outer(v, v)
    return np.array(out)


def project(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """(id, x, y, z): vectors on their three principal components, each axis scaled to at most 1."""
    _, mean, covariance = moments(vectors, column, dim)
    axes = components(covariance)
    fit = vectors.where(F.size(column) == dim)
    centred = F.zip_with(F.transform(column, lambda x: x.cast("double")), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    along = lambda a: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, a.tolist())), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    raw = fit.select("id", *[along(a).alias(c) for a, c in zip(axes, "xyz", strict=True)])
    most = raw.agg(*[F.max(F.abs(c)).alias(c) for c in "xyz"]).first()
    return raw.select("id", *[(F.col(c) / F.lit(most[c]) if most[c] else F.lit(0.0)).alias(c) for c in "xyz"])


def scene(nodes: DataFrame, edges: DataFrame, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with place, degree, contradiction flag and short title, and the edges between them."""
    kept = inside(edges, nodes)
    embedded = nodes.where(F.size(column) == dim)
    place = project(embedded, column, dim) if len(embedded.take(3)) == 3 else ring(nodes)
    torn = contradicted(nodes, edges).withColumn("contradicted", F.lit(True))
    coded = lambda df: df.withColumn("id", packed(F.col("id")))
    out = coded(nodes).join(coded(place), "id", "left").join(coded(degrees(kept)), "id", "left").join(coded(torn), "id", "left").withColumn("id", unpacked(F.col("id")))
    title = truncate(F.decode("content", "UTF-8"), 140)
    return out.select("id", "repo", "status", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"], F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("contradicted", F.lit(False)).alias("contradicted"), title.alias("title")), kept


def scene_nodes(nodes: DataFrame, federation: str, most: int = 1500) -> DataFrame:
    """What a scene shows: the federation tenant if it has two nodes or more, else the first by id."""
    own = nodes.where(F.col("repo") == federation)
    return own if len(own.take(2)) == 2 else nodes.orderBy("id").limit(most)


def analogues(nodes: DataFrame, edges: DataFrame, node_id: str, most: int = 4) -> DataFrame:
    """AnalogousTo neighbours, else nodes of the same kind in other repos by degree."""
    linked = edges.where("kind = 'AnalogousTo'").where((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
    far = linked.select(F.when(F.col("from_id") == node_id, F.col("to_id")).otherwise(F.col("from_id")).alias("id")).distinct()
    ranked = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if not far.isEmpty():
        return ranked.join(far, "id", "left_semi").orderBy(F.desc("degree"), "id").limit(most).select("id", "degree")
    own = nodes.where(F.col("id") == node_id).select("kind", "repo").first()
    return ranked.where((F.col("kind") == own["kind"]) & (F.col("repo") != own["repo"])).orderBy(F.desc("degree"), "id").limit(most).select("id", "degree")


def layout(nodes: DataFrame, style: str) -> DataFrame:
    """(id, x, y) by tenant index and place within the tenant: lattice, galaxy, islands or river."""
    repos = nodes.select("repo").distinct()
    index = repos.select("repo", (F.row_number().over(Window.orderBy("repo")) - 1).alias("t"))
    placed = nodes.join(index, "repo").withColumn("i", F.row_number().over(Window.partitionBy("repo").orderBy("valid_from", "id")) - 1)
    t, i = F.col("t").cast("double"), F.col("i").cast("double")
    golden = math.pi * (3 - math.sqrt(5))
    x, y = {
        "lattice": (i % 16, t * 20 + F.floor(i / 16)),
        "galaxy": (F.sqrt(i + 1) * F.cos(i * golden + t), F.sqrt(i + 1) * F.sin(i * golden + t)),
        "islands": (t % 4 * 40 + F.sqrt(i) * F.cos(i * golden), F.floor(t / 4) * 40 + F.sqrt(i) * F.sin(i * golden)),
        "river": (F.col("valid_from") / 86_400_000.0, t * 4 + F.sin(i)),
    }[style]
    return placed.select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))
