"""Approximate nearest vectors: an inverted file of cells, and exact ranking of what the nearest cells hold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors
from quillgraph.operators.graph import _keep, drop_folder, shared_dir

#: Vectors and queries in a block of a cell: a pair of blocks is scored as one matrix product.
BLOCK, QUERIES = 2048, 256
#: Candidates that a task holds before it drops those that are none of a query's best.
HELD = 1 << 17
#: Cells of an index: about the root of the number of vectors, within these bounds.
FEWEST, MOST = 16, 512


class CellIndex:
    """Cells from a bounded sample (at most `sample` vectors); every vector is assigned to its nearest cell.

    search() and search_each(), for a table of queries, score the vectors in the `probe` cells nearest to a query and go on
    to every other cell that its bound does not rule out: their results are those of scoring all vectors.  cached() keeps an index as a table from one session to the next.
    """

    def __init__(self, table: DataFrame, column: str, cells: int | None = None, probe: int = 6, sample: int = 20_000, steps: int = 10, seed: int = 7):
        self.column, self.probe, self.wide = column, probe, None
        unit = table.withColumn("_unit", vectors.normalise(F.col(column)))
        some = unit.orderBy(F.xxhash64("id")).limit(sample).select("_unit").toArrow()["_unit"]
        grid = np.array(some.to_pylist(), np.float64).reshape(len(some), -1) if len(some) else np.zeros((0, 1))
        rng = np.random.default_rng(seed)
        cells = cells or min(MOST, max(FEWEST, math.isqrt(table.count())))
        self.centres = grid[rng.permutation(len(grid))[: min(cells, len(grid))]]
        for _ in range(steps if len(grid) else 0):
            own = (grid @ self.centres.T).argmax(1)
            for k in range(len(self.centres)):
                if (own == k).any():
                    c = grid[own == k].mean(0)
                    self.centres[k] = c / (np.linalg.norm(c) or 1)
        centres = self.centres

        def assign(batches):
            for b in batches:
                rows = np.array(b["_unit"].to_pylist(), np.float64).reshape(len(b), -1)
                yield pa.record_batch([b["id"], b["_unit"], pa.array((rows @ centres.T).argmax(1).astype(np.int32) if len(b) and len(centres) else [None] * len(b), pa.int32())], ["id", "_unit", "cell"])

        kind = dict(table.dtypes)["id"]
        self.table = unit.select("id", "_unit").mapInArrow(assign, f"id {kind}, _unit array<double>, cell int")

    @classmethod
    def cached(cls, table: DataFrame, column: str, path: str, watermark: str, **fit) -> CellIndex:
        """The index of table (id, `column`) as of a watermark, read from a folder under path if it was built before.

        A folder is named by the watermark and the number of vectors, so a later state has one of its own; it counts once
        its centres are there, which are written last, and one left half-written is written anew.  Vectors lie in
        folders by cell: search() reads those of the cells that it visits only.
        """
        spark = table.sparkSession
        folder = f"{path}/{watermark}-{table.count()}"
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/centres/_SUCCESS")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            drop_folder(spark, folder)
            built = cls(table, column, **fit)
            built.table.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{folder}/vectors")
            rows = [(k, c, w, built.probe) for k, (c, w) in enumerate(zip(built.centres.tolist(), built.widths().tolist(), strict=True))]
            spark.createDataFrame(rows, "k int, centre array<double>, wide double, probe int").coalesce(1).write.parquet(f"{folder}/centres")
        own = cls.__new__(cls)
        rows = spark.read.parquet(f"{folder}/centres").orderBy("k").collect()
        own.column, own.probe, own.centres, own.wide = column, rows[0]["probe"] if rows else 0, np.array([r["centre"] for r in rows]), np.array([r["wide"] for r in rows])
        own.table = spark.read.schema(f"id {dict(table.dtypes)['id']}, _unit array<double>, cell int").parquet(f"{folder}/vectors").select("id", "_unit", "cell")
        return own

    def search(self, query: list[float], budget: int) -> DataFrame:
        """(id, score): the `budget` vectors of highest cosine, ties by id, among the probed cells and those not ruled out."""
        if not len(self.centres):  # an index of nothing
            return self.table.select("id", F.lit(0.0).alias("score")).limit(0)
        q = np.array(query, np.float64)
        q = q / (np.linalg.norm(q) or 1)
        near = self.centres @ q
        cells = np.argsort(-near)[: self.probe].tolist()
        score = vectors.dot(F.col("_unit"), F.array(*map(F.lit, q.tolist())))
        best = lambda some: self.table.where(F.col("cell").isin(some)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(budget)
        found = best(cells).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - self.widths(), 0)) + 1e-9
        open_still = bound >= found["least"] if found["n"] >= budget and q.any() else np.ones(len(near), bool)
        return best(sorted({*cells, *np.flatnonzero(open_still).tolist()}))

    def widths(self) -> np.ndarray:
        """For each cell the widest angle of a member to the centre; one pass over the vectors, then kept."""
        if self.wide is None:
            kind = dict(self.table.dtypes)["id"]
            least = self._packed(kind).groupBy("cell").agg(F.min("least").alias("least")).collect()  # one row a cell
            self.wide = np.zeros(len(self.centres))
            for r in least:
                self.wide[r["cell"]] = np.arccos(np.clip(r["least"], -1, 1))
        return self.wide

    def search_each(self, queries: DataFrame, budget: int) -> DataFrame:
        """(query_id, id, score): for each query (id, `column`) the `budget` vectors of highest cosine, ties by id.

        After the probed cells, a query visits each cell that can still hold one of its nearest: no member's
        cosine is over cos(angle to the centre - the cell's widest angle).
        """
        centres, probe, spark = self.centres, self.probe, self.table.sparkSession
        if not len(centres):
            return queries.select(F.col("id").alias("query_id")).join(self.table.select("id"), F.lit(False)).select("query_id", "id", F.lit(0.0).alias("score"))
        folder = shared_dir(spark)
        kind = dict(self.table.dtypes)["id"]
        key = dict(queries.dtypes)["id"]
        wide = self.widths()
        asked = queries.select(F.col("id").alias("query_id"), vectors.normalise(F.col(self.column)).alias("_unit"), F.lit(None).cast("double").alias("least"))

        def spread(later: bool):
            """Queries in blocks for each cell: the probed ones, or later those of the others that are not ruled out."""

            def run(batches):
                for b in batches:
                    rows = np.array(b["_unit"].to_pylist(), np.float64).reshape(len(b), -1)
                    if not len(b):
                        continue
                    near = rows @ centres.T
                    first = np.zeros(near.shape, bool)
                    np.put_along_axis(first, np.argsort(-near, 1)[:, :probe], True, 1)
                    if later:
                        least = np.array([-np.inf if x is None else x for x in b["least"].to_pylist()])
                        bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - wide, 0)) + 1e-9
                        first = ~first & ((bound >= least[:, None]) | ~rows.any(1)[:, None])
                    else:
                        least = np.full(len(rows), -np.inf)
                    for cell in range(len(centres)):
                        mine = np.flatnonzero(first[:, cell])
                        for at in range(0, len(mine), QUERIES):
                            some = mine[at : at + QUERIES]
                            yield pa.record_batch([pa.array([cell], pa.int32()), pa.array([b["query_id"].take(pa.array(some)).to_pylist()], pa.list_(b["query_id"].type)), pa.array([rows[some].tobytes()], pa.binary()), pa.array([least[some].tobytes()], pa.binary())], ["cell", "asks", "grid", "leasts"])

            return run

        def nearest(held):
            """Of candidates (queries, ids, scores) each query's `budget` best."""
            asks, names, scores = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((names, -scores, asks))
            asks = asks[order]
            first = np.r_[True, asks[1:] != asks[:-1]]
            place = np.arange(len(asks)) - np.maximum.accumulate(np.where(first, np.arange(len(asks)), 0))
            kept = order[place < budget]
            return asks[place < budget], names[kept], scores[kept]

        def score(batches):
            # Candidates of a task's blocks meet before they are yielded, up to HELD of them.
            held, n, types = [], 0, None

            def rows(best):
                return pa.record_batch([pa.array(x.tolist(), kind) for x, kind in zip(best, types, strict=True)], ["query_id", "id", "score"])

            for b in batches:
                types = b["asks"].type.value_type, b["ids"].type.value_type, pa.float64()
                for asks, grid, leasts, ids, members in zip(b["asks"].to_pylist(), b["grid"], b["leasts"], b["ids"].to_pylist(), b["members"], strict=True):
                    x = np.frombuffer(grid.as_buffer(), np.float64).reshape(len(asks), -1)
                    y = np.frombuffer(members.as_buffer(), np.float64).reshape(len(ids), -1)
                    scores = x @ y.T
                    asks, names, most = np.array(asks), np.array(ids), min(budget, len(ids))
                    # What is below a query's least score so far is none of its nearest; most blocks hold nothing else.
                    floor = np.frombuffer(leasts.as_buffer(), np.float64)
                    for k in np.flatnonzero(np.fmax.reduce(scores, 1) >= floor - 1e-11).tolist():
                        row = np.round(scores[k], 12)  # so that equal vectors tie wherever they stand
                        top = np.flatnonzero(row >= max(floor[k], np.partition(row, len(row) - most)[len(row) - most]))
                        top = top[np.lexsort((names[top], -row[top]))][:most]
                        held.append((np.repeat(asks[k : k + 1], len(top)), names[top], row[top]))
                        n += len(top)
                    if n > HELD:
                        held = [nearest(held)]
                        n = len(held[0][0])
                        if n > HELD // 2:
                            yield rows(held[0])
                            held, n = [], 0
            if n:
                yield rows(nearest(held))

        def best(found):
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            return found.withColumn("_place", place).where(F.col("_place") <= budget).drop("_place")

        def visit(some, later):
            blocks = some.mapInArrow(spread(later), f"cell int, asks array<{key}>, grid binary, leasts binary")
            # A merge holds the right side's rows of a cell: its queries, which are fewer than its members where it is large.
            pairs = self._packed(kind).join(blocks.hint("merge"), "cell").select("asks", "grid", "leasts", "ids", "members")
            return pairs.mapInArrow(score, f"query_id {key}, id {kind}, score double")

        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a pair of blocks is over 1 MB
        probed = _keep(best(visit(asked, False)), folder, "probed")
        full = probed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= budget).drop("n")
        others = asked.drop("least").join(full, "query_id", "left").select("query_id", "_unit", "least")
        return best(probed.unionByName(visit(others, True)))

    def _packed(self, kind: str) -> DataFrame:
        """(cell, ids, members, least): vectors of a cell in blocks, and the least cosine of one to the centre."""
        centres = self.centres

        def pack(batches):
            for b in batches:
                if not len(b):
                    continue
                rows, cells = np.array(b["_unit"].to_pylist(), np.float64).reshape(len(b), -1), b["cell"].to_numpy()
                for cell in np.unique(cells):
                    mine = np.flatnonzero(cells == cell)
                    for at in range(0, len(mine), BLOCK):
                        some = mine[at : at + BLOCK]
                        least = float((rows[some] @ centres[cell]).min())
                        yield pa.record_batch([pa.array([cell], pa.int32()), pa.array([b["id"].take(pa.array(some)).to_pylist()], pa.list_(b["id"].type)), pa.array([rows[some].tobytes()], pa.binary()), pa.array([least])], ["cell", "ids", "members", "least"])

        return self.table.mapInArrow(pack, f"cell int, ids array<{kind}>, members binary, least double")
