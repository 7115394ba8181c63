"""Exact top-k by MaxScore over integer vectors whose components are terms.

Candidates are held in shards, each with one posting column per term: the impacts of its vectors there.
For a query, a term's contribution is shifted by the shard's smallest one, so that all are at least 0 and
have an upper bound; terms whose bounds together cannot lift a vector to the current threshold are not
essential.  Essential columns are traversed for all vectors of the shard; the others are probed, largest
bound first, only for vectors that can still reach the threshold.  Vectors that could tie with it are kept,
so results are exact.  The shards' best rows are merged by (score descending, vec_id ascending).

Queries come in blocks and vectors in shards.  Each block first meets one shard; the k-th scores found there
are the thresholds with which it meets each other shard, through a join on the pair of their numbers, so no
task holds more than one block and one shard.

Components are whole numbers of any size: a pair of block and shard is scored in 64 bits where a bound on its sums
shows that they fit, else in Python's integers.  Ranks follow the exact scores; a score beyond +-(2**63 - 1) is
shown as that.

Vectors that are null, hold null or non-finite components, or components that are not finite once scaled, and
rows without an id take no part, as query or candidate.  A query never gets its own row; other rows that repeat its
id, or its vector, are candidates like any other, and each row of a repeated query id has ranks of its own.
Vectors of other lengths are read as if the missing components were 0.  An empty table, or one without
queries, gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, numbered, release, remove, scratch_dir, table

#: The largest score that a long shows; sums whose bound is under SAFE are exact in 64 bits.
MOST, SAFE = (1 << 63) - 1, 1 << 61
SHARD_ROWS, BLOCK_ROWS, STRIP, PROBE = 4096, 4096, 512, 8


def _best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places in the order of (score descending, id)."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)


class Shard:
    """Posting columns of one shard: terms x vectors of whole numbers, with each term's least and largest impact."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.postings = rows[order], ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = (self.postings.min(1), self.postings.max(1)) if vectors.size else (self.postings[:, 0:0].sum(1),) * 2

    def top(self, query_row: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best by score, ties to the smaller id; floor: a known k-th score, none under it.

        Vectors come in ascending ids, a strip at a time; the first strip is scored whole and sets the
        threshold, which each strip may raise for those that follow.
        """
        q = q[: len(self.postings)]
        least = np.where(q >= 0, q * self.low[: len(q)], q * self.high[: len(q)])
        bound = np.where(q >= 0, q * self.high[: len(q)], q * self.low[: len(q)]) - least
        base = int(least.sum())
        terms = np.argsort(-bound, kind="stable")
        ordered = q[terms]
        rest = np.append(bound[terms][::-1].cumsum()[::-1], 0)  # what terms[i:] can add at most
        offset = np.append(0, least[terms].cumsum())
        need = None if floor is None else floor - base
        ids, scores = self.ids[:0], np.zeros(0, self.postings.dtype)
        for lo in range(0, len(self.ids), STRIP):
            strip = self.postings[:, lo : lo + STRIP]
            alive = np.flatnonzero(self.rows[lo : lo + STRIP] != query_row)
            # Essential: the fewest terms without which no vector can reach the threshold.
            done = len(terms) if need is None else int(np.searchsorted(-rest, -need, "right"))
            done = min(done, len(terms))
            part = ordered[:done] @ strip[terms[:done]] - int(offset[done]) if done else np.zeros(strip.shape[1], self.postings.dtype)
            while need is not None:
                alive = alive[part[alive] + rest[done] >= need]
                if done == len(terms) or not len(alive):
                    break
                some = terms[done : done + PROBE]
                part[alive] += ordered[done : done + PROBE] @ strip[np.ix_(some, alive)] - int(least[some].sum())
                done += len(some)
            ids = np.concatenate([ids, self.ids[lo + alive]])
            scores = np.concatenate([scores, part[alive]])
            if len(ids) > k:
                order = _best(ids, scores)[:k]
                ids, scores = ids[order], scores[order]
            if len(ids) == k:
                need = max(int(scores.min()), need if need is not None else int(scores.min()))
        order = _best(ids, scores)
        return ids[order], scores[order] + base


def quantise(vectors: DataFrame, key: str, column: str, scale: float, *more: str) -> DataFrame:
    """(id, v array<double>, more columns) of the rows that take part: scale * x with x as double; top_k takes its floor."""
    x = F.transform(F.col(f"`{column}`"), lambda c: F.lit(float(scale)) * c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("v"), *more)
    return rows.where(F.col("v").isNotNull() & fine)


def _block(name: str, number: int, rows: list[int], ids: list[int], vs: list[np.ndarray]) -> pa.RecordBatch:
    """One row: rows' numbers and ids as bytes, and a grid of their vectors: 32-bit integers, or doubles if wider."""
    width = max(map(len, vs), default=0)
    grid = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        grid[i, : len(v)] = v
    wide = bool(width and np.abs(grid).max() >= 1 << 31)
    raw = grid.astype("<f8" if wide else "<i4").tobytes()
    cells = [pa.array([number], pa.int64()), pa.array([np.array(rows, "<i8").tobytes()]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([width], pa.int32()), pa.array([wide]), pa.array([raw], pa.binary())]
    return pa.record_batch(cells, [name, *(f"{name}_{c}" for c in ("rows", "ids", "width", "wide", "v"))])


def _kinds(name: str) -> str:
    return f"{name} long, {name}_rows binary, {name}_ids binary, {name}_width int, {name}_wide boolean, {name}_v binary"


def _unpacked(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_ids"], "<i8")
    grid = np.frombuffer(row[f"{name}_v"], "<f8" if row[f"{name}_wide"] else "<i4").reshape(len(ids), row[f"{name}_width"])
    return np.frombuffer(row[f"{name}_rows"], "<i8"), ids, grid


def _flat(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = values.offsets.to_numpy()
    return np.floor(values.flatten().to_numpy(zero_copy_only=False)), at - at[0]


def _shards(rows: DataFrame) -> DataFrame:
    """Rows (id, v, asks) of each partition in shards of up to SHARD_ROWS, with asks as bytes; rows are numbered shard << 12 | place."""

    def run(batches):
        from pyspark import TaskContext

        release()
        n, ids, vs, asks = TaskContext.get().partitionId() << 24, [], [], []

        def made():
            numbers = [n << 12 | i for i in range(len(ids))]
            return _block("shard", n, numbers, ids, vs).append_column("asks", pa.array([bytes(asks)], pa.binary()))

        for b in batches:
            flat, at = _flat(b["v"])
            for i, (key, ask) in enumerate(zip(b["id"].to_pylist(), b["asks"].to_pylist(), strict=True)):
                ids.append(key)
                vs.append(flat[at[i] : at[i + 1]].copy())
                asks.append(bool(ask))
                if len(ids) == SHARD_ROWS:
                    yield made()
                    n, ids, vs, asks = n + 1, [], [], []
        if ids:
            yield made()

    return rows.mapInArrow(run, _kinds("shard") + ", asks binary")


def _blocks(shards: DataFrame) -> DataFrame:
    """The rows of shards that ask, in dense blocks of about BLOCK_ROWS."""

    def pick(batches):
        release()
        for b in batches:
            for row in b.to_pylist():
                numbers, ids, grid = _unpacked(row, "shard")
                some = np.flatnonzero(np.frombuffer(row["asks"], np.uint8))
                if len(some):
                    yield pa.record_batch([pa.array(numbers[some]), pa.array(ids[some]), pa.array(grid[some].astype(np.float64).tolist(), pa.list_(pa.float64()))], ["row", "id", "v"])

    def pack(batches):
        from pyspark import TaskContext

        n, rows, ids, vs = TaskContext.get().partitionId() << 24, [], [], []
        for b in batches:
            flat, at = _flat(b["v"])
            for i, (row, key) in enumerate(zip(b["row"].to_pylist(), b["id"].to_pylist(), strict=True)):
                rows.append(row)
                ids.append(key)
                vs.append(flat[at[i] : at[i + 1]].copy())
                if len(rows) == 2 * BLOCK_ROWS:
                    yield _block("block", n, rows, ids, vs)
                    n, rows, ids, vs = n + 1, [], [], []
        if rows:
            yield _block("block", n, rows, ids, vs)

    asking = shards.mapInArrow(pick, "row long, id long, v array<double>")
    size = asking.count()
    return asking.repartition(max(1, -(-size // BLOCK_ROWS)), "row").mapInArrow(pack, _kinds("block"))


def _pair(row: dict) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
    """A shard, and the rows, ids and vectors of a block, in 64 bits where all sums fit, else in Python's integers."""
    rows, ids, vectors = _unpacked(row, "shard")
    query_rows, query_ids, qs = _unpacked(row, "block")
    width = min(vectors.shape[1], qs.shape[1])
    most = [np.abs(x[:, :width].astype(np.float64)).max(0) if len(x) else np.zeros(width) for x in (vectors, qs)]
    if float((most[0] * most[1]).sum()) < SAFE and all(np.abs(x).max(initial=0) < SAFE for x in (vectors.astype(np.float64), qs.astype(np.float64))):
        vectors, qs = vectors.astype(np.int64), qs.astype(np.int64)
    else:
        vectors, qs = (np.array([[int(c) for c in v] for v in x], object).reshape(x.shape) for x in (vectors, qs))
    return Shard(rows, ids, vectors), query_rows, query_ids, qs


def _exact(score: int) -> bytes | None:
    """What orders scores that a long cannot show."""
    return (score + (1 << 2200)).to_bytes(288, "big") if abs(score) >= MOST else None


_FOUND = "query_row long, query_id long, id long, score long, exact binary"


def _found(query_rows, query_ids, tops) -> pa.RecordBatch:
    sizes = [len(x) for x, _ in tops]
    scores = [int(s) for _, x in tops for s in x]
    ids = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in tops)])
    cells = [pa.array(np.repeat(query_rows, sizes)), pa.array(np.repeat(query_ids, sizes)), pa.array(ids), pa.array([max(-MOST, min(MOST, s)) for s in scores], pa.int64()), pa.array([_exact(s) for s in scores], pa.binary())]
    return pa.record_batch(cells, ["query_row", "query_id", "id", "score", "exact"])


def top_k(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """(query_id, rank, id, score) for rows (id, v array<double>): all are candidates, those where asks holds queries too."""
    spark = rows.sparkSession
    path = scratch_dir(spark)
    shards = materialize(_shards(rows.select("id", "v", F.coalesce(asks, F.lit(False)).alias("asks"))), f"{path}/shards")
    blocks = materialize(_blocks(shards), f"{path}/blocks")
    shards, n_shards = numbered(shards.drop("asks"), "shard")
    blocks, n_blocks = numbered(blocks, "block")
    if not n_shards or not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")

    def begin(batches):
        release()
        for b in batches:
            for row in b.to_pylist():
                shard, query_rows, query_ids, qs = _pair(row)
                tops = [shard.top(at, q, k) for at, q in zip(query_rows.tolist(), qs, strict=True)]
                floors = pickle.dumps([int(scores[-1]) if len(scores) == k else None for _, scores in tops])
                found = _found(query_rows, query_ids, tops)
                yield pa.record_batch([pa.array([row["block"]], pa.int64()), pa.array([floors], pa.binary()), pa.array([found.to_pylist()], pa.list_(pa.struct(list(found.schema))))], ["block", "floors", "found"])

    def go_on(batches):
        release()
        for b in batches:
            for row in b.to_pylist():
                shard, query_rows, query_ids, qs = _pair(row)
                floors = pickle.loads(row["floors"])
                yield _found(query_rows, query_ids, [shard.top(at, q, k, floor) for at, q, floor in zip(query_rows.tolist(), qs, floors, strict=True)])

    # The shard that a block meets first; then each side is repeated by the other's numbers, dealt by the pair.
    own = blocks.withColumn("shard", F.pmod(F.col("block"), F.lit(n_shards)))
    kinds = "block long, floors binary, found array<struct<query_row:bigint,query_id:bigint,id:bigint,score:bigint,exact:binary>>"
    first = materialize(own.join(shards, "shard").mapInArrow(begin, kinds), f"{path}/first")
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = blocks.join(first.select("block", "floors"), "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    right = right.where(F.col("shard") != F.pmod(F.col("block"), F.lit(n_shards)))
    found = left.join(right, ["shard", "block"]).mapInArrow(go_on, _FOUND).unionByName(first.select(F.explode("found").alias("f")).select("f.*"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("exact"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.select("query_id", "rank", "id", "score"), f"{path}/out")
    for name in ("shards", "blocks", "first"):
        remove(spark, f"{path}/{name}")
    return out


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    found = top_k(rows, F.col("id") % 100 == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP2_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
