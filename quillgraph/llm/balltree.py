"""Hard-negative mining by ball trees: per-partition trees, branch and bound on inner products from both sides.

Rows are packed into shards, each with a ball tree of its own: a node has its rows' mean, the radius around it, and the
least and largest label under it.  For a query q, all inner products under a node lie within
`q . centre +- |q| * radius`.  The search goes depth first, to the child that promises more first, and passes over nodes
whose labels cannot fit, whose bounds lie outside the window of scores, or whose upper bound is strictly beneath the
k-th score found so far; nodes that could tie with it are opened, so results are exact.

Two rounds: each anchor's positives are its nearest rows of its label; then, for each of them, the window
`floor <= score <= positive's score` gives its negatives.  Anchors come in blocks, rows in shards, and a block walks a tree
together: at each node go on the anchors, with all their windows, that its bounds do not rule out.  What a task has found for an anchor in one shard bounds its search in the next, and Spark merges
the tasks' best rows.

Scores are exact: in doubles where a bound shows that all sums are whole numbers below 2**53, else in Python's integers;
bounds carry a margin for their own rounding.  Ranks and windows follow exact scores; one beyond +-(2**63 - 1) is shown as that.

Rows with a null id, label or vector, or a null or non-finite component (also once scaled) take no part.  An anchor is never
its own positive or negative; other rows that repeat its id, or its vector, are rows like any other, and each row of a
repeated anchor id is an anchor of its own.  Ties go to the smaller id.  Vectors of other lengths are read as if the missing
components were 0.  Anchors without another row of their label, and positives without a row in their window, give no
rows; neither does an empty table.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import from_bytes, materialize, meet, numbered, release, remove, scratch_dir, table, to_bytes
from quillgraph.llm.maxscore import quantise

MOST = (1 << 63) - 1
LEAF, SHARD_ROWS, BLOCK_ROWS, MARGIN = 64, 1 << 14, 2048, 1e-9
#: Rows of results that a task holds before it hands them on.
HELD = 1 << 18


class BallTree:
    """rows (numbers), ids, labels and vectors in the tree's order; nodes as arrays, the children of k at left[k] and left[k] + 1."""

    def __init__(self, rows, ids, labels, vectors, start, end, left, centre, radius, low, high):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.start, self.end, self.left, self.centre, self.radius, self.low, self.high = start, end, left, centre, radius, low, high

    @staticmethod
    def built(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        """A node of more than `leaf` rows that differ is cut in half across the line between two of its far rows."""
        order = np.arange(len(ids))
        nodes, at = [(0, len(ids))], 0
        left, centre, radius = [], [], []
        with np.errstate(all="ignore"):
            while at < len(nodes):
                a, z = nodes[at]
                own = vectors[order[a:z]]
                centre.append(own.mean(0))
                away = np.sqrt(((own - centre[-1]) ** 2).sum(1))
                radius.append(float(np.nan_to_num(away, nan=np.inf).max(initial=0)))
                at += 1
                if z - a <= leaf or not (own != own[0]).any():
                    left.append(-1)
                    continue
                one = own[int(np.argmax(away))]
                other = own[int(np.argmax(((own - one) ** 2).sum(1)))]
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(np.nan_to_num(own @ (other - one)), half)]
                left.append(len(nodes))
                nodes += [(a, a + half), (a + half, z)]
        start, end = np.array(nodes, np.int64).T
        labels = labels[order]
        low, high = (np.array([f(labels[a:z]) for a, z in nodes], np.int64) for f in (np.min, np.max))
        return BallTree(rows[order], ids[order], labels, vectors[order], start, end, np.array(left, np.int64), np.array(centre), np.array(radius), low, high)

    def packed(self) -> bytes:
        fit = self.vectors.size == 0 or np.abs(self.vectors).max() < 1 << 31
        return to_bytes(rows=self.rows, ids=self.ids, labels=self.labels, vectors=self.vectors.astype(np.int32 if fit else np.float64), start=self.start, end=self.end, left=self.left, centre=self.centre, radius=self.radius, low=self.low, high=self.high)

    @staticmethod
    def unpacked(data: bytes) -> BallTree:
        tree = BallTree(**from_bytes(data))
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    def bounds(self, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product under each node with each of the queries (rows)."""
        width = min(qs.shape[1], self.centre.shape[1])
        with np.errstate(all="ignore"):
            size = np.sqrt((qs**2).sum(1))
            middle = self.centre[:, :width] @ qs[:, :width].T
            reach = np.outer(self.radius, size)
            reach += MARGIN * (1 + reach + np.outer(np.sqrt((self.centre**2).sum(1)), size))
            return np.nan_to_num(middle - reach, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(middle + reach, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def exact_in_doubles(self, qs: np.ndarray) -> bool:
        """Whether all inner products with the queries, and their partial sums, are below 2**53."""
        width = min(qs.shape[1], self.vectors.shape[1])
        most = [np.abs(x[:, :width]).max(0, initial=0) for x in (self.vectors, qs)]
        with np.errstate(all="ignore"):
            return bool((most[0] * most[1]).sum() < 1 << 53)

    def scores(self, node: int, qs: np.ndarray, plain: bool) -> np.ndarray:
        """Queries x rows of a leaf."""
        width = min(qs.shape[1], self.vectors.shape[1])
        own, qs = self.vectors[self.start[node] : self.end[node], :width], qs[:, :width]
        if plain:
            return qs @ own.T
        own, qs = (np.array([[int(c) for c in v] for v in x], object).reshape(x.shape) for x in (own, qs))
        return qs @ own.T if width else np.zeros((len(qs), len(own)), object)

    def search(self, rows: np.ndarray, labels: np.ndarray, qs: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, found: list[list[list]], k: int) -> None:
        """Adds to found[i][j], sorted lists of (-score, id), the k best rows for query i in its window low[i, j] to high[i, j].

        Rows of the query's label (same) or of others; never the row itself.  One walk for all queries: each node is met by those
        that still need it, the child that promises more to them first.
        """
        plain = self.exact_in_doubles(qs)
        kind = np.float64 if plain else object
        low, high, need = low.astype(kind), high.astype(kind), low.astype(kind)

        def raise_need(i: int, j: int) -> None:
            if len(found[i][j]) == k:
                need[i, j] = max(low[i, j], -found[i][j][-1][0])

        for i, own in enumerate(found):
            for j in range(len(own)):
                raise_need(i, j)
        least, most = self.bounds(qs)
        stack = [(0, np.arange(len(qs)))]
        while stack:
            node, alive = stack.pop()
            fit = ((most[node, alive, None] >= need[alive]) & (least[node, alive, None] <= high[alive])).any(1)
            within = (self.low[node] <= labels[alive]) & (labels[alive] <= self.high[node])
            alive = alive[fit & (within if same else ~within | (self.low[node] < self.high[node]))]
            if not len(alive):
                continue
            if self.left[node] >= 0:
                children = [int(self.left[node]), int(self.left[node]) + 1]
                children.sort(key=lambda c: most[c, alive].sum())
                stack += [(c, alive) for c in children]
                continue
            a, z = self.start[node], self.end[node]
            scores = self.scores(node, qs[alive], plain)
            fit = ((self.labels[a:z] == labels[alive, None]) == same) & (self.rows[a:z] != rows[alive, None])
            for j in range(low.shape[1]):
                hits = fit & (scores >= need[alive, j, None]) & (scores <= high[alive, j, None])
                for i, c in np.argwhere(hits).tolist():
                    own = found[alive[i]][j]
                    insort(own, (-int(scores[i, c]), int(self.ids[a + c])))
                    del own[k:]
                for i in np.flatnonzero(hits.any(1)).tolist():
                    raise_need(int(alive[i]), j)


def _grid(values: pa.ListArray) -> np.ndarray:
    at = values.offsets.to_numpy()
    flat, sizes = np.floor(values.flatten().to_numpy(zero_copy_only=False)), np.diff(at)
    grid = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for i, (a, n) in enumerate(zip(at - at[0], sizes, strict=False)):
        grid[i, :n] = flat[a : a + n]
    return grid


def _joined(grids: list[np.ndarray]) -> np.ndarray:
    width = max(g.shape[1] for g in grids)
    return np.concatenate([np.pad(g, ((0, 0), (0, width - g.shape[1]))) for g in grids])


def _exact(score: int) -> bytes | None:
    """What orders scores that a long cannot show."""
    return (score + (1 << 2200)).to_bytes(288, "big") if abs(score) >= MOST else None


def _score(shown: int, exact: bytes | None) -> int:
    return shown if exact is None else int.from_bytes(exact, "big") - (1 << 2200)


def trees(rows: DataFrame) -> DataFrame:
    """(shard, tree, asks) of rows (id, label, v, asks): each task's rows in trees of up to SHARD_ROWS, rows numbered shard << 14 | place."""

    def run(batches):
        from pyspark import TaskContext

        release()
        number, held_, size = TaskContext.get().partitionId() << 24, [], 0

        def made():
            ids, labels, asks = (np.concatenate([x[i] for x in held_]) for i in range(3))
            tree = BallTree.built((number << 14) + np.arange(len(ids)), ids, labels, _joined([x[3] for x in held_]))
            asks = tree.rows[asks[tree.rows - (number << 14)]]
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([tree.packed()], pa.binary()), pa.array([to_bytes(rows=asks)], pa.binary())], ["shard", "tree", "asks"])

        for b in batches:
            start = 0
            while start < len(b):
                part = b.slice(start, SHARD_ROWS - size)
                held_.append((part["id"].to_numpy(), part["label"].to_numpy(), part["asks"].to_numpy(zero_copy_only=False).astype(bool), _grid(part["v"])))
                size, start = size + len(part), start + len(part)
                if size == SHARD_ROWS:
                    yield made()
                    number, held_, size = number + 1, [], 0
        if held_:
            yield made()

    return rows.mapInArrow(run, "shard long, tree binary, asks binary")


def asking(shards: DataFrame) -> DataFrame:
    """(row, id, label, v) of the shards' rows that ask."""

    def run(batches):
        release()
        for b in batches:
            for shard in b.to_pylist():
                tree, asks = BallTree.unpacked(shard["tree"]), from_bytes(shard["asks"])["rows"]
                some = np.flatnonzero(np.isin(tree.rows, asks))
                for at in range(0, len(some), BLOCK_ROWS):
                    x = some[at : at + BLOCK_ROWS]
                    yield pa.record_batch([pa.array(tree.rows[x]), pa.array(tree.ids[x]), pa.array(tree.labels[x]), pa.array(list(tree.vectors[x]), pa.list_(pa.float64()))], ["row", "id", "label", "v"])

    return shards.mapInArrow(run, "row long, id long, label long, v array<double>")


def blocks(anchors: DataFrame) -> DataFrame:
    """(block, asked) of anchors (row, id, label, v, positives array<struct<id, score, exact>>), about BLOCK_ROWS each."""

    def run(batches):
        from pyspark import TaskContext

        release()
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                positives = part["positives"].to_pylist()
                of = np.repeat(np.arange(len(part)), [len(x) for x in positives]).astype(np.int64)
                flat = [p for x in positives for p in x]
                exact = np.frombuffer(b"".join(p["exact"] or bytes(288) for p in flat), np.uint8)
                own = {"rows": part["row"].to_numpy(), "ids": part["id"].to_numpy(), "labels": part["label"].to_numpy(), "vectors": _grid(part["v"])}
                asked = to_bytes(**own, of=of, positives=np.array([p["id"] for p in flat], np.int64), shown=np.array([p["score"] for p in flat], np.int64), exact=exact)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([asked], pa.binary())], ["block", "asked"])
                number += 1

    size = anchors.count()
    return anchors.repartition(max(1, -(-size // BLOCK_ROWS)), "row").mapInArrow(run, "block long, asked binary")


_FOUND = "row long, anchor long, place int, positive long, positive_shown long, id long, score long, exact binary"


def _walked(pairs: DataFrame, k: int, least: int | None) -> DataFrame:
    """(_FOUND) the k best of each task for each anchor of (block, asked) met with (shard, tree): of its label, or, with `least` (a
    percentage), of other labels for each of its positives with a score from that share of the positive's up to it."""

    def run(batches):
        release()
        kept: dict[int, tuple] = {}

        def cells():
            out = {c: [] for c in ("row", "anchor", "place", "positive", "positive_shown", "id", "score", "exact")}
            for asked, _, _, found in kept.values():
                for i, own in enumerate(found):
                    for j, best in enumerate(own):
                        at = asked["_first"][i] + j
                        named = (int(asked["positives"][at]), int(asked["shown"][at])) if least is not None else (None, None)
                        for score, key in best:
                            for c, x in zip(out, (int(asked["rows"][i]), int(asked["ids"][i]), j, *named, key, max(-MOST, min(MOST, -score)), _exact(-score)), strict=True):
                                out[c].append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

        for b in batches:
            for pair in b.to_pylist():
                tree = BallTree.unpacked(pair["tree"])
                if pair["block"] not in kept:
                    asked = from_bytes(pair["asked"])
                    asked["_first"] = first = np.searchsorted(asked["of"], np.arange(len(asked["rows"]) + 1))
                    wide = max(1, int(np.diff(first).max(initial=0)))
                    low, high = np.full((len(first) - 1, wide), np.inf, object), np.full((len(first) - 1, wide), -np.inf, object)
                    if least is None:
                        low[:], high[:] = -np.inf, np.inf
                    else:
                        exact = asked["exact"].tobytes()
                        for at, (i, shown) in enumerate(zip(asked["of"].tolist(), asked["shown"].tolist(), strict=True)):
                            score = _score(shown, exact[288 * at : 288 * at + 288] if abs(shown) >= MOST else None)
                            low[i, at - first[i]], high[i, at - first[i]] = -(-least * score // 100), score
                    kept[pair["block"]] = asked, low, high, [[[] for _ in range(wide)] for _ in low]
                asked, low, high, found = kept[pair["block"]]
                tree.search(asked["rows"], asked["labels"], asked["vectors"], least is None, low, high, found, k)
            if sum(x[1].size for x in kept.values()) * k > HELD:
                yield cells()
                kept.clear()
        if kept:
            yield cells()

    return pairs.select("shard", "tree", "block", "asked").mapInArrow(run, _FOUND)


def hard_negatives(rows: DataFrame, asks: Column, n_positives: int, n_negatives: int, least: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, v array<double>).

    Anchors are the rows where asks holds.  Of each anchor's n_positives best other rows of its label, each has the
    n_negatives best rows of other labels whose scores lie between `least` percent of its own and its own.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark)
    fit = rows.where("label is not null").select("id", F.col("label").cast("long").alias("label"), "v", F.coalesce(asks, F.lit(False)).alias("asks"))
    shards, n_shards = numbered(materialize(trees(fit), f"{path}/trees"), "shard")
    positive = "array<struct<id:long,score:long,exact:binary>>"
    anchors = materialize(asking(shards), f"{path}/anchors")
    first, n_blocks = numbered(materialize(blocks(anchors.withColumn("positives", F.array().cast(positive))), f"{path}/blocks-1"), "block")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_blocks:
        remove(spark, path)
        return empty
    shards = shards.drop("asks")
    best = lambda found, keys, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("exact"), "id"))).where(F.col("rank") <= k)
    near = best(_walked(meet(shards, first, n_shards, n_blocks), n_positives, None), ["row"], n_positives)
    # At most n_positives rows of an anchor are left.
    listed = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "exact"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["exact"].alias("exact"))).alias("positives"))
    known = materialize(anchors.join(listed, "row").select("row", "id", "label", "v", "positives"), f"{path}/known")
    second, n_blocks = numbered(materialize(blocks(known), f"{path}/blocks-2"), "block")
    if not n_blocks:
        remove(spark, path)
        return empty
    found = best(_walked(meet(shards, second, n_shards, n_blocks), n_negatives, least), ["row", "place"], n_negatives)
    out = materialize(found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive_shown").alias("positive_score"), F.col("score").alias("negative_score")), f"{path}/out")
    for name in ("trees", "anchors", "blocks-1", "known", "blocks-2"):
        remove(spark, f"{path}/{name}")
    return out


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fit = quantise(rows.where("label is not null").withColumn("label", label.cast("long")), "vec_id", "embedding", 256, "label")
    return hard_negatives(fit, F.col("id") % 100 == 0, 5, 5, 80)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT q.r, q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.r = p.r AND p.place <= 5 AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
