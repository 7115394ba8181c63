"""Cycles of a directed graph: strongly connected components, and which of an ordered list of edges may join an acyclic graph.

Components are found by rounds that are linear in the edges: ends without a way in or out are trimmed, nodes with one way in
and one way out are passed over by doubling jumps (so a cycle of n nodes takes log2(n) rounds, not n), and what is left is
coloured by the largest id that reaches a node and searched backwards from each colour's root.  As soon as no more than SMALL
edges are left, one task finishes.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import _keep, drop_folder, reachable_pairs, shared_dir

#: Edges that one task may hold: some 40 MB of ids.
SMALL = 1 << 18
#: Rounds of trimming before nodes of one way are passed over.
TRIMS = 2


def tarjan(n: int, ahead: dict[int, list[int]]) -> list[int]:
    """The number of each node's strongly connected component; ahead: the nodes after a node."""
    found, low, of, stack, count = [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if found[root]:
            continue
        count += 1
        found[root] = low[root] = count
        stack.append(root)
        path = [(root, iter(ahead.get(root, ())))]
        while path:
            x, rest = path[-1]
            for y in rest:
                if not found[y]:
                    count += 1
                    found[y] = low[y] = count
                    stack.append(y)
                    path.append((y, iter(ahead.get(y, ()))))
                    break
                if of[y] < 0:
                    low[x] = min(low[x], found[y])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[x])
                if low[x] == found[x]:
                    while True:
                        y = stack.pop()
                        of[y] = x
                        if y == x:
                            break
    return of


def _numbered(*columns: pd.Series) -> tuple[list[list[int]], list[str]]:
    codes, names = pd.factorize(pd.concat(columns, ignore_index=True))
    out, at = [], 0
    for c in columns:
        out.append(codes[at : at + len(c)].tolist())
        at += len(c)
    return out, names.tolist()


def _ahead(sources: list[int], targets: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for a, z in zip(sources, targets, strict=True):
        out.setdefault(a, []).append(z)
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, scc) of a graph of at most SMALL edges."""

    def run(parts):
        whole = pd.concat([pd.DataFrame({"from_id": [], "to_id": []}, dtype=object), *parts], ignore_index=True)
        (a, z), names = _numbered(whole["from_id"], whole["to_id"])
        of = tarjan(len(names), _ahead(a, z))
        sizes = Counter(of)
        some = pd.DataFrame([(names[i], c) for i, c in enumerate(of) if sizes[c] > 1], columns=["id", "of"]).sort_values("id")
        yield pd.DataFrame({"id": some["id"].astype(object), "scc": some["of"].map(some.drop_duplicates("of").set_index("of")["id"]).astype(object)})

    return edges.select("from_id", "to_id").repartition(1).mapInPandas(run, "id {0}, scc {0}".format(_type(edges)))


def _type(edges: DataFrame) -> str:
    """The type of the ids: text, or longs where nodes are numbered."""
    return edges.schema["from_id"].dataType.simpleString()


class _Steps:
    """Numbered tables of a search in one folder, and how many rounds it took."""

    def __init__(self, spark):
        self.spark, self.folder, self.rounds = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.rounds += 1
        return _keep(df, self.folder, f"step-{self.rounds}")


def _trimmed(edges: DataFrame, steps: _Steps, size: int, small: int) -> tuple[DataFrame, int]:
    """The edges whose ends have a way in and a way out, for a few rounds."""
    for _ in range(TRIMS):
        if size <= small:
            break
        inner = edges.join(edges.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").join(edges.select(F.col("to_id").alias("from_id")), "from_id", "left_semi")
        edges = steps.keep(inner.select("from_id", "to_id"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges, size


def _passed(edges: DataFrame, steps: _Steps) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """edges without nodes of one way in and one way out; (id, from_id, to_id): those nodes and the ends of their lines; and
    (id, scc) of cycles of such nodes alone.  None if there is no such node."""
    ways_in = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"), F.min("from_id").alias("before")).where("n = 1 and before <> id")
    ways_out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("m"), F.min("to_id").alias("after")).where("m = 1 and after <> id")
    inner = steps.keep(ways_in.join(ways_out, "id").select("id", "before", "after"))
    n = inner.count()
    if not n:
        return None
    # tail: the last node of the line; least: the smallest id up to there; open: whether more of the line lies ahead.
    after = inner.select(F.col("id").alias("after"), F.lit(True).alias("goes_on"))
    jump = steps.keep(inner.join(after, "after", "left").select("id", F.when(F.col("goes_on"), F.col("after")).otherwise(F.col("id")).alias("tail"), F.col("id").alias("least"), F.coalesce("goes_on", F.lit(False)).alias("open")))
    for _ in range(n.bit_length() + 1):
        if jump.where("open").isEmpty():
            break
        over = jump.select(F.col("id").alias("tail"), F.col("tail").alias("next"), F.col("least").alias("least2"), F.col("open").alias("on"))
        moved = jump.where("open").join(over, "tail").select("id", F.col("next").alias("tail"), F.least("least", "least2").alias("least"), F.col("on").alias("open"))
        jump = steps.keep(jump.where("not open").unionByName(moved))
    rings = jump.where("open").select("id", F.col("least").alias("scc"))
    lines = jump.where("not open").select("id", "tail")
    ends = inner.select(F.col("id").alias("tail"), F.col("after").alias("to_id"))
    heads = inner.join(inner.select(F.col("id").alias("before")), "before", "left_anti").select("id", F.col("before").alias("from_id"))
    starts = lines.join(heads, "id").select("tail", "from_id")
    whole = steps.keep(lines.join(starts, "tail").join(ends, "tail").select("id", "from_id", "to_id"))
    outer = inner.select("id")
    direct = edges.join(outer.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(outer.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    fewer = steps.keep(direct.select("from_id", "to_id").unionByName(whole.select("from_id", "to_id")).distinct())
    return fewer, whole, steps.keep(rings)


def _coloured(edges: DataFrame, steps: _Steps) -> tuple[DataFrame, DataFrame]:
    """(id, scc) of the components that hold the largest id among those that reach them, and the edges left for the others."""
    colour = steps.keep(edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("colour", F.col("id")))
    while True:
        near = edges.join(colour.withColumnsRenamed({"id": "from_id", "colour": "near"}), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("near").alias("near"))
        fresh = steps.keep(colour.join(near, "id", "left").select("id", F.greatest("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") > F.col("colour")).alias("changed")))
        colour = fresh.select("id", "colour")
        if fresh.where("changed").isEmpty():
            break
    within = edges.join(colour.withColumnsRenamed({"id": "from_id"}), "from_id").join(colour.withColumnsRenamed({"id": "to_id", "colour": "other"}), "to_id").where("colour = other").select("from_id", "to_id", "colour")
    within = steps.keep(within)
    front = colour.where("id = colour")
    found = front
    while True:
        back = within.join(front.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"), "colour").distinct()
        front = steps.keep(back.join(found.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        found = steps.keep(found.unionByName(front))
    rest = within.join(found.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(found.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    sizes = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
    return steps.keep(found.join(sizes, "colour", "left_semi").select("id", F.col("colour").alias("scc"))), steps.keep(rest.select("from_id", "to_id"))


def strong_components(edges: DataFrame, small: int | None = None, steps: _Steps | None = None) -> DataFrame:
    """(id, scc): the nodes that lie on a cycle of two nodes or more, each with an id that all of its component share."""
    small = SMALL if small is None else small
    steps = steps or _Steps(edges.sparkSession)
    left = steps.keep(edges.where("from_id <> to_id").select("from_id", "to_id").distinct())
    size, found, lines = left.count(), [], []
    while size:
        left, size = _trimmed(left, steps, size, small)
        if size <= small:
            found.append(_in_one_task(left))
            break
        if passed := _passed(left, steps):
            left, whole, rings = passed
            lines.append(whole)
            # A line from a node back to it is a cycle with that node.
            found += [rings, left.where("from_id = to_id").select(F.col("from_id").alias("id"), F.col("from_id").alias("scc"))]
            left = left.where("from_id <> to_id")
            before, size = size, left.count()
            if size < before:
                continue
        own, left = _coloured(left, steps)
        found.append(own)
        size = left.count()
    if not found:
        return edges.sparkSession.createDataFrame([], "id {0}, scc {0}".format(_type(edges)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # A node may close a cycle through a line of its own and be part of a larger component, or of a later line: these count.
    out = steps.keep(out.groupBy("id").agg(F.max(F.struct((F.col("scc") != F.col("id")).alias("larger"), "scc")).alias("m")).select("id", "m.scc"))
    for whole in reversed(lines):
        ends = whole.join(out.withColumnsRenamed({"id": "from_id"}), "from_id").join(out.withColumnsRenamed({"id": "to_id", "scc": "other"}), "to_id").where("scc = other")
        ends = steps.keep(ends.select("id", "scc"))
        out = steps.keep(out.join(ends, "id", "left_anti").unionByName(ends))
    for k in range(1, steps.rounds):
        drop_folder(edges.sparkSession, f"{steps.folder}/step-{k}")
    return out


class _Order:
    """A topological order of a graph without cycles that edges are added to: only what lies between an edge's ends is moved."""

    def __init__(self, n: int, ahead: dict[int, list[int]]):
        self.ahead = {x: list(y) for x, y in ahead.items()}
        self.behind = _ahead([z for x in ahead for z in ahead[x]], [x for x in ahead for _ in ahead[x]])
        left = [len(self.behind.get(x, ())) for x in range(n)]
        ready = [x for x in range(n) if not left[x]]
        self.place = [0] * n
        for at in range(n):
            x = ready.pop()
            self.place[x] = at
            for y in self.ahead.get(x, ()):
                left[y] -= 1
                if not left[y]:
                    ready.append(y)

    def _between(self, start: int, near: dict[int, list[int]], inside) -> set[int]:
        seen, stack = {start}, [start]
        while stack:
            for y in near.get(stack.pop(), ()):
                if y not in seen and inside(self.place[y]):
                    seen.add(y)
                    stack.append(y)
        return seen

    def closes(self, a: int, z: int) -> bool:
        high = self.place[a]
        return a == z or self.place[z] < high and a in self._between(z, self.ahead, lambda p: p <= high)

    def add(self, a: int, z: int) -> bool:
        """Adds the edge from a to z unless that closes a cycle."""
        if self.closes(a, z):
            return False
        low, high = self.place[z], self.place[a]
        if low < high:
            later = self._between(z, self.ahead, lambda p: p <= high)
            earlier = self._between(a, self.behind, lambda p: p >= low)
            order = sorted(earlier, key=self.place.__getitem__) + sorted(later, key=self.place.__getitem__)
            for x, p in zip(order, sorted(self.place[x] for x in order), strict=True):
                self.place[x] = p
        self.ahead.setdefault(a, []).append(z)
        self.behind.setdefault(z, []).append(a)
        return True


def _decide(part: pd.DataFrame) -> pd.DataFrame:
    """The asked edges of some components (place not null) that may join them, one after another."""
    (a, z), names = _numbered(part["from_id"], part["to_id"])
    asked = part["place"].notna().tolist()
    held = [i for i, x in enumerate(asked) if not x]
    # What is stored should have no cycle; if it has, its components count as single nodes.
    of = tarjan(len(names), _ahead([a[i] for i in held], [z[i] for i in held]))
    pairs = {(of[a[i]], of[z[i]]) for i in held if of[a[i]] != of[z[i]]}
    order = _Order(len(names), _ahead([x for x, _ in pairs], [y for _, y in pairs]))
    turn = part["place"].tolist()
    fine = [i for i in sorted((i for i, x in enumerate(asked) if x), key=lambda i: turn[i]) if order.add(of[a[i]], of[z[i]])]
    return part.iloc[fine][["from_id", "to_id"]].astype(object)


def _bundled(rows: DataFrame, total: int, small: int):
    """rows by a number of their component: many small components share a task's group, about a quarter of SMALL edges in each."""
    return rows.groupBy(F.pmod(F.xxhash64("scc"), F.lit(4 * total // max(small, 1) + 1)))


def _closing(part: pd.DataFrame) -> pd.DataFrame:
    """The asked edges of some components (asked is true) that close a cycle with their stored ones, each by itself."""
    (a, z), names = _numbered(part["from_id"], part["to_id"])
    asked = part["asked"].tolist()
    held = [i for i, x in enumerate(asked) if not x]
    of = tarjan(len(names), _ahead([a[i] for i in held], [z[i] for i in held]))
    pairs = {(of[a[i]], of[z[i]]) for i in held if of[a[i]] != of[z[i]]}
    order = _Order(len(names), _ahead([x for x, _ in pairs], [y for _, y in pairs]))
    return part.iloc[[i for i, x in enumerate(asked) if x and order.closes(of[a[i]], of[z[i]])]][["from_id", "to_id"]].astype(object)


def closes_cycle(edges: DataFrame, proposals: DataFrame, small: int | None = None) -> DataFrame:
    """Those proposals (from_id, to_id) that would each close a cycle with the edges: from is to, or reachable from it.

    A path back lies within one component of edges and proposals together; components of more than SMALL edges are searched
    hop by hop, the others by one task each.
    """
    small = SMALL if small is None else small
    proposals = proposals.select("from_id", "to_id").distinct()
    edges = edges.select("from_id", "to_id").distinct()
    folder = shared_dir(edges.sparkSession)
    both = edges.withColumn("asked", F.lit(False)).unionByName(proposals.withColumn("asked", F.lit(True)))
    comps = strong_components(both, small)
    inner = both.join(comps.withColumnRenamed("id", "from_id"), "from_id").join(comps.withColumnsRenamed({"id": "to_id", "scc": "other"}), "to_id").where("scc = other")
    inner = _keep(inner.select("scc", "from_id", "to_id", "asked"), folder, "inner")
    sizes = inner.groupBy("scc").agg(F.count("*").alias("n"))
    few = inner.join(sizes.where(F.col("n") <= small), "scc", "left_semi")
    out = _bundled(few, inner.count(), small).applyInPandas(_closing, "from_id {0}, to_id {0}".format(_type(edges)))
    large = inner.join(sizes.where(F.col("n") > small), "scc", "left_semi")
    if not large.isEmpty():
        asked = large.where("asked").select("from_id", "to_id")
        reach = reachable_pairs(large.where("not asked"), asked.select(F.col("to_id").alias("id")))
        out = out.unionByName(asked.join(reach.withColumnsRenamed({"start": "to_id", "id": "from_id"}), ["from_id", "to_id"], "left_semi"))
    return out.unionByName(proposals.where("from_id = to_id")).distinct()


def admitted(stored: DataFrame, asked: DataFrame, comps: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(from_id, to_id): those of asked (from_id, to_id, place) that close no cycle with stored edges and those admitted before, by place.

    An edge whose ends lie in no common component is admitted.  In each component edges are tried in turn by one task while the
    component has at most SMALL edges; a component with one asked edge rejects it without that; a larger one is halved by place:
    the first half is decided, then the second beside it.
    """
    small = SMALL if small is None else small
    spark = asked.sparkSession
    pairs = lambda df: df.select("from_id", "to_id")
    comps = strong_components(pairs(stored).unionByName(pairs(asked)), small) if comps is None else comps
    ends = lambda df: df.join(comps.withColumnRenamed("id", "from_id"), "from_id").join(comps.withColumnsRenamed({"id": "to_id", "scc": "other"}), "to_id").where("scc = other").drop("other")
    folder = shared_dir(spark)
    torn = _keep(ends(asked.where("from_id <> to_id").select("from_id", "to_id", "place")), folder, "torn")
    fine = asked.where("from_id <> to_id").join(pairs(torn), ["from_id", "to_id"], "left_anti").select("from_id", "to_id")
    if torn.isEmpty():
        return fine
    inner = _keep(ends(pairs(stored).distinct()), folder, "inner")
    sizes = torn.groupBy("scc").agg(F.count("*").alias("asked"), F.percentile_approx("place", 0.5, 10_000).alias("middle"))
    sizes = sizes.join(inner.groupBy("scc").agg(F.count("*").alias("held")), "scc", "left").withColumn("size", F.col("asked") + F.coalesce("held", F.lit(0)))
    sizes = _keep(sizes, folder, "sizes")
    some = sizes.where((F.col("asked") > 1) & (F.col("size") <= small)).select("scc")
    each = inner.withColumn("place", F.lit(None).cast("long")).unionByName(torn.select(*inner.columns, "place")).join(some, "scc", "left_semi")
    total = sizes.where((F.col("asked") > 1) & (F.col("size") <= small)).agg(F.sum("size")).first()[0] or 0
    fine = fine.unionByName(_bundled(each, total, small).applyInPandas(_decide, "from_id {0}, to_id {0}".format(_type(asked))))
    large = sizes.where((F.col("asked") > 1) & (F.col("size") > small)).select("scc", "middle")
    if not large.isEmpty():
        halves = _keep(torn.join(large, "scc").select("from_id", "to_id", "place", (F.col("place") <= F.col("middle")).alias("first")), folder, "halves")
        # Of two or more places the middle one, a lower median, leaves some in each half unless they are the same place.
        first = _keep(admitted(stored, halves.where("first").drop("first"), None, small), folder, "first")
        fine = fine.unionByName(first).unionByName(admitted(pairs(stored).unionByName(first), halves.where("not first").drop("first"), None, small))
    return _keep(fine.distinct(), folder, "admitted")
