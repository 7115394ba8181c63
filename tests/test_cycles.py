"""Strongly connected components, cycle guards and ordered admission against plain sequential versions."""

import random

import pytest

from quillgraph.operators import cycles, supersede

PAIR = "from_id string, to_id string"


def reach(edges, start):
    ahead, seen, stack = {}, set(), [start]
    for a, z in edges:
        ahead.setdefault(a, []).append(z)
    while stack:
        for y in ahead.get(stack.pop(), ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


def plain_components(edges):
    ids = {x for e in edges for x in e}
    edges = [e for e in edges if e[0] != e[1]]
    far = {x: reach(edges, x) for x in ids}
    return {frozenset(y for y in ids if y in far[x] and x in far[y]) for x in ids if x in far[x]}


def found_components(spark, edges, small):
    out = {}
    for r in cycles.strong_components(spark.createDataFrame(edges, PAIR), small).collect():
        out.setdefault(r["scc"], []).append(r["id"])
    assert all(len(x) == len(set(x)) for x in out.values())
    return {frozenset(x) for x in out.values()}


def shapes():
    rng = random.Random(7)
    ring = lambda names: list(zip(names, names[1:] + names[:1], strict=True))
    yield []
    yield [("a", "a")]
    yield ring(list("abcdefgh")) + [("x", "a"), ("h", "y"), ("y", "z"), ("y", "y")]
    # Two rings that share a node, lines between components, a line from a node back to it beside a larger component.
    yield ring(list("abc")) + ring(["a", "d", "e", "f"]) + [("f", "p"), ("p", "q"), ("q", "r")] + ring(list("rst")) + [("s", "1"), ("1", "2"), ("2", "r"), ("b", "3"), ("3", "4"), ("4", "b")]
    yield [(str(i), str(i + 1)) for i in range(30)] + [("30", "12"), ("20", "15")]
    for n, m in ((12, 14),):
        yield [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)]


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_strong_components(spark, small):
    for edges in shapes():
        assert found_components(spark, edges, small) == plain_components(edges)


def test_a_long_ring_takes_few_rounds(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("cast(id as string) from_id", f"cast((id + 1) % {n} as string) to_id")
    steps = cycles._Steps(spark)
    found = cycles.strong_components(edges, 0, steps)
    assert found.count() == n and found.select("scc").distinct().count() == 1 and steps.rounds < 40


@pytest.mark.parametrize("small", [0, 6, 1 << 18])
def test_admitted_as_one_after_another(spark, small):
    rng = random.Random(small)
    names = [f"n{i}" for i in range(14)]
    stored = {(names[a], names[z]) for a, z in (sorted(rng.sample(range(14), 2)) for _ in range(9))}
    asked = list({(rng.choice(names), rng.choice(names)) for _ in range(26 if small > 6 else 12)} - stored)
    rng.shuffle(asked)
    asked += [next(iter(stored))]
    have, want = set(stored), set()
    for a, z in asked:
        if a != z and a not in reach(have, z):
            have.add((a, z))
            want.add((a, z))
    df = spark.createDataFrame([(*e, k) for k, e in enumerate(asked)], PAIR + ", place long")
    got = cycles.admitted(spark.createDataFrame(sorted(stored), PAIR), df, None, small)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_closes_cycle_alone(spark, small):
    stored = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    asked = [("d", "a"), ("a", "c"), ("c", "x"), ("y", "b"), ("q", "q"), ("c", "b"), ("z", "a")]
    got = cycles.closes_cycle(spark.createDataFrame(stored, PAIR), spark.createDataFrame(asked, PAIR), small)
    assert {tuple(r) for r in got.collect()} == {("d", "a"), ("q", "q"), ("c", "b")}


def test_judge_as_a_sequence_of_writes(spark):
    """Random proposals, among them repeats and stored ones, get the fate that writing them one by one gives them."""
    rng = random.Random(11)
    names = [f"n{i:02d}" for i in range(25)]
    planes = {x: rng.choice(["Derived", "Derived", "Asserted"]) for x in names[:-2]}
    nodes = spark.createDataFrame(sorted(planes.items()), "id string, plane string")
    kinds = "from_id string, to_id string, kind string, quarantined boolean, at long"
    stored = sorted({(names[a], names[z]) for a, z in (sorted(rng.sample(range(23), 2)) for _ in range(14))})
    asked = [(rng.choice(names), rng.choice(names), rng.choice(["Supersedes"] * 9 + ["Refutes"]), rng.random() < 0.05, rng.randrange(40)) for _ in range(80)]
    have, want = set(stored), {}
    for a, z, kind, loose, at in sorted(asked, key=lambda x: (x[4], x[0], x[1])):
        if kind != "Supersedes":
            reason = "kind"
        elif loose:
            reason = "quarantined"
        elif a == z:
            reason = "self"
        elif a not in planes or z not in planes:
            reason = "missing"
        elif planes[a] == "Asserted" and planes[z] == "Derived":
            reason = "plane"
        elif a in reach(have, z):
            reason = "cycle"
        else:
            reason = None
            have.add((a, z))
        want.setdefault((a, z, kind, loose, at), reason)
    links = spark.createDataFrame([(a, z, "Supersedes", False, 0) for a, z in stored], kinds)
    got = supersede.judge(nodes, links, spark.createDataFrame(asked, kinds)).collect()
    assert len(got) == len(asked) and {tuple(r)[:5]: r["reason"] for r in (r for r in got)} == want or {(r["from_id"], r["to_id"], r["kind"], r["quarantined"], r["at"]): r["reason"] for r in got} == want
