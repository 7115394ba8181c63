"""Labels of commit histories against walking them."""

import random

import pytest

from quillgraph.operators import jobs, lineage

EDGE = "from_id string, to_id string, kind string"


def history(seed, n):
    """Commits c000, c001, ... with one first parent and up to two more, and who reaches whom."""
    rng = random.Random(seed)
    edges, behind = [], {}
    for i in range(n):
        x = f"c{i:03d}"
        behind[x] = {x}
        if i and rng.random() < 0.97:
            parents = [f"c{rng.randrange(max(0, i - 6), i):03d}"]
            while rng.random() < 0.2:
                parents.append(f"c{rng.randrange(i):03d}")
            for k, p in enumerate(dict.fromkeys(parents)):
                edges.append((x, p, "MergeParent" if k else "TemporalNext"))
                behind[x] |= behind[p]
    return edges, behind


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 40), (3, 90)])
def test_labels(spark, seed, n):
    edges, behind = history(seed, n)
    spine, ids = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in behind], "id string")
    known = lineage.labels(spine, ids)
    rows = known.collect()
    assert sorted(r["id"] for r in rows) == sorted(behind) and len({(r["chain"], r["pos"]) for r in rows}) == n
    side = lineage.crossings(spine, known)
    heads = random.Random(seed).sample(sorted(behind), min(4, n))
    pairs = [(a, h) for a in behind for h in heads] + [("nobody", heads[0])]
    got = lineage.are_ancestors(known, side, spark.createDataFrame(pairs, "ancestor string, head string")).collect()
    assert {(r["ancestor"], r["head"]) for r in got if r["holds"]} == {(a, h) for a, h in pairs if a in behind[h]} and len(got) == len(pairs)
    some = spark.createDataFrame([(h,) for h in heads], "id string")
    assert sorted(r["id"] for r in lineage.canonical(known, side, some).collect()) == sorted(set().union(*(behind[h] for h in heads)))
    assert lineage.canonical(known, side, some.where("false")).count() == 0


def test_labels_grow(spark):
    """Labelled push by push: old labels stay, and the answers are those of all at once."""
    edges, behind = history(5, 60)
    known = spark.createDataFrame([], lineage.LABELS)
    for a, z in ((0, 25), (25, 26), (26, 60)):
        new = {f"c{i:03d}" for i in range(a, z)}
        own = lineage.labels(spark.createDataFrame([e for e in edges if e[0] in new], EDGE), spark.createDataFrame([(x,) for x in sorted(new)], "id string"), known)
        assert {r["id"] for r in own.collect()} == new
        known = known.unionByName(own)
    rows = known.collect()
    assert len({(r["chain"], r["pos"]) for r in rows}) == 60
    side = lineage.crossings(spark.createDataFrame(edges, EDGE), known)
    pairs = [(a, h) for a in behind for h in ("c059", "c030")]
    got = lineage.are_ancestors(known, side, spark.createDataFrame(pairs, "ancestor string, head string")).collect()
    assert {(r["ancestor"], r["head"]) for r in got if r["holds"]} == {(a, h) for a, h in pairs if a in behind[h]}


def test_pending_commits_label_a_history_once(spark, monkeypatch):
    edges, behind = history(4, 60)
    parents = {x: [] for x in behind}
    for a, z, _ in edges:
        parents[a].append(z)
    heads, marks = {"r": "c059", "s": "c040"}, {"r": "c045", "s": "gone", "t": "c003"}
    made, labels = [], lineage.labels
    monkeypatch.setattr(lineage, "labels", lambda *a: made.append(1) or labels(*a))
    text = "repo string, head string"
    got = jobs.pending_commits(spark.createDataFrame(list(parents.items()), "sha string, parents array<string>"), spark.createDataFrame(list(heads.items()), text), spark.createDataFrame(list(marks.items()), text))
    every = behind["c059"] | behind["c040"]
    done = behind["c045"] if "c045" in every else set()
    assert sorted(r["sha"] for r in got.collect()) == sorted(every - done) and len(made) == 1
