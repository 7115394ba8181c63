import random

import pytest
from pyspark.sql import functions as F

from quillgraph.memory import MemoryGraph
from quillgraph.operators import access, anchor, ann, cycles, graph, ingest, merge, recall, scene, supersede

NODE = "id string, repo string, kind string, plane string, status string, author string, trust_tier string, valid_from long, valid_to long, signature binary, confidence array<tinyint>, content binary, source_ref struct<tag:string,repo:string,path:string,key:string>"


def node(i, repo="r", at=100, **more):
    row = {"id": i, "repo": repo, "kind": "commit", "plane": "Derived", "status": "Active", "author": "t", "trust_tier": "DerivedDeterministic", "valid_from": at, "valid_to": None, "signature": None, "confidence": [], "content": bytearray(i.encode()), "source_ref": None}
    return {**row, **more}


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def edges(spark, *rows):
    full = [(r + (False,))[:4] + (r[4:] or (100,)) if len(r) == 3 else r + (100,) if len(r) == 4 else r for r in rows]
    return spark.createDataFrame(full, "from_id string, to_id string, kind string, quarantined boolean, at long")


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_storyline_and_as_of(spark):
    df = nodes(spark, node("a", at=100, valid_to=150), node("b", at=200), node("c", at=200, plane="Asserted"), node("d", at=300), node("x", repo="other"))
    own = recall.tenant(df, "r")
    assert ids(recall.storyline(own, 3)) == ["d", "b", "c"]
    assert ids(recall.as_of(own, 149, 9)) == ["a"] and ids(recall.as_of(own, 150, 9)) == []
    assert ids(recall.as_of(own, 250, 9)) == ["b"] and ids(recall.as_of(own, 250, 9, asserted=True)) == ["b", "c"]


def test_tenant_scan_and_prefix(spark):
    stub = {"tag": "dag_native", "repo": None, "path": None, "key": "ref:x"}
    df = nodes(spark, node("ab1"), node("ab2", source_ref=stub), node("ac", kind="branch"), node("ad"))
    assert sorted(ids(recall.tenant(df, "r", spark.createDataFrame([("ad",)], "id string")))) == ["ab1"]
    assert ids(recall.resolve_prefix(df, "AB")) == [] and ids(recall.resolve_prefix(df, "ab1")) == ["ab1"] and ids(recall.resolve_prefix(df, "z")) == []


def test_neighbors_budget_after_grants(spark):
    df = nodes(spark, node("a"), node("b", repo="secret"), node("c"), node("d"))
    links = edges(spark, ("a", "b", "References"), ("a", "c", "References"), ("a", "gone", "Touches"), ("d", "a", "References"))
    assert ids(recall.neighbors(df, links, "a", 2), "far_id") == ["b", "c"]
    readable = spark.createDataFrame([("r",)], "repo string")
    assert ids(recall.neighbors(df, links, "a", 9, readable), "far_id") == ["c", "gone", "d"]


def test_verify_and_verdict(spark):
    df = nodes(spark, node("a"), node("b"), node("c", repo="secret"), node("d", plane="Asserted"), node("e", confidence=[1, 3]))
    links = edges(spark, ("b", "a", "Supersedes"), ("c", "a", "Refutes"), ("d", "a", "Contradicts", True), ("gone", "b", "Refutes"), ("e", "b", "Contradicts"))
    got = {r["id"]: r for r in recall.verify(df, links).collect()}
    assert got["a"]["superseded_by"] == ["b"] and got["a"]["refuted_by"] == ["c"] and not got["a"]["trustworthy"]
    assert got["b"]["refuted_by"] == ["e", "gone"] and got["d"]["posture"] == "missing" and got["e"]["contradicted"]
    readable = spark.createDataFrame([("r",)], "repo string")
    got = {r["id"]: r for r in recall.verify(df, links, readable).collect()}
    assert got["a"]["refuted_by"] == [] and got["b"]["refuted_by"] == ["e"] and got["c"]["trustworthy"]
    verdicts = {r["id"]: r["verdict"] for r in recall.verdict(df, links, readable).collect()}
    assert verdicts == {"a": "superseded", "b": "contradicted", "c": "contradicted", "d": "current", "e": "contradicted"}


def test_critique(spark):
    df = nodes(spark, node("a", status="Superseded"), node("b", confidence=[3]), node("c"))
    links = edges(spark, ("c", "x", "References", True))
    gaps = recall.critique(df, 5, links)
    assert sorted((r["gap"], r["id"]) for r in gaps.collect() if r["id"]) == [("adjacent_proposal", "c"), ("contradicted", "b")]
    assert recall.completeness(gaps).first()[0] == pytest.approx(1 / 5)
    assert recall.critique(df.where("id = 'c'"), 1, links.where("false")).count() == 0


def test_in_flight(spark):
    tip = lambda name, **k: node(f"br-{name}", kind="branch", content=bytearray(f"{name}@tip".encode()), **k)
    df = nodes(spark, node("a"), node("b"), node("w"), tip("old", status="Archived"), tip("live"))
    links = edges(spark, ("b", "a", "TemporalNext"), ("br-old", "w", "BranchContains"), ("br-live", "w", "BranchContains"), ("br-live", "a", "BranchContains"))
    merged = recall.canonical(df, links, spark.createDataFrame([("b",)], "id string"))
    assert sorted(ids(merged)) == ["a", "b"]
    assert [tuple(r) for r in recall.in_flight(df, links, merged).collect()] == [("w", "live")]


def test_canonical_history(spark):
    line = [(f"c{i:03d}", f"c{i - 1:03d}", "TemporalNext") for i in range(1, 40)]
    side = [("s2", "s1", "TemporalNext"), ("s1", "c003", "TemporalNext"), ("c020", "s2", "MergeParent"), ("u1", "c005", "TemporalNext"), ("s2", "t1", "MergeParent")]
    links = edges(spark, *line, *side, ("c030", "q", "References"))
    head = spark.createDataFrame([("c025",)], "id string")
    assert sorted(ids(recall.canonical(None, links, head))) == sorted([f"c{i:03d}" for i in range(26)] + ["s1", "s2", "t1"])
    loop = edges(spark, ("a", "b", "TemporalNext"), ("b", "c", "TemporalNext"), ("c", "a", "TemporalNext"))
    assert sorted(ids(recall.canonical(None, loop, spark.createDataFrame([("a",)], "id string")))) == ["a", "b", "c"]
    assert ids(recall.canonical(None, loop, head.where("false"))) == []


def test_analogies(spark):
    data = "id string, repo string, embedding struct<model:string,data:array<float>>"
    df = spark.createDataFrame([("a", "r", ("m", [1.0, 0.0])), ("b", "s", ("m", [1.0, 0.1])), ("c", "s", ("m", [1.0, 0.2])), ("d", "s", ("n", [1.0, 0.0])), ("e", "t", ("m", [1.0, 0.0])), ("z", "r", None)], data)
    links = edges(spark, ("a", "x", "Decides"), ("c", "x", "Decides"), ("b", "x", "Decides", True))
    repos = spark.createDataFrame([("s",), ("r",)], "repo string")
    got = [(r["id"], round(r["structural"], 3)) for r in recall.analogies(df, links, "a", repos, 5).collect()]
    assert got == [("c", 1.0), ("b", 0.0)]
    assert recall.analogies(df, links, "z", repos, 5).count() == 0
    with pytest.raises(LookupError):
        recall.analogies(df, links, "nobody", repos, 5)


def test_reachability(spark):
    links = edges(spark, ("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("x", "y", "k"))
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(ids(graph.reachable(links, start))) == ["b", "c"]
    assert graph.reachable(links.where("false"), start).count() == 0
    line = edges(spark, ("a", "b", "k"), ("b", "c", "k"))
    loops = cycles.closes_cycle(line, spark.createDataFrame([("c", "a"), ("a", "c"), ("q", "q")], "from_id string, to_id string"))
    assert sorted(map(tuple, loops.collect())) == [("c", "a"), ("q", "q")]
    assert sorted(map(tuple, graph.neighbourhood(line, start, 2).collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_supersession(spark):
    df = nodes(spark, node("a", at=100), node("b", at=200), node("c", at=300, plane="Asserted"), node("d", at=400, status="Archived"))
    claims = edges(
        spark, ("b", "a", "Supersedes", False, 50), ("d", "a", "Supersedes", False, 500), ("a", "b", "Supersedes", False, 600), ("c", "b", "Supersedes", False, 1),
        ("a", "a", "Supersedes", False, 1), ("x", "a", "Supersedes", False, 1), ("b", "d", "Refutes", False, 1), ("a", "d", "Supersedes", True, 1), ("b", "d", "Supersedes", False, 10),
    )
    judged = supersede.judge(df, claims.where("false"), claims)
    reasons = {(r["from_id"], r["to_id"], r["kind"]): r["reason"] for r in judged.collect()}
    assert reasons[("c", "b", "Supersedes")] == "plane" and reasons[("a", "a", "Supersedes")] == "self" and reasons[("x", "a", "Supersedes")] == "missing"
    assert reasons[("b", "d", "Refutes")] == "kind" and reasons[("a", "d", "Supersedes")] == "quarantined"
    assert reasons[("b", "a", "Supersedes")] is None and reasons[("a", "b", "Supersedes")] == "cycle"
    out = {r["id"]: (r["status"], r["valid_to"]) for r in supersede.apply_supersessions(df, judged).collect()}
    assert out["a"] == ("Superseded", 100) and out["d"][0] == "Archived" and out["b"][0] == "Active"


def test_confirm_and_demotion(spark):
    links = edges(spark, ("a", "b", "Supersedes", True, 1), ("a", "c", "Refutes", False, 1))
    confirmed = supersede.confirm(links, links.select("from_id", "to_id", "kind"), 9)
    assert sorted((r["kind"], r["quarantined"], r["at"]) for r in confirmed.collect()) == [("Refutes", False, 1), ("Supersedes", False, 9)]
    again = supersede.upsert_edges(confirmed, links.withColumn("quarantined", F.lit(True)))
    assert again.where("quarantined").count() == 0 and again.count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_merge_converges(spark, seed):
    rng = random.Random(seed)

    def copy(i):
        return (i, rng.choice(["Active", "Superseded", "Archived"]), rng.choice([None, 5, 9]), rng.choice(["DerivedDeterministic", "AgentAsserted", "InferredAdvisory"]), rng.randint(1, 9), rng.randint(1, 9), bytearray(rng.choice([b"\xff", b"\x01"])), [rng.randint(0, 3) for _ in range(rng.randint(0, 3))], rng.choice([None, ("m", [rng.choice([1.0, -1.0])])]))

    schema = "id string, status string, valid_to long, trust_tier string, valid_from long, observed_at long, signature binary, confidence array<tinyint>, embedding struct<model:string,data:array<float>>"
    rows = [copy(rng.choice("abc")) for _ in range(20)]
    whole = sorted(map(repr, merge.merge_nodes(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    parts = [merge.merge_nodes(spark.createDataFrame(p, schema)) for p in (rows[:7], rows[5:13], rows[13:] + rows[:2])]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    again = [r.asDict() for r in merge.merge_nodes(joined).collect()]
    assert sorted(repr(r) for r in merge.merge_nodes(joined).select(*merge.merge_nodes(spark.createDataFrame(rows, schema)).columns).collect()) == whole
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    rank = {"Active": 0, "Superseded": 1, "Archived": 2}
    for r in again:
        own = by_id[r["id"]]
        top = max(rank[x[1]] for x in own)
        ends = [x[2] for x in own if rank[x[1]] == top and x[2] is not None]
        assert rank[r["status"]] == top and r["valid_to"] == (min(ends) if ends else None) and r["valid_from"] == min(x[4] for x in own)


def test_edge_merge_and_export(spark):
    schema = "from_id string, to_id string, kind string, quarantined boolean, trust_tier string, plane string, confidence array<tinyint>"
    df = spark.createDataFrame([("a", "b", "k", True, "AgentAsserted", "x", [1]), ("a", "b", "k", False, "DerivedDeterministic", "y", [2, 1])], schema)
    row = merge.merge_edges(df).first()
    assert (row["quarantined"], row["trust_tier"], row["plane"], row["confidence"]) == (False, "AgentAsserted", "x", [3, 1])
    own = nodes(spark, node("a"), node("b", repo="s"))
    links = edges(spark, ("b", "a", "References"), ("a", "b", "References"))
    exported = merge.export(own, links, "r")
    assert ids(exported[0]) == ["a"] and ids(exported[1], "from_id") == ["a"]
    grants = spark.createDataFrame([("r", True)], "repo string, can_write boolean")
    assert [r["repo"] for r in merge.unwritable(own.where("id = 'a'"), links, own, grants).collect()] == ["s"]


def test_merkle(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    leaves = [h(bytes([i])) for i in range(5)]
    df = spark.createDataFrame([(i, x.hex()) for i, x in enumerate(leaves)], "pos long, hash string")
    l1 = [h(leaves[0] + leaves[1]), h(leaves[2] + leaves[3]), h(leaves[4])]
    l2 = [h(l1[0] + l1[1]), h(l1[2])]
    assert anchor.merkle_root(df, "r") == h(l2[0] + l2[1]).hex()
    assert anchor.merkle_root(df.where("false"), "r") == hashlib.sha256(b"r").hexdigest()
    own = nodes(spark, node("aa" * 32), node("bb" * 32))
    links = edges(spark, ("aa" * 32, "bb" * 32, "References"))
    first = anchor.anchor(own, links, "r", 1)
    second = anchor.anchor(own, links, "r", 2, first)
    assert second["root"] == first["root"] and second["prev"] and anchor.still_holds(second, own, links)
    assert not anchor.still_holds(second, own.withColumn("status", F.lit("Archived")), links)
    with pytest.raises(ValueError, match="block"):
        anchor.bind(first, None)


def test_audit_chain(spark):
    import hashlib

    rows, prev = [], "0" * 64
    for i in range(6):
        rows.append((i, 10 * i, prev, "Read", "u", "r", "d"))
        data = b""
        for tag, value in enumerate((b"audit:v1", i.to_bytes(8, "little"), (10 * i).to_bytes(8, "little"), bytes.fromhex(prev), b"Read", b"u", b"r", b"d")):
            data += bytes([tag]) + len(value).to_bytes(8, "little") + value
        prev = hashlib.sha256(data).hexdigest()
    schema = "sequence long, timestamp_ms long, prev_hash string, event string, actor string, resource_id string, detail string"
    log = spark.createDataFrame(rows, schema)
    assert tuple(access.verify_audit(log).first()) == (6, None, None)
    assert tuple(access.verify_audit(log.withColumn("actor", F.when(F.col("sequence") == 2, "evil").otherwise(F.col("actor")))).first()) == (6, 3, "prev_hash")
    assert tuple(access.verify_audit(log.where("sequence <> 3")).first()) == (5, 4, "sequence")


def test_sealing(spark):
    rows = spark.createDataFrame([("t1", "a", bytearray(b"one")), ("t2", "b", bytearray(b"two"))], "tenant string, id string, content binary")
    ring = spark.createDataFrame([("t1", 1, bytearray(b"k" * 32)), ("t2", 1, bytearray(b"q" * 32))], "tenant string, generation int, key binary")
    sealed = access.seal(rows, ring)
    assert sorted(map(repr, sealed.collect())) == sorted(map(repr, access.seal(rows, ring).collect()))
    assert {(r["id"], bytes(r["content"])) for r in access.unseal(sealed, ring).collect()} == {("a", b"one"), ("b", b"two")}
    gone = access.shred(ring, "t1")
    assert ids(access.unseal(sealed, gone)) == ["b"]
    renewed = access.ensure_keys(gone, rows, F.lit(bytearray(b"n" * 32)))
    assert {(r["tenant"], r["generation"]) for r in renewed.collect()} == {("t1", 2), ("t2", 1)}
    assert ids(access.unseal(sealed, renewed)) == ["b"]
    with pytest.raises(Exception, match="(?i)tag|decrypt|AES"):
        access.unseal(sealed.withColumn("id", F.lit("z")), ring).collect()


def test_token_bucket_and_quota(spark):
    calls = spark.createDataFrame([("u", 1, 0.0, 1), ("u", 2, 0.0, 1), ("u", 3, 0.0, 1), ("u", 4, 0.5, 1), ("v", 5, 9.0, 3)], "principal string, call_id int, ts double, cost int")
    got = {r["call_id"]: r["allowed"] for r in access.token_bucket(calls, 2, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
    spans = spark.createDataFrame([("u", 0, 10), ("u", 5, 7), ("u", 7, 9), ("v", 1, 2)], "principal string, start long, stop long")
    assert {tuple(r) for r in access.overlaps(spans).collect()} == {("u", 2), ("v", 1)}


def test_ingest(spark):
    stored = spark.createDataFrame([("C@1", "Active"), ("C@0", "Superseded"), ("D@5", "Active")], "key string, status string")
    fresh = spark.createDataFrame([("C@2",), ("D@5",)], "key string")
    assert [tuple(r) for r in ingest.redeploys(stored, fresh).collect()] == [("C@2", "C@1")]
    tx = "array<struct<hash:string,`from`:string,`to`:string,value:string>>"
    blocks = spark.createDataFrame([(7, "h7", "h6", [("t1", "0xA", "0xB", "0x1"), ("t2", "0xC", None, "0x0")]), (8, "h8", "h7", []), (9, "h9", "fork", [])], f"number long, hash string, parent_hash string, transactions {tx}")
    watched = spark.createDataFrame([("0xb",), ("0xC",)], "address string")
    known = spark.createDataFrame([(6, "h6"), (8, "old8")], "number long, hash string")
    out = ingest.block_walk(blocks, watched, known)
    assert sorted(r["number"] for r in out["spine"].collect()) == [7, 8]
    assert sorted((r["tx"], r["address"]) for r in out["events"].collect()) == [("t1", "0xb"), ("t2", "0xc")]
    assert [tuple(r) for r in out["orphans"].collect()] == [(8, "old8", "h8")]
    branches = spark.createDataFrame([("1", "gone", "x"), ("2", "moved", "x"), ("3", "in", "m"), ("4", "live", "y")], "id string, name string, tip string")
    live = spark.createDataFrame([("moved", "z"), ("in", "m"), ("live", "y")], "name string, tip string")
    states = ingest.branch_states(branches, live, spark.createDataFrame([("m",)], "sha string"))
    assert {r["name"]: r["state"] for r in states.collect()} == {"gone": "deleted", "moved": "advanced", "in": "merged", "live": "active"}


def test_scene_and_index(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    grid = rng.normal(size=(200, 6)) * np.array([9, 5, 3, 1, 1, 1])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(grid)], "id long, v array<float>")
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in scene.project(df, "v", 6).collect()}
    centred = grid.astype(np.float32).astype(float) - grid.astype(np.float32).astype(float).mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for k in range(2):
        want = centred @ axes[k]
        mine = np.array([got[i][k] for i in range(200)])
        assert abs(np.corrcoef(want, mine)[0, 1]) > 0.99 and abs(np.abs(mine).max() - 1) < 1e-9
    index = ann.CellIndex(df.withColumnRenamed("v", "data"), "data", cells=8, probe=4)
    unit = grid / np.linalg.norm(grid, axis=1)[:, None]
    hits = 0
    for q in range(10):
        exact = set(np.argsort(-(unit @ unit[q]))[:10].tolist())
        hits += len(exact & set(ids(index.search(grid[q].tolist(), 10))))
    assert hits >= 80


def test_index_of_many_queries_is_exact(spark):
    import os

    import duckdb
    import numpy as np
    import pytest

    from quillgraph.plans import catalogue

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet' ORDER BY vec_id").fetchall()
    keys, grid = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    unit = grid / np.linalg.norm(grid, axis=1)[:, None]
    got = {}
    for r in catalogue.ann_topk(spark, data).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert sorted(got) == [k for k in keys.tolist() if k % 50 == 0]
    for q, found in got.items():
        scores = unit @ unit[keys == q][0]
        exact = keys[np.lexsort((keys, -np.round(scores, 12)))][:10]
        assert {k for _, k in found} == set(exact.tolist())
    # Far-off and zero vectors, one probed cell, fewer rows than asked for, ties by id.
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "id long, data array<float>")
    index = ann.CellIndex(df, "data", cells=4, probe=1)
    for most, want in ((3, [1, 4, 2]), (9, [1, 4, 2, 5, 3])):
        found = index.search_each(df.where("id = 1"), most).orderBy(F.desc("score"), "id").collect()
        assert [r["id"] for r in found] == want


def test_later_cells_yield_only_what_may_be_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    grid = rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(k, row) for k, row in enumerate(grid.tolist())], "id long, data array<double>")
    index = ann.CellIndex(df, "data")
    found = index.search_each(df.where("id % 5 = 0"), 10).collect()
    unit = grid / np.linalg.norm(grid, axis=1)[:, None]
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {q: set(np.argsort(-(unit @ unit[q]))[:10].tolist()) for q in range(0, 2000, 5)}
    # Rows out of the scoring of the last run: all blocks with ten each would be over 100,000.
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes().iterator(), 0
    while nodes.hasNext():
        node = nodes.next()
        metrics = node.metrics().iterator() if node.name() == "MapInArrow" else None
        while metrics is not None and metrics.hasNext():
            m = metrics.next()
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert 0 < most < 40_000


def test_hash_embedding_of_all_documents(spark):
    import hashlib
    import math
    import os
    import unicodedata

    import duckdb

    from quillgraph.plans import catalogue

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    want, tokens_of = {}, {}
    for key, text in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall():
        kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower())
        tokens_of[key] = kept.split()
        sums = {}
        for token in tokens_of[key]:
            h = hashlib.sha256(token.encode()).hexdigest()
            at = int(h[:8], 16) % 256
            sums[at] = sums.get(at, 0) + (1 if int(h[16], 16) % 2 == 0 else -1)
        size = math.sqrt(sum(w * w for w in sums.values()))
        want |= {(key, at): w / size for at, w in sums.items() if w}
    got = {(r["doc_id"], r["bucket"]): r["weight"] for r in catalogue.hash_embed_all(spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert {k for k, _ in got} == {k for k, t in tokens_of.items() if t}


def test_ring_holds_every_row(spark):
    import math

    from quillgraph.plans import catalogue

    df = spark.createDataFrame([(f"n{i:04}",) for i in range(600)], "id string").repartition(7)
    got = {r["id"]: (r["x"], r["y"]) for r in scene.ring(df).collect()}
    assert len(got) == 600
    for i in range(600):
        x, y = got[f"n{i:04}"]
        assert abs(x - math.cos(2 * math.pi * i / 600)) < 1e-9 and abs(y - math.sin(2 * math.pi * i / 600)) < 1e-9
    assert "scene_ring" in catalogue.QUERIES and "scene_ring" in catalogue.ORACLE


def test_memory_graph(spark):
    df = nodes(spark, node("a", at=1), node("b", at=2), node("c", repo="secret", at=3))
    links = edges(spark, ("b", "a", "TemporalNext"))
    own = MemoryGraph(df, links, spark.createDataFrame([("r",)], "repo string"))
    assert ids(own.recall("r")) == ["b", "a"] and ids(own.recall("secret")) == []
    assert ids(own.neighbors("a"), "far_id") == ["b"] and ids(own.reachable("b", "TemporalNext")) == ["a"]
    assert ids(own.as_of("r", 1)) == ["a"] and ids(own.resolve("c")) == []
    more = own.propose(edges(spark, ("a", "b", "Refutes"), ("b", "a", "TemporalNext")))
    assert more.edges.where("quarantined").count() == 1
    assert own.verify("a").first()["trustworthy"] and own.critique("r", 1).count() == 1


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, data array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "id string, data array<float>")
    for index in (ann.CellIndex(none, "data"), ann.CellIndex.cached(none, "data", f"file://{tmp_path}", "w")):
        assert index.search([1.0, 0.0], 3).count() == 0 and index.search([1.0, 0.0], 3).columns == ["id", "score"]
        assert index.search_each(asked, 3).count() == 0 and index.search_each(asked, 3).columns == ["query_id", "id", "score"]
    full = ann.CellIndex(asked, "data")
    assert full.search_each(none, 3).count() == 0 and [r["id"] for r in full.search([1.0, 0.0], 3).collect()] == ["q"]
