"""Ingest jobs, grants, audit and lookups on small cases."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ed25519
from quillgraph.memory import MemoryGraph
from quillgraph.operators import access, assertions, jobs, supersede
from quillgraph.sources.delta import Conflict

COMMIT = "repo string, sha string, parents array<string>, author string, time_secs long, subject string, body string"


def test_ingest_job(spark, tmp_path):
    store = jobs.open_store(spark, f"file://{tmp_path}/store")
    trailer = "why\n\nAgentile-Supersedes: c1\nAgentile-References: R-1"
    rows = [("r", "c1", [], "me", 1, "one", ""), ("r", "c2", ["c1"], "me", 2, "two", trailer), ("r", "c3", ["c2"], "you", 3, "three", "x\n\nAgentile-Supersedes: c2")]
    commits = spark.createDataFrame(rows, COMMIT)
    who = spark.createDataFrame([("me",)], "author string")
    head = lambda x: spark.createDataFrame([("r", x)], "repo string, head string")
    assert jobs.run_ingest(store, commits.where("sha in ('c1', 'c2')"), head("c2"), who, 10) == {"commits": 2, "refused": 0}
    status = {r["sha"]: r["status"] for r in store.read("nodes").collect()}
    assert status == {"c1": "Superseded", "c2": "Active", "ref:R-1": "Active"}
    assert jobs.run_ingest(store, commits, head("c3"), who, 11)["commits"] == 1
    assert jobs.run_ingest(store, commits, head("c3"), who, 12)["commits"] == 0
    edges = sorted((r["kind"], r["quarantined"]) for r in store.read("edges").collect())
    assert edges == [("References", False), ("Supersedes", False), ("Supersedes", True), ("TemporalNext", False), ("TemporalNext", False)]
    assert [tuple(r) for r in store.read("meta").collect()] == [("r", "watermark", "c3", 12)]
    # Rewritten history: the watermark is no ancestor of the new head, so all of it is due; nothing stored is lost.
    other = spark.createDataFrame([("r", "d1", [], "me", 4, "one", ""), ("r", "d2", ["d1"], "me", 5, "two", "")], COMMIT)
    assert jobs.run_ingest(store, other, head("d2"), who, 13)["commits"] == 2
    assert store.read("nodes").count() == 6


def test_ingest_of_documents(spark, tmp_path):
    store = jobs.open_store(spark, f"file://{tmp_path}/store")
    commits = spark.createDataFrame([("r", "c1", [], "me", 1, "one", "")], COMMIT)
    who, head = spark.createDataFrame([("me",)], "author string"), spark.createDataFrame([("r", "c1")], "repo string, head string")
    docs = lambda *rows: spark.createDataFrame([("r", p, "s", t) for p, t in rows], "repo string, path string, git_sha string, text string")
    a = ("a.md", "# A\n```agentile\nref: c1\nref: R-9\nsupersedes: c1\n```\n")
    run = lambda now, *rows: jobs.run_ingest(store, commits, head, who, now, docs(*rows), compact_after=1)
    assert run(10, a, ("b.md", "# B\n")) == {"commits": 1, "refused": 0, "documents": 2, "gone": 0}
    kinds = lambda: sorted((r["kind"], r["quarantined"]) for r in store.read("edges").collect())
    assert kinds() == [("References", False), ("References", False), ("Supersedes", True)]
    assert run(11, a, ("b.md", "# B\n")) == {"commits": 0, "refused": 0, "documents": 0, "gone": 0}
    assert run(12, a, ("c.md", "# C\n")) == {"commits": 0, "refused": 0, "documents": 1, "gone": 1}
    status = {r["sha"]: r["status"] for r in store.read("nodes").collect()}
    assert status == {"c1": "Active", "ref:R-9": "Active", "doc:a.md": "Active", "doc:b.md": "Archived", "doc:c.md": "Active"}
    assert len(kinds()) == 3 and store.state()[1]["nodes"]["base"]  # the second commit was folded into a base


def test_confirm_and_merge_through_the_guards(spark):
    kinds = "id string, repo string, author string, plane string, status string, valid_from long, valid_to long, trust_tier string, confidence array<tinyint>"
    row = lambda i, **more: tuple(({"id": i, "repo": "r", "author": i, "plane": "Derived", "status": "Active", "valid_from": 1, "valid_to": None, "trust_tier": "AgentAsserted", "confidence": [1]} | more).values())
    links = "from_id string, to_id string, kind string, quarantined boolean, at long, trust_tier string"
    edge = lambda a, z, kind="Supersedes", loose=True, at=2: (a, z, kind, loose, at, "AgentAsserted")
    nodes = spark.createDataFrame([row(x) for x in "abc"] + [row("p", plane="Asserted")], kinds)
    g = MemoryGraph(nodes, spark.createDataFrame([], links))
    asked = spark.createDataFrame([edge("a", "b"), edge("b", "a"), edge("a", "a"), edge("p", "c"), edge("a", "c", "References")], links)
    g = g.propose(asked, "me", 5)
    fate = lambda who: {(r["from_id"], r["to_id"]): r["outcome"] for r in g.confirm(asked, 9, who).outcomes.collect()}
    assert fate("you") == {("a", "b"): "confirmed", ("b", "a"): "cycle", ("a", "a"): "self", ("p", "c"): "plane", ("a", "c"): "confirmed"}
    assert set(fate("me").values()) == {"second party", "confirmed"} and fate("b")[("a", "b")] == "confirmed" and fate(None)[("a", "b")] == "second party"
    after = g.confirm(asked, 9, "you")
    assert {r["id"]: (r["status"], r["valid_to"]) for r in after.nodes.collect()} == {"a": ("Active", None), "b": ("Superseded", 9), "c": ("Active", None), "p": ("Active", None)}
    assert sorted((r["from_id"], r["to_id"]) for r in after.edges.where("not quarantined").collect()) == [("a", "b"), ("a", "c")]
    again = after.confirm(asked.unionByName(spark.createDataFrame([edge("x", "y")], links)), 10, "you").outcomes
    assert {(r["from_id"], r["to_id"]): r["outcome"] for r in again.collect()}[("x", "y")] == "not found"
    # A replica's bundle: a new node, a changed one, a confirmed supersession, one that closes a cycle, one to nowhere.
    there = spark.createDataFrame([row("d"), row("c", confidence=[2]), row("a")], kinds)
    more = spark.createDataFrame([edge("d", "c", loose=False, at=7), edge("b", "a", loose=False), edge("d", "z", loose=False), edge("p", "c"), edge("d", "a", "References", False)], links)
    with pytest.raises(PermissionError):
        after.merge(there, more, spark.createDataFrame([("s", True)], "repo string, can_write boolean"))
    merged = after.merge(there, more.where("to_id <> 'z'"), spark.createDataFrame([("r", True)], "repo string, can_write boolean"))
    assert merged.counters.first().asDict() == {"nodes_added": 1, "nodes_merged": 1, "edges_added": 2, "edges_merged": 0, "superseded": 1, "rejected_supersessions": 1, "rejected_signatures": 0, "contradictions": 1}
    assert {r["id"]: r["status"] for r in merged.nodes.collect()}["c"] == "Superseded"
    assert after.merge(there, more).counters.first()["rejected_supersessions"] == 2
    again = merged.merge(there, more.where("to_id <> 'z'")).counters.first().asDict()
    assert {k: v for k, v in again.items() if v} == {"rejected_supersessions": 1}


def test_branches(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("x", ["b"]), ("y", ["x"])], "sha string, parents array<string>")
    branches = spark.createDataFrame([("r", "f", "y"), ("r", "g", "b")], "repo string, name string, tip string")
    marks, held = jobs.branch_graph(branches, commits, spark.createDataFrame([("a",), ("b",)], "sha string"))
    assert marks.count() == 2 and sorted(r["sha"] for r in held.collect()) == ["x", "y"]


def test_branches_by_watermark(spark, tmp_path):
    store = jobs.open_store(spark, f"file://{tmp_path}/store")
    row = lambda sha, *parents, body="": ("r", sha, list(parents), "me", 1, sha, body)
    commits = spark.createDataFrame([row("a"), row("b", "a"), row("x", "b", body="t\n\nAgentile-Supersedes: a"), row("y", "x"), row("z", "b")], COMMIT)
    jobs.run_ingest(store, commits, spark.createDataFrame([("r", "b")], "repo string, head string"), spark.createDataFrame([("me",)], "author string"), 1)
    merged = spark.createDataFrame([("a",), ("b",)], "sha string")
    run = lambda now, *tips: jobs.run_branches(store, spark.createDataFrame([("r", *t) for t in tips], "repo string, name string, tip string"), commits, merged, now)
    assert run(5, ("f", "x"), ("g", "b")) == {"branches": 1, "commits": 1, "unchanged": 1}
    assert run(6, ("f", "x"), ("g", "b")) == {"branches": 0, "commits": 0, "unchanged": 2}
    assert run(7, ("f", "y"), ("g", "b"), ("h", "z")) == {"branches": 2, "commits": 3, "unchanged": 1}
    nodes = {r["id"]: r["sha"] for r in store.read("nodes").collect()}
    assert sorted(nodes.values()) == ["a", "b", "branch:f@x", "branch:f@y", "branch:h@z", "x", "y", "z"]
    got = sorted((r["kind"], nodes[r["from_id"]], nodes[r["to_id"]]) for r in store.read("edges").collect())
    assert [e[1:] for e in got if e[0] == "BranchContains"] == [("branch:f@x", "x"), ("branch:f@y", "x"), ("branch:f@y", "y"), ("branch:h@z", "z")]
    assert [e[1:] for e in got if e[0] == "TemporalNext"] == [("b", "a"), ("x", "b"), ("y", "x"), ("z", "b")] and not [e for e in got if e[0] == "Supersedes"]
    assert {r["key"]: r["value"] for r in store.read("meta").collect()} == {"watermark": "b", "branch:f": "y", "branch:g": "b", "branch:h": "z"}


def test_cycle_of_stored_and_new_supersessions(spark):
    nodes = spark.createDataFrame([(x, "Derived") for x in "abcde"], "id string, plane string")
    kinds = "from_id string, to_id string, kind string, quarantined boolean, at long"
    stored = spark.createDataFrame([("b", "c", "Supersedes", False, 1), ("c", "a", "Supersedes", False, 2)], kinds)
    asked = spark.createDataFrame([("a", "b", "Supersedes", False, 3), ("d", "e", "Supersedes", False, 4), ("e", "d", "Supersedes", False, 5), ("b", "d", "Supersedes", False, 6)], kinds)
    got = supersede.judge(nodes, stored, asked)
    assert {(r["from_id"], r["to_id"]): r["reason"] for r in got.collect()} == {("a", "b"): "cycle", ("d", "e"): None, ("e", "d"): "cycle", ("b", "d"): None}


def test_audit_log(spark):
    event = lambda k: {"timestamp_ms": k, "event": "Read", "actor": "me", "resource_id": f"r{k}", "detail": ""}
    empty = spark.createDataFrame([], "sequence long, timestamp_ms long, prev_hash string, event string, actor string, resource_id string, detail string")
    log = access.append_audit(access.append_audit(empty, [event(1), event(2)]), [event(3)])
    assert tuple(access.verify_audit(log).first()) == (3, None, None)
    assert tuple(access.verify_audit(log.unionByName(log.where("sequence = 1"))).first()) == (4, 1, "sequence")
    assert tuple(access.verify_audit(log.where("sequence <> 1")).first()) == (2, 2, "sequence")
    assert tuple(access.verify_audit(log.withColumn("actor", F.when(F.col("sequence") == 0, "you").otherwise("me"))).first()) == (3, 1, "prev_hash")
    heads = log.withColumn("hash", F.sha2(access.audit_preimage(), 256))
    head = lambda n: heads.where(F.col("sequence") == n - 1).select(F.lit(n).alias("records"), "hash")
    state = lambda rows, kept: access.check_head(rows, kept).first()["state"]
    assert [state(log, head(3)), state(log, head(2)), state(log.where("sequence < 2"), head(3)), state(log, head(1)), state(log, head(9))] == ["sound", "ahead", "truncated", "replaced", "unknown"]


def test_signed_grants(spark):
    seed = assertions.writer_seed(b"g", "issuer")
    kinds = "grant_id string, issuer string, recipient string, scopes array<struct<resource:string,can_read:boolean,can_write:boolean>>, policy string, expires_at_ms long, delegations array<struct<delegator:string,at_ms:long>>, issuer_key binary, revoked boolean"
    rows = [(f"g{i}", "a", "b", [("r", True, i == 1), ("*", True, False)], "Open", 10, [("d", 5)], bytearray(ed25519.public_key(seed)), i == 2) for i in range(3)]
    grants = spark.createDataFrame(rows, kinds)
    signatures = [(r["grant_id"], bytearray(ed25519.sign(seed, bytes(r["p"])))) for r in grants.withColumn("p", access.grant_preimage()).collect()]
    signed = grants.join(spark.createDataFrame(signatures, "grant_id string, signature binary"), "grant_id")
    assert {r["grant_id"]: r["signed"] for r in access.signed_grants(signed).collect()} == {"g0": True, "g1": True, "g2": True}
    changed = signed.withColumn("recipient", F.when(F.col("grant_id") == "g0", "c").otherwise(F.col("recipient"))).withColumn("signature", F.when(F.col("grant_id") != "g1", F.col("signature")))
    assert {r["grant_id"]: r["signed"] for r in access.signed_grants(changed).collect()} == {"g0": False, "g1": False, "g2": True}


def test_readable_rows(spark):
    scopes = spark.createDataFrame([("g", 0, "a", False), ("g", 1, "*", True), ("h", 0, "b", True)], "grant_id string, pos int, resource string, can_read boolean")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    assert sorted(r["repo"] for r in access.readable_by(rows, scopes, "g").collect()) == ["b", "c"]
    assert [r["repo"] for r in access.readable_by(rows, scopes, "h").collect()] == ["b"]
    assert sorted(map(tuple, access.readable_repos(scopes, rows).collect())) == [("g", "b"), ("g", "c"), ("h", "b")]


def test_sealed_places(spark):
    ring = spark.createDataFrame([("t", 1, bytearray(b"k" * 32))], "tenant string, generation int, key binary")
    rows = spark.createDataFrame([("t", "1", bytearray(b"x"))], "tenant string, id string, content binary")
    assert bytes(access.unseal(access.seal(rows, ring, "meta"), ring, "meta").first()["content"]) == b"x"
    with pytest.raises(Exception, match="AES|decrypt|Tag|INVALID"):
        access.unseal(access.seal(rows, ring, "meta"), ring, "edges").collect()


def test_asserted_and_merged_diffs(spark):
    seed = assertions.writer_seed(b"g", "me")
    keys = spark.createDataFrame([("me", bytearray(ed25519.public_key(seed)))], "author string, key binary")
    kinds = "id string, repo string, author string, plane string, trust_tier string, status string, valid_from long, valid_to long, observed_at long, signature binary"
    row = lambda i, repo: (i, repo, "me", "Asserted", "AgentAsserted", "Active", 1, None, 1, bytearray(assertions.sign_id(seed, i)))
    a, b = "aa" * 32, "bb" * 32
    edge = (b, a, "References", False, "me", bytearray(ed25519.sign(seed, bytes.fromhex(b + a) + bytes([13]))))
    edges = spark.createDataFrame([edge], "from_id string, to_id string, kind string, quarantined boolean, author string, signature binary")
    g = MemoryGraph(spark.createDataFrame([row(a, "r")], kinds), edges.where("false"))
    fresh = spark.createDataFrame([row(b, "s"), row(a, "r")], kinds)
    after = g.assert_diff(fresh, edges, keys, "me", 5)
    assert after.nodes.count() == 2 and after.edges.count() == 1 and tuple(after.health().first()) == (2, 1, 0, 2)
    grants = spark.createDataFrame([("r", True)], "repo string, can_write boolean")
    with pytest.raises(PermissionError, match="such as s"):
        g.merge_diff(fresh, edges, grants, keys, "me", 5)
    assert g.merge_diff(fresh, edges, grants.unionByName(spark.createDataFrame([("s", True)], "repo string, can_write boolean")), keys, "me", 5).nodes.count() == 2
    with pytest.raises(ValueError, match="refused"):
        g.assert_diff(fresh.withColumn("signature", F.lit(None).cast("binary")), edges, keys, "me", 5)


def test_limits_of_a_diff(spark, monkeypatch):
    from quillgraph import memory

    nodes = spark.createDataFrame([("a", "r")], "id string, repo string")
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string, quarantined boolean")
    g = MemoryGraph(nodes, edges)
    with pytest.raises(ValueError, match="empty"):
        g.merge_diff(nodes.where("false"), edges, None, None, "me", 1)
    monkeypatch.setattr(memory, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="4 MiB"):
        g.merge_diff(nodes, edges, None, None, "me", 1)


def test_grounding(spark):
    hits = spark.createDataFrame([("1", "t", "a:x")], "id string, text string, citation string")
    assert jobs.grounded(hits.union(hits), hits).first()["prompt"] == "[a:x] t\n\n[a:x] t"
    assert jobs.grounded(hits, hits).first()["prompt"] == "[a:x] t" and jobs.grounded(hits.where("false"), hits).first()["citations"] == ["a:x"]


def test_cached_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 4
    grid = (centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 8))).astype(np.float32)
    kinds = "id string, repo string, kind string, embedding struct<model: string, data: array<float>>"
    nodes = spark.createDataFrame([(f"{i:04}", "r" if i % 6 else "s", "doc", ("m", v)) for i, v in enumerate(grid.tolist())], kinds)
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string, quarantined boolean")
    g, path = MemoryGraph(nodes, edges), f"file://{tmp_path}/index"
    look = lambda graph, mark: [r["id"] for r in graph.search_cached("r", grid[5].tolist(), "m", path, mark).collect()]
    want = [r["id"] for r in g.search("r", grid[5].tolist(), "m").collect()]
    assert look(g, "w1") == look(g, "w1") == want and want[0] == "0005"
    (tenant,) = (tmp_path / "index").iterdir()
    assert [p.name for p in tenant.iterdir()] == ["w1-500"]  # the second search built nothing
    cells = {p.name for p in (tenant / "w1-500" / "vectors").glob("cell=*")}
    assert 16 <= len(cells) <= 22
    fewer = MemoryGraph(nodes.where("id <> '0005'"), edges)
    assert "0005" not in look(fewer, "w1") and len(list(tenant.iterdir())) == 2  # another count is another state
    (tenant / "w1-500" / "centres" / "_SUCCESS").unlink()  # a build that died is done again
    assert look(g, "w1") == want
    assert g.search_cached("none", grid[5].tolist(), "m", path, "w1").isEmpty()
    # Zero vectors as queries, and fewer vectors than asked for.
    assert [r["id"] for r in g.search_cached("r", [0.0] * 8, "m", path, "w1", 3).collect()] == ["0001", "0002", "0003"]
    assert g.search_cached("s", grid[5].tolist(), "m", path, "w1", 400).count() == 100


def test_signed_record(spark):
    from quillgraph.functions import ed25519
    from quillgraph.operators import anchor

    record = {"repo": "ré", "root": "ab", "node_count": 2}
    signed = anchor.sign_record(record, b"s" * 32)
    key = ed25519.public_key(b"s" * 32)
    assert signed == anchor.sign_record(record, b"s" * 32)  # the same record gives the same signature
    assert anchor.record_signed(signed) and anchor.record_signed(signed, key) and not anchor.record_signed(signed, b"x" * 32)
    assert not anchor.record_signed({**signed, "record": {**record, "node_count": 3}})
    other = anchor.sign_record({**record, "node_count": 3}, b"s" * 32)
    assert not anchor.record_signed({**other, "signature": signed["signature"]})


def test_progress_lines(spark, tmp_path):
    import json
    import time

    from quillgraph.streaming import streams

    spark.range(5).write.parquet(str(tmp_path / "in"))
    told: list[str] = []
    listener = streams.ProgressLines(told.append)
    spark.streams.addListener(listener)
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    rows.writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(50):
        if told and "done" in told[-1]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    events = [json.loads(x) for x in told]
    assert events[0]["event"] == "started" and events[-1]["event"] == "done" and sum(e.get("rows", 0) for e in events) == 5
