import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.sources import delta, files, git
from quillgraph.streaming import streams


@pytest.fixture
def repo(tmp_path):
    def g(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    g("init", "-b", "main")
    (tmp_path / "a.md").write_text("# A\n")
    g("add", ".")
    g("commit", "-m", "first\n\nbody: x")
    g("checkout", "-b", "side")
    g("commit", "--allow-empty", "-m", "second")
    g("checkout", "main")
    return tmp_path


def test_git(spark, repo):
    root = str(repo)
    commits = git.read_commits(spark, root).collect()
    assert [c["subject"] for c in commits] == ["first"] and commits[0]["body"].strip() == "body: x" and commits[0]["parents"] == []
    assert [r["subject"] for r in git.read_commits(spark, root, "side", "main").collect()] == ["second"]
    assert git.default_branch(root) == "main" and [r["name"] for r in git.branches(spark, root).collect()] == ["side"]
    assert git.is_ancestor(root, "main", "side") and not git.is_ancestor(root, "side", "main") and git.commit_count(root, "side") == 2
    assert [r["path"] for r in git.markdown_files(spark, root).collect()] == ["a.md"]
    assert git.read_document(root, "a.md") == b"# A\n" and git.read_document(root, "../x") is None
    (repo / "link.md").symlink_to("a.md")
    assert git.read_document(root, "link.md") is None
    assert git.pin(root, ["a.md"]) == git.head(root)
    (repo / "a.md").write_text("# B\n")
    assert git.pin(root, ["a.md"]).endswith("-dirty")


def test_bad_commit_record(spark):
    with pytest.raises(Exception, match="bad commit record"):
        git.parse_records(spark.createDataFrame([("only\x1ftwo",)], "value string")).collect()


def test_manifests(spark):
    repos, deps = files.read_manifest(spark, '[repos.a]\ntier="1"\n[repos.b]\narchived=true\n[[drift]]\nconsumer="a"\ndep_repo="z"\n')
    assert sorted(r["name"] for r in repos.collect()) == ["a", "b"] and [r["name"] for r in files.live_repos(repos).collect()] == ["a"]
    assert [tuple(r) for r in deps.collect()] == [("a", "z")]
    assert files.read_lock('[x]\nverdict="approved"\n[y]\nverdict="pending"\n') == {"x": True, "y": False}
    with pytest.raises(ValueError, match="verdict"):
        files.read_lock('[x]\nverdict="odd"\n')
    assert files.read_spec('version=1\n[[source]]\nname="n"\ntenant="t"\npath="p"\n')[0]["name"] == "n"
    for bad in ('other=1', '[[source]]\nname="n"\ntenant="t"\npath="../p"\n', '[[source]]\nname="n"\nodd=1\n'):
        with pytest.raises(ValueError, match="key|path"):
            files.read_spec(bad)


def test_chain_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chainId": 5, "extra": 1, "contracts": {"B": "0xAB"}, "genesis": {"G": "0x01"}}))
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "c.json")).collect()] == [(5, "contracts", "B", "0xab"), (5, "genesis", "G", "0x01")]
    (tmp_path / "d.json").write_text(json.dumps({"chainId": 5, "contracts": {"B": {"no": 1}}}))
    with pytest.raises(Exception, match="no address"):
        files.read_catalog(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"number": "0x10", "hash": "h", "parentHash": "g", "timestamp": "0x5", "transactions": [{"hash": "t", "from": "0xA", "to": None, "value": "0x1"}]}]}))
    row = files.read_blocks(spark, str(tmp_path / "b.json")).first()
    assert (row["number"], row["at_ms"], row["transactions"][0]["to"]) == (16, 5000, None)


def test_walk_and_bundle(spark, tmp_path):
    (tmp_path / "w/sub").mkdir(parents=True)
    (tmp_path / "w/.git").mkdir()
    (tmp_path / "w/sub/a.txt").write_text("x")
    (tmp_path / "w/big").write_text("x" * 50)
    (tmp_path / "w/l").symlink_to("big")
    good, skipped = files.walk(spark, str(tmp_path / "w"), most=10)
    assert [r["path"] for r in good.collect()] == ["sub/a.txt"]
    assert sorted(map(tuple, skipped.collect())) == [(".git", "hidden"), ("big", "size"), ("l", "link")]
    nodes = spark.createDataFrame([("a" * 64, bytearray("é".encode()))], "id string, content binary")
    edges = spark.createDataFrame([("a" * 64, "zz", "k")], "from_id string, to_id string, kind string")
    files.write_bundle(nodes, edges, str(tmp_path / "out"))
    back, links = files.read_bundle(spark, str(tmp_path / "out"), "id string, content string", "from_id string, to_id string, kind string")
    assert bytes(back.first()["content"]).decode() == "é"
    with pytest.raises(Exception, match="to_id is no id"):
        links.collect()
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_bundle(nodes, edges, str(tmp_path / "out"))


def test_half_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, data array<float>")
    got = {r["id"]: r["data"] for r in files.decode_vectors(files.encode_vectors(df)).collect()}
    assert np.allclose(got[1], [0.6, 0.8], atol=1e-6) and got[2] == [0.0, 0.0]
    with pytest.raises(Exception, match="half floats"):
        files.encode_vectors(spark.createDataFrame([(1, [1e6])], "id long, data array<float>")).collect()


def test_webhook_and_digest():
    import hashlib
    import hmac

    body = json.dumps({"ref": "refs/heads/main", "after": "abc", "repository": {"name": "r", "owner": {"login": "me"}}}).encode()
    assert files.webhook_ok(b"s", body, "sha256=" + hmac.new(b"s", body, hashlib.sha256).hexdigest()) and not files.webhook_ok(b"s", body, "x")
    assert files.parse_push(body, {"me"})["head"] == "abc" and files.parse_push(body, {"you"}) is None
    assert files.manifest_digest({"a": 1, "digest": "x"}) == files.manifest_digest({"digest": "", "a": 1})


def test_snapshots(spark, tmp_path):
    store = files.Snapshots(spark, f"file://{tmp_path}/s")
    assert store.version("t") == 0
    for i in range(3):
        assert store.commit("t", spark.range(i + 1)) == i + 1
    assert store.read("t").count() == 3 and store.prune("t", 1) == [1, 2] and store.read("t").count() == 3
    # Rows without a marker, as a crash leaves them, do not count.
    spark.range(9).write.parquet(f"file://{tmp_path}/s/t/rows-of-a-crash")
    assert store.version("t") == 3 and store.commit("t", spark.range(5)) == 4 and store.read("t").count() == 5
    store.commit_all({"a": spark.range(1), "b": spark.range(2)})
    store.commit("a", spark.range(7))  # not in a manifest yet
    assert store.current("a", "id long").count() == 1 and store.current("b", "id long").count() == 2 and store.current("c", "id long").count() == 0


def test_snapshots_of_two_writers(spark, tmp_path, monkeypatch):
    """Both find version 1, both write; the second to place its marker fails, and the first one's rows stay."""
    one, two = (files.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.commit("t", spark.range(1))
    monkeypatch.setattr(two, "version", lambda name: 1)
    assert one.commit("t", spark.range(2)) == 2
    with pytest.raises(OSError, match="another writer"):
        two.commit("t", spark.range(9))
    assert one.read("t").count() == 2


def _store(spark, tmp_path):
    return delta.Store(spark, f"file://{tmp_path}/store", {"t": ["id"], "u": ["a", "b"]})


def test_delta_store(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v long")
    have = lambda n=None: sorted(map(tuple, store.read("t", number=n).collect()))
    assert store.read("t", "id string, v long").count() == 0 and store.state() == (0, {})
    assert store.commit({"t": rows(("a", 1), ("b", 2)), "u": spark.createDataFrame([(1, 2, "x")], "a int, b int, c string")}) == 1
    before = {p.name for p in (tmp_path / "store" / "u").iterdir()}
    assert store.commit({"t": rows(("b", 3), ("c", 4))}) == 2 and have() == [("a", 1), ("b", 3), ("c", 4)]
    assert {p.name for p in (tmp_path / "store" / "u").iterdir()} == before  # a table without a change keeps its files
    assert sum(r.count() for r in [spark.read.parquet(str(p)) for p in (tmp_path / "store" / "t").iterdir()]) == 4  # k rows wrote k rows
    store.commit({}, {"t": rows(("a", 0), ("z", 0))})
    assert have() == [("b", 3), ("c", 4)] and have(1) == [("a", 1), ("b", 2)]
    store.commit({"t": rows(("a", 9))})
    assert store.compact("t") and not store.compact("t") and have() == [("a", 9), ("b", 3), ("c", 4)] and store.read("u").count() == 1
    gone = store.vacuum()
    assert len(gone) == 4 and have() == [("a", 9), ("b", 3), ("c", 4)] and store.versions() == [5]
    (tmp_path / "store" / "manifests" / "00000006").write_text("")  # a writer that is at it, or has died
    assert have() == [("a", 9), ("b", 3), ("c", 4)]
    with pytest.raises(delta.Conflict):
        store.commit({"t": rows(("a", 10))})


def test_delta_store_of_two_writers(spark, tmp_path, monkeypatch):
    one, two = _store(spark, tmp_path), _store(spark, tmp_path)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v long")
    one.commit({"t": rows(("a", 1))})
    monkeypatch.setattr(two, "versions", lambda: [1])  # as if it had looked before the other wrote
    assert one.commit({"t": rows(("a", 2))}) == 2
    with pytest.raises(delta.Conflict):
        two.commit({"t": rows(("a", 99), ("b", 99))})
    assert sorted(map(tuple, one.read("t").collect())) == [("a", 2)]
    with pytest.raises(delta.Conflict, match="based on"):
        one.commit({"t": rows(("a", 3))}, based_on=1)


def _scanned(df):
    """Rows that the file scans of a query have read, as Spark's own metrics count them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_reads_prune(spark, tmp_path):
    import hashlib

    store = _store(spark, tmp_path)
    ids = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000))
    store.commit({"t": spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, v long")})
    assert store.compact("t", files=8)
    table = store.read("t")
    assert [tuple(r) for r in delta.by_key(table, "id", ids[77]).collect()] == [(ids[77], 77)]
    assert _scanned(delta.by_key(table, "id", ids[77])) < 1000 and _scanned(delta.by_key(table, "id", "zz")) == 0
    some = [x for x in ids if x.startswith("ab")]
    assert sorted(r["id"] for r in delta.by_prefix(table, "id", "ab").collect()) == some and _scanned(delta.by_prefix(table, "id", "ab")) < 1500
    assert delta.by_prefix(table, "id", "").count() == 4000
    odd = spark.createDataFrame([("a\U0010ffff",), ("a\U0010ffffb",), ("b",), ("\ud7ff",), ("\ue000",)], "id string")
    assert sorted(r["id"] for r in delta.by_prefix(odd, "id", "a\U0010ffff").collect()) == ["a\U0010ffff", "a\U0010ffffb"]
    assert [r["id"] for r in delta.by_prefix(odd, "id", "\ud7ff").collect()] == ["\ud7ff"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "seq long, repo string").coalesce(1).write.parquet(str(tmp_path / "q"))
    seen = []
    queue = spark.readStream.schema("seq long, repo string").parquet(str(tmp_path / "q"))
    streams.drain_queue(queue, seen.extend, str(tmp_path / "ck1")).awaitTermination()
    assert seen == ["b", "a"]
    tx = "array<struct<hash:string,`from`:string,`to`:string,value:string>>"
    schema = f"number long, hash string, parent_hash string, transactions {tx}"
    spark.createDataFrame([(1, "h1", "h0", [("t", "0xa", None, "0x0")])], schema).write.parquet(str(tmp_path / "b"))
    store = f"file://{tmp_path}/store"
    watched = spark.createDataFrame([("0xA",)], "address string")
    for more in ([], [(1, "h1b", "h0", [])]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "b"))
        streams.walk_blocks(spark.readStream.schema(schema).parquet(str(tmp_path / "b")), watched, store, str(tmp_path / "ck2")).awaitTermination()
    assert [r["tx"] for r in streams.walked(spark, store, "events").collect()] == ["t"]
    assert [tuple(r) for r in streams.walked(spark, store, "orphans").collect()] == [(1, "h1", "h1b")]
    assert [tuple(r) for r in streams.walked(spark, store, "checkpoints").collect()] == [(1, "h1b")]


def test_stream_token_bucket(spark, tmp_path):
    spark.createDataFrame([("u", 1, 0.0, 1.0), ("u", 2, 0.0, 1.0), ("u", 3, 9.0, 1.0)], "principal string, call_id long, ts double, cost double").coalesce(1).write.parquet(str(tmp_path / "c"))
    calls = spark.readStream.schema("principal string, call_id long, ts double, cost double").parquet(str(tmp_path / "c"))
    q = streams.token_bucket(calls, 1, 1).writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["call_id"]: r["allowed"] for r in spark.table("buckets").collect()} == {1: True, 2: False, 3: True}


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 01:30:00", "a", 2.0), ("2024-01-02 00:00:00", "b", 0.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = streams.windowed(events, "1 hour", "1 hour").writeStream.format("memory").queryName("wins").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["total"]) for r in spark.table("wins").collect()) == [(1, 2.0), (2, 2.0)]
