"""Block walks as a job and as a stateful stream over a re-org, and buckets whose state expires."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import access, ingest, jobs
from quillgraph.streaming import streams

BLOCK = "number long, hash string, parent_hash string, at_ms long, transactions array<struct<hash:string,`from`:string,`to`:string,value:string>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def block(n, fork="a", parent=None, txs=()):
    return (n, f"{fork}{n}", parent or f"{fork}{n - 1}", n * 1000, [(f"t{n}-{i}", a, z, "1") for i, (a, z) in enumerate(txs)])


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, old)


def test_walk_chain(spark, tmp_path):
    store = jobs.open_store(spark, f"file://{tmp_path}/store")
    watched = spark.createDataFrame([("0xAA",)], "address string")
    contracts = spark.createDataFrame([("0xaa", "c-a"), ("0xbb", "c-b"), ("0xcc", "c-c")], "address string, id string")
    walk = lambda now, rows, **more: jobs.walk_chain(store, spark.createDataFrame(rows, BLOCK), watched, contracts, 7, now, **more)
    first = [block(1), block(2, txs=[("0xaa", "0xBB"), ("0xcc", "0xbb")]), block(3)]
    assert walk(10, first) == {"blocks": 3, "events": 1, "reorgs": 0, "rejected": 0}
    kinds = lambda: sorted(r["kind"] for r in store.read("edges").collect())
    assert kinds() == ["Emits", "TemporalNext", "TemporalNext", "Touches", "Touches"]
    assert walk(11, first) == {"blocks": 0, "events": 0, "reorgs": 0, "rejected": 0}  # the cursor lies behind them
    assert store.read("meta").where("key = 'cursor'").first()["value"] == "4"
    assert walk(12, [block(3, "b", "a2"), block(4, "b"), block(5, "b", txs=[("0xdd", "0xaa")])], from_block=3) == {"blocks": 3, "events": 1, "reorgs": 1, "rejected": 0}
    status = {r["sha"].split("/")[-1]: r["status"] for r in store.read("nodes").where("kind = 'chain_checkpoint'").collect()}
    assert status == {"1@a1": "Active", "2@a2": "Active", "3@a3": "Superseded", "3@b3": "Active", "4@b4": "Active", "5@b5": "Active"}
    assert kinds().count("TemporalNext") == 5 and kinds().count("Supersedes") == 1 and kinds().count("Touches") == 3
    ids = {r["id"] for r in store.read("nodes").collect()}
    assert all(r["from_id"] in ids and (r["to_id"] in ids or r["to_id"].startswith("c-")) for r in store.read("edges").collect())


def run(query, name, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_walk_states_equal_a_batch_over_a_reorg(spark, tmp_path, rocks):
    one = [block(n) for n in range(1, 6)]
    two = [block(4, "b", "a3"), block(5, "b"), block(6, "b")]
    kinds = "chain long, number long, hash string, parent_hash string"
    source = tmp_path / "in"
    for k, rows in enumerate((one, two, two + [block(1, "c")])):
        spark.createDataFrame([(7, *r[:3]) for r in rows], kinds).coalesce(1).write.parquet(str(source / f"part={k}"))
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(str(source))
        run(streams.walk_states(stream, 4), "walk", tmp_path) if k == 0 else run(streams.walk_states(stream, 4), f"walk{k}", tmp_path)
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    run(streams.walk_states(stream, 4), "whole", tmp_path)
    got = spark.table("whole").collect()
    assert all(r["chain"] == 7 for r in got)
    as_blocks = lambda rows: spark.createDataFrame(rows, BLOCK)
    nobody = spark.createDataFrame([], "address string")
    stored = spark.createDataFrame([(r[0], r[1]) for r in one], "number long, hash string")
    batches = [ingest.block_walk(as_blocks(one), nobody, stored.where("false")), ingest.block_walk(as_blocks(two), nobody, stored)]
    spine = {(r["number"], r["hash"], r["before"]) for b in batches for r in b["spine"].collect()}
    orphans = {(r["number"], r["orphan"], r["by"]) for b in batches for r in b["orphans"].collect()}
    told = lambda what: {(r["number"], r["hash"], r["other"]) for r in got if r["what"] == what}
    assert told("spine") == spine and told("orphan") == orphans == {(4, "a4", "b4"), (5, "a5", "b5")}
    assert told("late") == {(1, "c1", None)}


def test_buckets_expire(spark, tmp_path, rocks):
    kinds = "principal string, call_id long, ts double, cost double"
    calls = [("u", 1, 50.0, 1.0), ("u", 2, 50.0, 1.0), ("u", 3, 50.0, 1.0), ("u", 4, 50.5, 1.0), ("v", 5, 51.0, 3.0)]
    # The last ones move the watermark on, far beyond what the others need to fill up.
    later = [("w", 6, 500.0, 1.0)], [("w", 7, 1000.0, 1.0)], [("w", 8, 1500.0, 1.0)]
    source = tmp_path / "calls"
    for k, rows in enumerate((calls, *later)):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(source / f"part={k}"))
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = run(streams.expiring_bucket(stream, 2, 2, "1 second"), "buckets", tmp_path)
    got = {r["call_id"]: r["allowed"] for r in spark.table("buckets").collect()}
    plain = {r["call_id"]: r["allowed"] for r in access.token_bucket(spark.createDataFrame(calls, kinds), 2, 2).collect()}
    assert {k: v for k, v in got.items() if k <= 5} == plain and all(got[k] for k in (6, 7, 8))
    rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 1 and rows[-1] < max(rows) or rows[-1] == 0
