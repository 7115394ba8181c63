import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ed25519
from quillgraph.functions.embed import hashing
from quillgraph.operators import assertions, corpus
from quillgraph.sources import conversations
from quillgraph.sources.blocks import BlockSource
from quillgraph.sources.files import Snapshots


def test_ed25519_vectors():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(seed, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed25519.verify(ed25519.public_key(seed), b"", signature) and not ed25519.verify(ed25519.public_key(seed), b"x", signature)


NODE = "id string, author string, plane string, trust_tier string, status string, valid_from long, valid_to long, observed_at long, signature binary"
EDGE = "from_id string, to_id string, kind string, quarantined boolean, author string, signature binary"


def test_signed_diffs(spark):
    seeds = {w: assertions.writer_seed(b"g", w) for w in ("me", "you")}
    keys = spark.createDataFrame([(w, bytearray(ed25519.public_key(s))) for w, s in seeds.items()], "author string, key binary")
    a, b, c = ("aa" * 32, "bb" * 32, "cc" * 32)

    def row(i, who, tier="AgentAsserted", at=5):
        return (i, who, "Asserted", tier, "Active", at, None, at, bytearray(assertions.sign_id(seeds[who], i)))

    stored = spark.createDataFrame([row(a, "you")], NODE)
    links = spark.createDataFrame([], EDGE)
    fresh = assertions.check_nodes(spark.createDataFrame([row(b, "me"), row(c, "me", "DerivedDeterministic"), (*row(a, "me")[:8], bytearray(64))], NODE), keys)
    assert {r["id"]: r["ok"] for r in fresh.collect()} == {b: True, c: False, a: False}

    def edge(kind, quarantined):
        key = bytes.fromhex(b) + bytes.fromhex(a) + bytes([{"Supersedes": 3, "References": 13}[kind]])
        return (b, a, kind, quarantined, "me", bytearray(ed25519.sign(seeds["me"], key)))

    good = assertions.check_edges(spark.createDataFrame([edge("References", False), edge("Supersedes", True)], EDGE), keys)
    judged = assertions.judge_diff(stored, links, fresh.where(F.col("id") == b), good, "me", 10)
    nodes, edges = assertions.apply_diff(stored, links, judged)
    assert nodes.count() == 2 and edges.where("quarantined").count() == 1
    bad = assertions.check_edges(spark.createDataFrame([edge("Supersedes", False)], EDGE), keys)
    judged = assertions.judge_diff(stored, links, fresh, bad, "me", 3)
    assert {r["reason"] for r in judged[0].collect()} == {"signature", "time"} and judged[1].first()["reason"] == "needs a second party"
    with pytest.raises(ValueError, match="refused"):
        assertions.apply_diff(stored, links, judged)


def test_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("r", "adrs/a.md", "s", "---\ntitle: X\ncreated: 2024-01-01\nstatus: archived\n---\n# Head\ntext\n```agentile\nsupersedes: old\nref: R\n```\n")], "repo string, path string, git_sha string, text string")
    nodes, edges = corpus.document_graph(docs)
    row = nodes.first()
    assert (row["kind"], row["title"], row["status"], row["created_ms"]) == ("adr", "Head", "Archived", 1704067200000)
    assert sorted((r["kind"], r["target"], r["quarantined"]) for r in edges.collect()) == [("References", "R", False), ("Supersedes", "old", True)]
    built, links = corpus.build(docs, 60)
    assert built.count() == links.count() + 1 and links.join(built, links["to_id"] == built["id"]).count() == links.count()
    assert sorted(r["id"] for r in built.collect()) == sorted(r["id"] for r in corpus.build(docs, 60)[0].collect())
    full = built.selectExpr("id", "author", "'Derived' plane", "'DerivedDeterministic' trust_tier", "'Active' status", "cast(null as binary) signature")
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert corpus.import_tenant(store, "r", "d1", full, links) and not corpus.import_tenant(store, "r", "d1", full, links)
    with pytest.raises(ValueError, match="plain"):
        corpus.import_tenant(store, "r", "d2", full.withColumn("author", F.lit("x")), links)


def test_block_source(spark, tmp_path):
    path = tmp_path / "b.json"
    block = lambda n: {"number": hex(n), "hash": f"h{n}", "parentHash": f"h{n - 1}", "transactions": []}
    path.write_text(json.dumps({"results": [block(2), block(1)]}))
    spark.dataSource.register(BlockSource)
    assert [r["number"] for r in spark.read.format("blocks").option("path", str(path)).load().collect()] == [1, 2]
    seen = []
    for more in ([1, 2], [1, 2, 3]):
        path.write_text(json.dumps({"results": [block(n) for n in more]}))
        stream = spark.readStream.format("blocks").option("path", str(path)).load()
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(r["number"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [1, 2, 3]


def test_conversations(spark):
    schema = "id string, owner string, org string, updated_at long"
    df = spark.createDataFrame([("1", "me", "o", 1), ("2", "me", "o", 2), ("3", "you", "o", 3)], schema)
    assert [r["id"] for r in conversations.listed(df, "me", "o").collect()] == ["2", "1"]
    out = conversations.upsert(df, spark.createDataFrame([("1", "me", "o", 9), ("3", "me", "o", 9), ("4", "me", "o", 9)], schema))
    assert {r["id"]: (r["owner"], r["updated_at"]) for r in out.collect()} == {"1": ("me", 9), "2": ("me", 2), "3": ("you", 3), "4": ("me", 9)}
    assert conversations.without(df, "3", "me", "o").count() == 3 and conversations.without(df, "1", "me", "o").count() == 2


def test_hashing_embedder(spark):
    from quillgraph.functions import vectors

    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in hashing(16).apply(df, "id", "text").collect()}
    assert got[1]["model"] == "hashing-v1-d16" and not any(got[2]["data"])
    cells = {r["bucket"]: r["weight"] for r in vectors.hash_embedding(df, "id", "text", 16).collect()}
    assert np.allclose([cells.get(i, 0.0) for i in range(16)], got[1]["data"], atol=1e-6)


def test_embedding_for_a_write(spark):
    from quillgraph.functions.embed import Embedder

    def load():
        def fn(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no such word")
            return [[float(len(t)), np.nan if t == "odd" else 1.0] for t in texts]

        return fn

    df = spark.createDataFrame([(1, "ab"), (2, "a bad one"), (3, "odd"), (4, None)], "id int, text string").coalesce(1)
    got = {r["id"]: (r["embedding"] and list(r["embedding"]["data"]), r["warning"]) for r in Embedder("m", 2, load).for_write(df, "id", "text").collect()}
    assert got == {1: ([2.0, 1.0], None), 2: (None, "ValueError: no such word"), 3: (None, "m gave a vector that is not finite"), 4: ([0.0, 1.0], None)}

    def broken():
        raise OSError("no weights")

    assert {r["warning"] for r in Embedder("m", 2, broken).for_write(df, "id", "text").collect()} == {"OSError: no weights"}
    assert all("3 dimensions" in r["warning"] for r in Embedder("m", 3, load).for_write(df.where("id = 1"), "id", "text").collect())
    assert hashing(4).for_write(df, "id", "text").where("warning is not null or embedding is null").count() == 0


def test_vectors_of_other_weights_are_not_reused(spark):
    from quillgraph.operators import ingest

    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    stored = spark.createDataFrame([("a", "m", [1.0], "w1"), ("b", "m", [1.0], "w0"), ("c", "m", [1.0, 2.0], "w1")], "id string, model string, data array<float>, weights string")
    reused, rest = ingest.embed_split(nodes, stored, "m", 1, "w1")
    assert [r["id"] for r in reused.collect()] == ["a"] and sorted(r["id"] for r in rest.collect()) == ["b", "c"]
    assert ingest.embed_split(nodes, stored, "m", 1)[0].count() == 2
