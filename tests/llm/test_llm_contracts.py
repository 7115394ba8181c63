"""The registered op queries on the smallest tables: against SQL where there is some, else against plain versions."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillgraph.llm import jaccard, registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(order).collect()))) == sorted(map(repr, want.project(", ".join(order)).fetchall()))


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    at = 0
    got = {r["doc_id"]: r for r in registry.queries()["op1_token_files"](spark, str(DATA)).collect()}
    for i in sorted(texts):
        ids = whole.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, texts):
    import tiktoken

    from quillgraph.llm.bpe_tree import read_ranks

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    for r in registry.queries()["op6_bpe_tree"](spark, str(DATA)).collect():
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op7_held_out(spark, duck):
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in registry.queries()["op7_language_id"](spark, str(DATA)).collect() if r["held_out"]]
    assert len(rows) > 20 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_pipeline(spark, duck):
    """Stage by stage against plain versions on the whole of the smallest table."""
    from test_llm_operators import plain_components, plain_novel, plain_secrets

    from quillgraph.llm import langid, packing, secrets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = {r["doc_id"]: r for r in docs.collect()}
    known = corpus_pipeline.language(spark, docs, str(DATA)).collect()
    scorer = langid.Scorer(langid.fit(docs))
    assert sorted(r["doc_id"] for r in known) == [i for i in sorted(own) if not scorer.texts(pa.array([own[i]["text"]]))[2][0]]
    df = spark.createDataFrame(known, docs.schema)
    kept = corpus_pipeline.near_copies(spark, df, str(DATA)).collect()
    groups = plain_components([(r["doc_id"], r["text"]) for r in known], 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, _, c in groups if i == c)
    df = spark.createDataFrame(kept, docs.schema)
    clean = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, df, str(DATA)).collect()}
    names = secrets.identifiers(df)
    assert sorted(clean) == sorted(r["doc_id"] for r in kept)
    for r in kept:
        found = plain_secrets(r["text"]) or ",".join(plain_novel(r["text"], names))
        assert (clean[r["doc_id"]]["text"] != r["text"]) == bool(found) and clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", clean[r["doc_id"]]["text"])
    packed = corpus_pipeline.run(spark, str(DATA)).collect()
    texts, bins = {}, {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["text"]
        bins.setdefault(r["bin"], []).append(r)
    assert texts == {i: r["text"] for i, r in clean.items()}
    for members in bins.values():
        assert sum(r["n_words"] for r in members) <= packing.CAPACITY and all(r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in members)
        assert len({own[r["doc_id"]]["source"] for r in members}) == len(members)


def test_pipeline_stages_of_odd_tables(spark):
    """Nulls in all columns, repeated rows, columns with names that stages use, and no rows at all."""
    names = ["_lang", "_text", "_doc", "_place", "row", "piece", "cluster"]
    text = "the house and the river of a quiet morning under some old trees " * 3
    rows = [(1, text, "en", "s", 1, *names), (1, text, "en", "s", 1, *names), (2, text + "ends", None, None, None, *names), (None, None, None, None, None, *[None] * 7), (4, "", "en", "s", 0, *names)]
    rows += [(10 + i, f"{text} number {i} token = abcdef{i:06d} " + "word " * i, "en", f"s{i}", 5, *names) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    df = spark.createDataFrame(rows, schema).repartition(2)
    for docs in (df, df.where("false")):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert last.columns == ["doc_id", "piece", "n_words", "bin", "position", "text"]
        assert last.count() >= docs.count() and (docs.isEmpty() or not last.where("text like '%abcdef%'").count())


def test_keep_one_each_repeats(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x"), (3, "y"), (None, "z q"), (None, "z q"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, map(tuple, jaccard.keep_one_each(df).collect())))
    assert got == sorted(map(repr, [(1, "a b c d e f g"), (3, "x"), (3, "y"), (None, "z q"), (4, None), (5, "")]))


def test_keep_one_each_repeated_and_null_ids(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    near = [x + " end" for x in long]
    # Id 2 has a near copy of id 1's text and the head of another component; null ids near copies.
    rows = [(1, long[0]), (2, near[0]), (2, long[1]), (3, near[1]), (None, long[2]), (None, near[2]), (None, near[1])]
    got = sorted(map(repr, map(tuple, jaccard.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())))
    of_nulls = [repr((None, x)) for x in (long[2], near[2])]
    assert [x for x in got if x not in of_nulls] == sorted([repr((1, long[0])), repr((2, long[1]))])
    assert sum(x in of_nulls for x in got) == 1
    rows = [(9, long[0]), (9, near[0]), (9, near[0]), (None, long[0])]
    got = jaccard.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 1 and got[0]["doc_id"] == 9


def test_keep_one_each_clashing_columns(spark):
    names = ["_doc", "_own", "_place", "_id", "_of", "_stays", "_Bloom"]
    rows = [(1, "a b c d e f g", *names), (2, "a b c d e f g", *names), (3, "x", *names), (None, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = jaccard.keep_one_each(df)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[3]]))


def test_hot_shingles_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "CELL_BITS", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(80):
        words = list(base) if i % 2 else [f"u{i // 8}-{j}" for j in range(30 + i % 3)]
        words[int(rng.integers(len(words)))] = f"v{rng.integers(20)}"
        rows.append((i, " ".join(words)))
    from test_llm_operators import plain_components

    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80, 100).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows, 3, 80, 100)
