"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import math
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillgraph.llm import bpe_tree, extendible, jaccard, langid, maxscore, media, packing, pii, secrets, wavelet

tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "　", "!", "字", "word ", "x. ", "The, ", "ABC", "😀"]


def texts(n, seed=1, longest=40):
    rng = random.Random(seed)
    return [None, "", " ", "x" * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def docs(spark, rows, partitions=3):
    """documents with columns whose names clash with those that operators use."""
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 7) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, n long"
    return spark.createDataFrame(data, schema).repartition(partitions)


def numbered(values):
    return list(enumerate(values))


# wavelet matrix ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 90, n).astype(np.uint16)
    file = wavelet.ShardFile(wavelet.pack(np.array([4]), np.array([0, n]), ids, 16))
    matrix = file.matrix()
    assert (matrix.decode() == ids).all() and file.doc_ids().tolist() == [4]
    if n:
        assert (matrix.access(np.arange(n)) == ids).all()
    for token in (0, 1, 89, 90, 65536, -1):
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where)
        assert [matrix.select(token, j) for j in range(len(where))] == where.tolist()
        with pytest.raises(IndexError):
            matrix.select(token, len(where))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = numbered([*texts(150), "İstanbul H̱ello. KELVINK <|endoftext|> a.b, c.,", "a<|startoftext|>b <|ENDOFTEXT|>"])
    rows += [(3, "again."), (3, "again.")]
    files = wavelet.shard_table(docs(spark, rows), path, shard_bytes=2000).cache()
    assert files.count() > 3
    got = sorted(map(tuple, wavelet.read_documents(files).collect()), key=lambda r: (r[1], r[0]))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [1])
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        mine = [x for x in ids[doc_id] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc]
        assert mine
        ids[doc_id].remove(mine[0])
        at += n
    assert not any(ids.values())
    wavelet.export_files(files, str(tmp_path))
    assert len(list(tmp_path.glob("*.wvm"))) == files.count()
    assert wavelet.read_documents(wavelet.shard_table(docs(spark, [(1, "x")]).where("false"), path)).count() == 0


def test_token_files_of_special_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    values = ["one <|endoftext|> two", "One<|startoftext|>Two.", "<|ENDOFTEXT|> a,", "x<|endoftext|><|endoftext|>y.", "é<|endoftext|>É", "<|endoftext| >", "plain Words, again."]
    docs(spark, numbered(values)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in wavelet.op1_token_files(spark, str(tmp_path)).collect()}
    for i, t in numbered(values):
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t


# MaxScore ------------------------------------------------------------------------------------------------


def plain_top(rows, k):
    """Rows (id, vector): each row with id % 100 = 0 asks all other rows; in Python's integers."""
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(fine):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for other, (i, w) in enumerate(fine) if other != at)[:k]
            want += [(q, r + 1, i, max(-maxscore.MOST, min(maxscore.MOST, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(want)


def test_maxscore(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 1024]) for i in range(500)]
    rows += [(7, rows[7][1]), (900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[0][1]), (904, []), (200, rows[100][1]), (200, rows[100][1])]
    far = [(1000, [3e38] * 8), (1001, [-3e38, 1.0]), (1002, [3e38, 2.0]), (1100, [1e6, 0.0]), (1101, [1.0, 2.0]), (1003, [3.2e38])]
    for some in (rows, rows + far):
        df = spark.createDataFrame([(*r, 1, 2) for r in some], "vec_id long, embedding array<float>, rank int, row int").repartition(3)
        table = maxscore.quantise(df, "vec_id", "embedding", 1024)
        got = sorted(map(tuple, maxscore.top_k(table, F.col("id") % 100 == 0, 5).collect()))
        assert got == plain_top(some, 5)
    assert maxscore.top_k(table.where("false"), F.col("id") % 100 == 0, 5).count() == 0
    assert maxscore.top_k(table, F.lit(False), 5).count() == 0


def test_maxscore_of_large_components(spark, tmp_path):
    spark.createDataFrame([(100, [1e6, 0.0]), (101, [1.0, 2.0]), (102, [1e6, 1e6])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, maxscore.op2_maxscore(spark, str(tmp_path)).collect()))
    assert got == [(100, 1, 102, 1_048_576_000_000_000_000), (100, 2, 101, 1_048_576_000_000)]
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(duck.sql(maxscore.OP2_SQL).fetchall()) == got


@pytest.mark.parametrize("kind", [np.int64, object])
def test_maxscore_shards_prune_exactly(kind):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (400, 16))
    vectors[:, 8:] //= 25
    shard = maxscore.Shard(np.arange(400), np.arange(400), vectors.astype(kind))
    for q in rng.integers(-50, 50, (20, 16)):
        scores = vectors @ q
        order = np.lexsort((np.arange(400), -scores))[:7]
        for floor in (None, int(scores[order[-1]])):
            ids, got = shard.top(-1, q.astype(kind), 7, floor)
            assert ids.tolist() == order.tolist() and got.tolist() == scores[order].tolist()


# extendible hashing --------------------------------------------------------------------------------------


def test_extendible_hashing(spark):
    rows = numbered(texts(300, longest=20)) + [(5, "same")] * 40 + [(None, "z" * 500)]
    df = docs(spark, rows)
    limit = 400
    coded = df.select(F.col("doc_id").alias("id"), extendible.hash_bits(F.col("doc_id"), F.col("text")).alias("bits"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("bytes"))
    got = extendible.assign(coded, limit).collect()
    assert len(got) == len(rows)
    word = lambda x: int(hashlib.md5(str("" if x is None else x).encode()).hexdigest()[:8], 16)
    own = [((word(i) >> 1) << 32 | word(t), len((t or "").encode()) + 16, i) for i, t in rows]
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    for shard, members in by_shard.items():
        assert sum(r["bytes"] for r in members) == members[0]["shard_bytes"] and len(members) == members[0]["shard_rows"], shard
        assert members[0]["shard_bytes"] <= limit or len(members) == 1 and members[0]["oversize"]
    for bits, _, i in own:
        for depth in range(64):
            size = sum(b for x, b, _ in own if x >> (63 - depth) == bits >> (63 - depth))
            if size <= limit:
                assert f"{depth}:{bits >> (63 - depth)}" in {r["shard"] for r in got if r["id"] == i}
                break
    assert extendible.assign(coded.where("false"), limit).count() == 0


def test_shards_on_disk(spark, tmp_path):
    rows = numbered(texts(100, longest=20)) + [(5, "same")] * 40 + [(None, "z" * 500), (None, None)]
    df = docs(spark, rows).withColumn("shard", F.lit("own"))
    back = extendible.write_shards(df, "doc_id", "text", 400, f"{tmp_path}/shards", 16)
    assert back.columns == [*df.columns, "_shard"]
    got = back.collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["shard"]) for r in got) == sorted((str(i), str(t), "own") for i, t in rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["_shard"], []).append(len((r["text"] or "").encode()) + 16)
    assert len(sizes) > 5 and all(sum(x) <= 400 or len(x) == 1 for x in sizes.values())
    files = [p.name for p in (tmp_path / "shards").glob("*.parquet")]
    assert len(files) == 1
    few = extendible.write_shards(df, "doc_id", "text", 400, f"{tmp_path}/few", 16, 2000)
    listed = extendible.shard_files(few, "_shard").collect()
    total = sum(sum(x) for x in sizes.values())
    assert {r["shard"]: r["rows"] for r in listed} == {k: len(x) for k, x in sizes.items()} and len(listed) == len(sizes)
    assert 1 < len({r["file"] for r in listed}) <= -(-total // 2000)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, got))


# n-gram Jaccard join -------------------------------------------------------------------------------------


def plain_components(rows, k, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(at)
        for i, a in enumerate(sets):
            for j in range(i):
                same = len(a & sets[j])
                if a and sets[j] and at[i] != at[j] and same * den >= num * (len(a) + len(sets[j]) - same):
                    at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
        if before == at:
            break
    least = {}
    for (i, _), c in zip(rows, at, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(c)) for (i, _), s, c in zip(rows, sets, at, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_components(spark, k, num, den):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    rows = [None, "", " \n", "one", "ONE", "one two", "one\x1ftwo"]
    passage = [rng.choice(words) for _ in range(20)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(2, 60))] + passage * rng.randint(0, 1)
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows = numbered(rows) + [(9, rows[9]), (9, rows[20]), (None, rows[9]), (None, "alone " * 4)]
    got = jaccard.components(docs(spark, rows), k, num, den).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows, k, num, den)


def test_jaccard_large_lists_and_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(40)] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    got = jaccard.components(docs(spark, rows), 3, 90, 100).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows, 3, 90, 100)
    assert jaccard.components(docs(spark, rows).where("false"), 3, 90, 100).count() == 0


# packing -------------------------------------------------------------------------------------------------


def plain_best_fit(items, capacity):
    bins, out = [], []
    for n, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


def test_packing(spark):
    rng = random.Random(2)
    items = sorted(((rng.randint(0, 50), rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(30)])) for _ in range(400)), key=lambda x: -x[0])
    assert packing.best_fit(items, 50) == plain_best_fit(items, 50)
    rows = numbered(["w " * rng.randint(0, 90) for _ in range(200)] + [None, "", "w " * 100, "w " * 250]) + [(3, "w w"), (3, "w w"), (None, "w")]
    got = packing.pack(packing.lengths(docs(spark, rows)), 50, 64).collect()
    total, bins = {}, {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_words"]
        bins.setdefault(r["bin"], []).append(r)
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert total == want
    text_of = {i: t for i, t in rows if i not in (3, None)}
    for members in bins.values():
        members = sorted(members, key=lambda r: (r["position"], r["n_words"]))
        assert sum(r["n_words"] for r in members) <= 50
        assert all(a["position"] + a["n_words"] == b["position"] for a, b in zip(members, members[1:], strict=False))
        known = [r["doc_id"] for r in members if r["doc_id"] in text_of]
        assert len({i % 3 for i in known}) == len(known)
        copies = [text_of[i] for i in known if text_of[i] is not None]
        assert len(set(copies)) == len(copies)
    assert packing.pack(packing.lengths(docs(spark, rows).where("false"))).count() == 0


def test_packing_fits_best_in_each_group(spark):
    rng = random.Random(3)
    rows = numbered(["w " * rng.randint(0, 70) for _ in range(300)])
    got = packing.pack(packing.lengths(docs(spark, rows)), 50, 10_000).where("n_words < 50").collect()
    items = sorted(((len(t.split()) % 50, i, len(t.split()) // 50, f"s{i % 3}", t) for i, t in rows if len(t.split()) % 50 or not t.split()), key=lambda x: (-x[0], x[1]))
    bins = plain_best_fit([(n, source, t) for n, _, _, source, t in items], 50)
    assert sorted((r["doc_id"], r["piece"], r["bin"], r["position"]) for r in got) == sorted((i, piece, f"0.0:{b}", at) for (_, i, piece, _, _), (b, at) in zip(items, bins, strict=True))


def test_packing_of_one_hot_id_and_its_texts(spark):
    rows = [(5, "w w w")] * 300 + [(None, f"x{i} y") for i in range(300)] + [(7, "a  b\nc " * 40 + "d")]
    got = packing.pack(packing.lengths(docs(spark, rows)), 50, 16)
    assert got.where("doc_id = 5").count() == 300 and got.where("doc_id is null").count() == 300
    assert got.where("doc_id = 5").select(F.split("bin", ":")[0].alias("g")).groupBy("g").count().agg(F.max("count")).first()[0] <= 64
    assert got.where("doc_id = 5").select("bin").distinct().count() == 300
    packed = packing.pack_texts(docs(spark, [*rows, (8, None), (9, "")]), 50, 16).collect()
    whole = sorted((r["piece"], r["text"]) for r in packed if r["doc_id"] == 7)
    assert "".join(t for _, t in whole) == rows[-1][1] and [len(t.split()) for _, t in whole] == [50, 50, 21]
    assert [(r["n_words"], r["text"]) for r in packed if r["doc_id"] == 8] == [(0, None)]
    assert sorted(r["text"] for r in packed if r["doc_id"] is None) == sorted(t for i, t in rows if i is None)
    assert all(r["n_words"] == len((r["text"] or "").split()) for r in packed)
    assert packing.pack_texts(docs(spark, rows).where("false")).count() == 0


# BPE tree ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_bpe_tree(leaf):
    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe_tree.read_ranks(f.read())
    plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe_tree.TreeCodec(ranks, tokenizers.PATTERN, leaf)
    for t in [x or "" for x in texts(400, seed=leaf)] + ["ab1! " * 400, " " * 300, "é" * 500]:
        ids = codec.encode(t)
        assert ids == plain.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_documents(spark):
    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(f.read()), special_tokens={})
    rows = numbered(texts(50)) + [(2, " "), (None, "x")]
    got = bpe_tree.encode_documents(docs(spark, rows), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep_ids=True).collect()
    want = sorted((str(i), plain.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in got) == want
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got)


# language ID ---------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    model = langid.KneserNey({"x": {"ab": 3, "abc": 2, "b": 1}, "y": {"cc": 2, "ac": 1}}, order=3)
    for prefix in ("", "a", "ab", "abc", "cc", "zz"):
        total = np.zeros(2)
        for c in ["a", "b", "c", None]:
            word = prefix + (c or "")
            cost, _ = model.bits([word])
            before, _ = model.bits([prefix + "a"])
            hashes, at, _ = langid._grams([word], 3)
            assert len(at) == len(word) + 2
            p = np.ones(2)
            if c is None:
                p = np.exp2(-(cost[0] - _prefix_bits(model, prefix)))
            else:
                p = np.exp2(-(_prefix_bits(model, word) - _prefix_bits(model, prefix)))
            total += p
        assert np.allclose(total, 1, atol=1e-3)


def _prefix_bits(model, word):
    """Bits of a word's letters without its end mark."""
    hashes, at, owner = langid._grams([word], model.order)
    p = np.full((len(at), len(model.languages)), 1.0 / model.symbols)
    for n, (keys, probability, contexts, weights) in enumerate(model.tables, 1):
        for i in np.flatnonzero(at >= max(1, n - 1)):
            context = hashes[n - 1][i - 1] if n > 1 else np.uint64(0)
            p[i] = langid._lookup(keys, probability, hashes[n][i : i + 1], 0.0)[0] + langid._lookup(contexts, weights, np.array([context]), 1.0)[0] * p[i]
    return -np.log2(p[(at >= 1) & (at <= len(word))]).sum(0)


def plain_kneser_ney(counts, order, symbols):
    """A function from a word to its bits: interpolated Kneser-Ney by dictionaries, one language."""
    tokens = {w: ["<", *w, ">"] for w in counts}
    raw = [{} for _ in range(order + 2)]
    for w, n in counts.items():
        t = tokens[w]
        for k in range(1, order + 2):
            for i in range(max(1, k - 1), len(t)):
                g = tuple(t[i - k + 1 : i + 1])
                raw[k][g] = raw[k].get(g, 0) + n
    use = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in raw[k].items():
            lefts = sum(1 for h in raw[k + 1] if h[1:] == g)
            use[k][g] = n if k == order or g[0] == "<" else lefts
    discount = []
    for k in range(order + 1):
        ones, twos = (sum(1 for x in use[k].values() if x == y) for y in (1, 2))
        discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(g):
        if not g:
            return 1 / symbols
        k, lower = len(g), p(g[1:])
        same = [n for h, n in use[k].items() if h[:-1] == g[:-1]]
        if not same:
            return lower
        own = use[k].get(g, 0)
        return max(own - discount[k], 0) / sum(same) + sum(min(n, discount[k]) for n in same) / sum(same) * lower

    def bits(word):
        t = ["<", *word, ">"]
        return -sum(math.log2(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))

    return bits


def test_kneser_ney_against_a_plain_model():
    rng = random.Random(9)
    words = {k: {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): rng.randint(1, 4) for _ in range(40)} for k, letters in (("x", "abcd"), ("y", "cdefü"))}
    for order in (2, 3, 5):
        model = langid.KneserNey(words, order)
        plain = [plain_kneser_ney(words[k], order, model.symbols) for k in ("x", "y")]
        tried = [*list(words["x"])[:10], *list(words["y"])[:10], "a", "zz", "abcdabcd", "üü"]
        cost, n = model.bits(tried)
        assert n.tolist() == [len(w) + 1 for w in tried]
        assert np.allclose(cost, [[f(w) for f in plain] for w in tried], rtol=1e-4)


def test_language_sample(spark, monkeypatch):
    """No language is left out, repeated rows count once, rows of one id with other texts are rows of their own."""
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 12)
    monkeypatch.setattr(langid, "FEW", 3)
    rows = [(f"{i}", f"word{i} of {k}", k) for k in "abcdef" for i in range(40)] + [("1", "same text", "g")] * 500 + [("1", f"text {i}", "h") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    got = langid.sample(df).collect()
    n = {k: sum(r["lang"] == k for r in got) for k in "abcdefgh"}
    assert n == {**dict.fromkeys("abcdef", 3), "g": 1, "h": 3} and len({tuple(r) for r in got}) == len(got)
    monkeypatch.setattr(langid, "LANGUAGES", 128)
    monkeypatch.setattr(langid, "LANGUAGE_BYTES", 60)
    n = [r["lang"] for r in langid.sample(df).collect()]
    assert 3 <= n.count("a") < 12 and n.count("g") == 1 and sorted(set(n)) == list("abcdefgh")
    assert langid.sample(df.where("false")).count() == 0 and langid.sample(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_language_columns_may_clash(spark):
    rows = [(i, ["the and er ing", "sch ein ung der"][i % 2] * 5, ["en", "de"][i % 2], "mine", "mine", "mine", True) for i in range(60)] + [(60, None, None, "mine", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _lang string, _score string, _rejected boolean")
    kept = langid.keep_known(df, langid.fit(df))
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:60])


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ein", "ung", "ü"], "fr": ["eau", "que", "é", "oi"]}
    rows = []
    for i in range(600):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text, lang))
    rows += [(600, None, "en"), (601, "", None), (602, "12 !?", "fr"), (603, "qxz wvkj " * 50, None), (604, "üungsch ein", None), (None, "the and", "en"), (1, rows[1][1], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).repartition(3)
    got = langid.predict(df, langid.fit(df)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, lang in rows[:600]:
        r = by_id[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["lang_pred"] == lang and 0 <= r["score"] <= 1 and not r["rejected"]
    assert [by_id[i]["lang_pred"] for i in (600, 601, 602)] == ["und"] * 3
    assert by_id[603]["rejected"] and by_id[603]["lang_pred"] in syllables
    assert by_id[604]["lang_pred"] == "de"
    kept = langid.keep_known(df, langid.fit(df))
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    empty = df.where("false")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df.limit(5), langid.fit(empty)).collect()} == {"und"}


# PII -----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    def passes(kind, x):
        digits = [int(c) for c in re.sub("[^0-9]", "", x)]
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            twice = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return ",".join(x for _, _, x in sorted(found))


def test_pii(spark):
    rng = random.Random(6)
    parts = ["1", "2", "0", "4465758382889437", " ", "-", ".", "@", "a", "b.c", "x@y.z", "_", "+", "(", "1.2.3.4", "256.1.1.1", "é", "😀", "\n", "+1 (743) 555-3824", "00012.3.4.5", "%", "DE89370400440532013000"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    values += [None, "", "+" * 20000 + "1" * 20000, "1 " * 20000, "a." * 20000 + "@", "7" * 50000]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs(spark, numbered(values)))).collect()}
    for i, t in numbered(values):
        want = plain_pii(t)
        assert ",".join(x for x in got[i]["spans"].split(",") if not x.startswith("iban")) == want
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_email"] == want.count("email")
    rows = [(0, "my IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01"), (0, "call +1 743 555 3824"), (1, "+1 743 555 3824")]
    found = sorted((r["doc_id"], r["spans"], r["scores"]) for r in pii.digest(pii.find(docs(spark, rows))).collect())
    assert found == [(0, "iban:8:35", "1.00"), (0, "phone:5:20", "0.80"), (1, "phone:0:15", "0.50")]
    assert pii.find(docs(spark, rows).where("false")).count() == 0


# media ---------------------------------------------------------------------------------------------------


def test_netpbm_and_bmp():
    import struct

    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # note\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P6\n7 5 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3\n7 5 255\n" + " ".join(map(str, colour.ravel())).encode()) == colour).all()
    assert (media.decode(b"P5\n7 5 65535\n" + grey.astype(">u2").tobytes()) == grey).all()
    bits = grey > 127
    assert (media.decode(b"P4\n7 5\n" + np.packbits(~bits, axis=1).tobytes()) == bits * 255).all()
    assert (media.decode(b"P1\n7 5\n" + "".join(map(str, (~bits).astype(int).ravel())).encode()) == bits * 255).all()
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-21 % 4) for r in colour[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == colour).all()
    for bad in (None, b"", b"P5", b"P5\n0 0\n255\n", b"P5\n7 5\n255\nxx", b"BM123", bmp[:-5], b"GIF89a"):
        assert media.decode(bad) is None


def test_area_resize():
    rng = np.random.default_rng(2)
    plane = rng.random((6, 10)) * 255
    assert np.allclose(media.area_resize(plane, 3, 5), plane.reshape(3, 2, 5, 2).mean((1, 3)))
    up = media.area_resize(plane, 7, 9)
    assert np.isclose(up.mean(), plane.mean())
    assert np.allclose(media.area_resize(plane, 12, 20), plane.repeat(2, 0).repeat(2, 1))


def plain_resize(plane, height, width):
    """Means by the overlap of every cell with every sample, weight by weight."""

    def weights(n, m):
        return np.array([[max(0.0, min((k + 1) * n / m, i + 1) - max(k * n / m, i)) for i in range(n)] for k in range(m)])

    rows, columns = weights(plane.shape[0], height), weights(plane.shape[1], width)
    return rows @ plane.astype(float) @ columns.T / ((plane.shape[0] / height) * (plane.shape[1] / width))


def test_text_media(spark, tmp_path):
    import io

    rows = numbered([*texts(60), "word " * 1000]) + [(1, "é" * 288), (1, "é" * 289), (2, "twin"), (3, "twin"), (None, "twin")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, media.op9_media(spark, str(tmp_path)).collect()), key=str)
    want, forms = [], set()
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        plane = np.frombuffer(full, np.uint8).reshape(-1, 24)
        form = media.encode_pgm(plane) if len(full) // 576 % 2 else media.encode_bmp(plane)
        forms.add(form[:2])
        assert (media.grey(media.decode(form)) == plane).all()
        small = plain_resize(plane, 8, 9).round(6)
        dhash = f"{int(''.join('01'[int(a > b)] for r in small for a, b in zip(r[:-1], r[1:], strict=True)), 2):016x}"
        tile = io.BytesIO()
        np.save(tile, np.clip(np.rint(plain_resize(plane, 16, 16).round(6)), 0, 255).astype(np.uint8))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(form), hashlib.sha256(form).hexdigest(), f"{dhash}:{zlib.crc32(tile.getvalue()):08x}", len(tile.getvalue())))
    assert got == sorted(want, key=str) and forms == {b"P5", b"BM"}
    images = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.arange(100, dtype=np.uint8).reshape(10, 10)))), (2, None), (3, bytearray(b"no"))], "tile long, img binary")
    tiles = {r["_tile"]: r for r in media.image_tiles(images, "tile", "img").collect()}
    assert tiles[1]["height"] == 10 and tiles[2]["dhash"] is None and tiles[3]["tile"] is None
    assert np.load(io.BytesIO(tiles[1]["tile"])).shape == (16, 16)
    assert media.media_tiles(media.text_media(docs(spark, rows).where("false"))).count() == 0


def test_ibans_before_other_words(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    made = "QX{:02} AB12 3456 7890 12"  # of no country: any length that is right
    made = next(x for x in map(made.format, range(98)) if int("".join(str(int(c, 36)) for c in (x[4:] + x[:4]).replace(" ", ""))) % 97 == 1)
    texts = [
        ("DE89370400440532013000 EUR 500", ["DE89370400440532013000"]),
        ("pay DE89370400440532013000 2024", ["DE89370400440532013000"]),
        (f"{de} BIC", [de]), (f"{de} {gb} {de}", [de, gb, de]), (f"DE00 1234 {gb} X", [gb]), (f"é😀 QX12 {de}", [de]),
        (f"{made} BIC CODE", [made]), (de + "1", []), (de + "a", []), ("x" + de, []), ("DE89  3704 0044 0532 0130 00", []),
        ("DE89 3704 0044 0532 0130 01 BIC", []), ("D E89 3704 0044 0532 0130 00", []), (" ".join(de.replace(" ", "")[4:]).join(["DE89 ", " Z"]), ["DE89 " + " ".join(de.replace(" ", "")[4:])]),
    ]
    for r in pii.digest(pii.find(docs(spark, [(i, t) for i, (t, _) in enumerate(texts)]))).collect():
        text, want = texts[r["doc_id"]]
        spans = [x.split(":") for x in r["spans"].split(",") if x.startswith("iban")]
        assert [text[int(a) : int(z)] for _, a, z in spans] == want and r["n_iban"] == len(want), text


# secrets -------------------------------------------------------------------------------------------------


def plain_secrets(text):
    name = "(?:" + "|".join("".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[1]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(x for _, _, x in sorted(found))


def test_secrets(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x", "ſecret", "Zx81kQpL09aMmNq7Rt"]
    values = [None, "", "=" * 5000, "token" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = {r["doc_id"]: r for r in secrets.scan(docs(spark, numbered(values))).collect()}
    for i, t in numbered(values):
        want = plain_secrets(t)
        assert ",".join(x for x in got[i]["spans"].split(",") if not x.startswith("novel")) == want, t
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_secret_novelty_and_redaction(spark):
    novel = "the auth header: Bearer Zx81kQpL09aMmNq7RtYw"
    words = "authorization of authorization_token_value_1 and authorization_token_value_1 again"
    plain = secrets.Novelty()
    assert [s[1] for s in secrets.find(novel, plain)] == [3] and not secrets.find(words, plain)
    assert [s[:3] for s in secrets.find("Zx81kQpL09aMmNq7RtYw is the auth key", plain)] == [(0, 3, 20)]
    assert not secrets.find("Zx81kQpL09aMmNq7RtYw is here" + " " * 40 + "the key", plain)
    rows = [(0, 'token = "11acdfb36bb72224148e" end'), (1, novel), (2, words), (3, None), (4, ""), (4, "a" * 5 + "0123456789abcdef0123456789")]
    out = secrets.redact(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in out.collect())
    assert got[0] == (0, 'token = "[secret]" end', 22)
    assert got[1] == (1, "the auth header: Bearer [secret]", 32) and got[2][1] == words
    assert got[3] == (3, "", None) and [x[1] for x in got[4:]] == ["", "[secret]"]
    assert secrets.redact(docs(spark, rows).where("false")).count() == 0


def test_secrets_anywhere_near_a_word(spark):
    rng = random.Random(11)
    for gap in range(1, 60):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(39)) + "7"
        text = "the key" + ":" + " " * (gap - 1) + key + " and so on."
        start = 7 + gap
        assert [x[:4] for x in secrets.find(text, secrets.Novelty())] == ([(start, 3, start + 40, start)] if gap <= secrets.NEAR else []), gap
    key = "q8Zx81kQpL09aMmNq7RtYwV3bT5cX2nD"
    parts = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiI0ODIxOTM3NTYwIiwibmFtZSI6IlF1aWxsIn0", "k3", "TJVA95OrM7E2cBab30RMHrHDcEfxjoYZgeFONFh7HgQ"]
    rows = [(0, f"key for the production server is: {key}"), (1, "Authorization: Bearer " + ".".join(parts) + " ok"), (2, f"a {parts[1]}.{parts[3]}")]
    got = sorted((r["doc_id"], r["text"]) for r in secrets.redact(docs(spark, rows)).collect())
    assert got[0][1] == "key for the production server is: [secret]"
    assert got[1][1] == "Authorization: Bearer [secret].[secret].k3.[secret] ok" and got[2][1] == rows[2][1]


def test_secrets_repeated_and_long(spark):
    key = "q8Zx81kQpL09aMmNq7RtYwV3bT5cX2nDs6Jh4Gf1"
    line = f"the auth header of the server: {key} is kept here. "
    for gap in ("", "and some other words stand between them. " * 5, "x y " * 63):  # in full, and cut by the edge
        text = line + gap + line
        assert [text[a:z] for a, _, z, _, _ in secrets.find(text, secrets.Novelty())] == [key, key], gap
    assert secrets.redact(docs(spark, [(0, line * 3)])).first()["text"] == line.replace(key, "[secret]") * 3
    rng, plain = random.Random(12), secrets.Novelty()
    words = ["the", "house", "river", "and", "letter", "of", "morning", "garden", "under", "people", "a", "window", "some", "quiet", "they"]
    for alphabet in ("0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"):
        for n in (256, 512, 1024, 4096):
            hits = 0
            for _ in range(20):
                before = " ".join(rng.choice(words) for _ in range(60)) + " the key: "
                x = "".join(rng.choice(alphabet) for _ in range(n))
                hits += (len(before), 3, len(before) + n, len(before)) in [y[:4] for y in secrets.find(f"{before}{x} {' '.join(rng.choice(words) for _ in range(60))}", plain)]
            assert hits >= 19, (alphabet, n, hits)
    for joiner in ("_", "-"):
        long = joiner.join(rng.choice(words) for _ in range(200)) + "17"
        assert not secrets.find("the key: " + long, plain)


def plain_added(text, start, end, first, last, names):
    """What text[start:end] adds to its surroundings: two whole compressions, each by a compressor of its own."""

    def size(x):
        words = zstandard.ZstdCompressionDict(f"{names} {secrets.COMMON}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False).compress(x.encode()))

    x = text[start:end]
    left = text[max(0, first - 256 - len(x)) : first].replace(x, " " * len(x))[-256:]
    right = text[last : last + 256 + len(x)].replace(x, " " * len(x))[:256]
    return size(left + right + x) - size(left + right)


def plain_novel(text, names):
    """Every run against every sensitive word and every base span."""
    text = text or ""
    base = [tuple(map(int, x.split(":")[1:])) for x in plain_secrets(text).split(",") if x]
    words = [m.span() for m in re.finditer("(?i:passw|pwd|secret|token|api|key|auth|bearer|credential|private|signature)", text)]
    out, taken = [], set()
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        start, end = m.span()
        if start in taken:
            continue
        if not any(0 <= start - z <= 40 or 0 <= a - end <= 40 for a, z in words):
            inside = [z for a, z in words if start <= a and z + 16 <= end]
            first_inside = [z for a, z in words if start <= a and z <= end]
            if not inside or min(first_inside) != min(inside):
                continue
            start = min(inside)
        rest = re.match(r"(?:\.[A-Za-z0-9+/_=-]+)*", text[end:])[0]
        parts = [(start, end)]
        for x in rest.split(".")[1:]:
            parts.append((parts[-1][1] + 1, parts[-1][1] + 1 + len(x)))
            taken.add(parts[-1][0])
        for a, z in parts:
            x = text[a:z]
            if z - a >= 16 and not any(p < z and a < q for p, q in base) and re.search("[0-9]", x) and re.search("[A-Za-z]", x):
                if plain_added(text, a, z, start, parts[-1][1], names) >= secrets.needed_bytes(x):
                    out.append(f"novel:{a}:{z}")
    return out


def test_novel_spans_and_added_bytes_against_a_plain_version(spark):
    rng = random.Random(21)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    parts = ["the ", "key ", "token", ": ", " = ", ".", "session_store_value", "retry_count = ", "load_settings(", ") ", "private ", "AKIA" + key(16).upper(), "0123456789abcdef01234567 ", "é ", "\n", "words of prose that stand between here and there "]
    values = [None, ""] + ["".join(rng.choice([*parts, key(20), key(44), key(18) + " "]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = docs(spark, numbered(values))
    names = secrets.identifiers(df)
    counts = {}
    for t in values:
        for x in {m[0] for m in re.finditer(r"""\b(?:[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]{3,}(?=["']? *(?:=|\()))\b""", t or "")}:
            counts[x] = counts.get(x, 0) + 1
    assert names.split()[::-1] == [x for x in sorted(counts, key=lambda x: (-counts[x], x)) if len(x) <= 32][: secrets.DICTIONARY_WORDS]
    assert {"session_store_value", "load_settings", "retry_count"} <= set(names.split())
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    total = 0
    for i, t in numbered(values):
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        novel = plain_novel(t, names)
        assert [x for x in spans if x.startswith("novel")] == novel, t
        assert len(spans) == len(got[i]["added"].split(",")) if spans else got[i]["added"] == ""
        total += len(novel)
    assert total > 100


def test_secrets_in_linear_time():
    line = 'token = "11acdfb36bb72224148e" and more words\n'
    start = time.perf_counter()
    assert len(secrets.find(line * 8000, secrets.Novelty())) == 8000
    assert time.perf_counter() - start < 8
