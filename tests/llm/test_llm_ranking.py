"""Ball trees, compression bands and impact search against plain versions."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quillgraph.llm import balltree, common, impacts, maxscore, quality
from quillgraph.llm.common import text_buffers

CLASH = "shard long, block long, row long, place int, _task long, id string"
CLASHING = (1, 2, 3, 4, 5, "x")


# ball tree -----------------------------------------------------------------------------------------------


def plain_negatives(rows, n_positives, n_negatives, least, every):
    """rows: (id, label, vector of whole numbers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (anchor, label, q) in enumerate(rows):
        if anchor % every:
            continue
        others = sorted(((-dot(q, v), i, other) for j, (i, other, v) in enumerate(rows) if j != k))
        for s, positive, _ in [x for x in others if x[2] == label][:n_positives]:
            fit = [x for x in others if x[2] != label and least * -s <= 100 * -x[0] <= 100 * -s]
            out += [(anchor, positive, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(fit[:n_negatives])]
    clamp = lambda x: max(-balltree.MOST, min(balltree.MOST, x))
    return sorted((*x[:4], clamp(x[4]), clamp(x[5])) for x in out)


def vectors(spark, rows, partitions=3):
    data = [(i, label, None if v is None else [None if x is None else float(x) for x in v], *CLASHING[:5]) for i, label, v in rows]
    return spark.createDataFrame(data, "vec_id long, label int, embedding array<double>, " + CLASH.rsplit(",", 1)[0]).repartition(partitions)


def mined(df, scale=1, every=5):
    fit = maxscore.quantise(df.where("label is not null"), "vec_id", "embedding", scale, "label")
    return sorted(map(tuple, balltree.hard_negatives(fit, F.col("id") % every == 0, 3, 4, 80).collect()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_hard_negatives(spark, monkeypatch, broadcast):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 64)
    monkeypatch.setattr(balltree, "BLOCK_ROWS", 8)
    monkeypatch.setattr(balltree, "HELD", 200)
    if not broadcast:
        monkeypatch.setattr(balltree, "meet", lambda *a: common.meet(*a, most=0))
    rng = np.random.default_rng(3)
    centres = rng.integers(-20, 20, (6, 5))
    rows = [(int(i), int(rng.integers(4)), [int(x) for x in centres[rng.integers(6)] + rng.integers(-4, 5, 5)]) for i in range(300)]
    rows += [(5, 1, [3, 3, 3, 3, 3]), (5, 1, [3, 3, 3, 3, 3]), (7, 2, [3, 3, 3, 3, 3]), (10, -3, [1, 2]), (-20, 3, []), (35, 1 << 30, [0, 0, 0, 0, 0])]
    bad = [(None, 1, [1, 2]), (15, None, [1, 2]), (15, 1, None), (20, 1, [1, None]), (20, 1, [1, math.nan]), (20, 1, [math.inf])]
    assert mined(vectors(spark, rows + bad)) == plain_negatives(rows, 3, 4, 80, 5)


def test_hard_negatives_of_large_components(spark):
    rows = [(i, i % 2, [(1 << 70) + (i << 20), -(i % 7) * (1 << 60)]) for i in range(30)] + [(30, 0, [1 << 80, 1]), (31, 1, [5, 5])]
    exact = [(i, label, [int(float(x)) for x in v]) for i, label, v in rows]
    assert mined(vectors(spark, rows)) == plain_negatives(exact, 3, 4, 80, 5)


def test_hard_negatives_of_nothing(spark):
    rows = [(5, 1, [1, 2]), (6, 2, [1, 1])]
    assert mined(vectors(spark, rows).where("false")) == []
    assert mined(vectors(spark, rows)) == []  # no positive
    assert mined(vectors(spark, rows), every=1000) == []
    assert mined(vectors(spark, [(5, 1, [1, 2]), (6, 1, [1, 1])])) == []  # no other label


def test_search_prunes_and_is_exact():
    """Far fewer leaves are scored than there are, and the result is that of scoring all."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (40, 8))
    x = np.repeat(centres, 100, 0) + rng.integers(-5, 6, (4000, 8))
    labels = rng.integers(0, 3, 4000)
    tree = balltree.BallTree.unpacked(balltree.BallTree.built(np.arange(4000), np.arange(4000), labels, x.astype(float)).packed())
    scored = []
    plain = tree.scores
    tree.scores = lambda node, q, fast: scored.append(node) or plain(node, q, fast)
    for row in (0, 777, 3999):
        q, all_ = x[row].astype(float), x @ x[row]
        for same, window in ((True, (-np.inf, np.inf)), (False, (int(all_.max()) // 2, int(all_.max()) * 9 // 10)), (False, (-200, 100))):
            scored.clear()
            found = [[]]
            tree.search(np.array([row]), labels[[row]], x[[row]].astype(float), same, np.array([[window[0]]]), np.array([[window[1]]]), [found], 5)
            fit = ((labels == labels[row]) == same) & (np.arange(4000) != row)
            fit &= (all_ >= window[0]) & (all_ <= window[1])
            assert found[0] == sorted((-int(all_[i]), i) for i in np.flatnonzero(fit))[:5]
            # A window about 0 lies within the bounds of most nodes.
            assert len(scored) < (tree.left < 0).sum() / (1 if window == (-200, 100) else 3)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (700, 12)).astype(float)
    tree = balltree.BallTree.built(np.arange(700), np.arange(700), np.zeros(700, np.int64), x)
    qs = rng.integers(-1000, 1000, (20, 12)).astype(float)
    least, most = tree.bounds(qs)
    for node in range(len(tree.start)):
        own = tree.vectors[tree.start[node] : tree.end[node]] @ qs.T
        assert (least[node] <= own.min(0)).all() and (own.max(0) <= most[node]).all()
    alike = balltree.BallTree.built(np.arange(500), np.arange(500), np.zeros(500, np.int64), np.ones((500, 3)))
    assert len(alike.start) == 1 and alike.radius[0] == 0


# compression bands ---------------------------------------------------------------------------------------

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def plain_verdict(text):
    """The bands once more, with fractions instead of whole numbers."""
    raw = (text or "").encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(x))

    def out(x):
        points = [b[0] for b in quality.BANDS]
        between = lambda k: int(np.floor(np.interp(len(x), points, [b[k] for b in quality.BANDS]) + 1e-9))
        return "repetitive" if size(x) * 1000 < between(1) * len(x) else "incompressible" if size(x) * 1000 > between(2) * len(x) else "kept"

    chunks = [out(raw[a : a + 1024]) for a in range(0, len(raw), 1024) if len(raw[a : a + 1024]) >= 512]
    verdict = out(raw)
    for side in ("repetitive", "incompressible"):
        if verdict == "kept" and chunks.count(side) * 2 > len(chunks):
            verdict = side
    return verdict


def odd_texts():
    rng = random.Random(4)
    prose = ["the", "house", "and", "river", "quiet", "morning", "under", "some", "old", "trees", "walked", "said", "nothing", "of", "a", "letter", "from", "her", "brother", "who", "had", "left"]
    say = lambda n: " ".join(rng.choice(prose) + rng.choice(["", "", "s", ","]) for _ in range(n))
    noise = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    some = [None, "", " \n", "x", "one two", "\n\n\n", say(19), say(20), say(300), say(5000), "word " * 400, "ab " * 40000, noise(60_000), " ".join(noise(9) for _ in range(800))]
    some += [say(150) + "\n" + "na " * 3000, say(400) + " ".join(noise(30) for _ in range(200)), (say(30) + "\n") * 5, "# | a\n# | a\n", "字 " * 30, "é\r\né\r\n é", "a b c d e f g h a b c d e f g h"]
    alphabet = ["a", "b", " ", "\n", "\n", "  ", "é", "字", "#", "a b c d e f g h i ", "\x0b", "\x1c", "　"]
    return some + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]


def test_counts():
    rng = random.Random(1)
    texts = odd_texts()
    for size in (0, 1, 2, 7, 40):
        some = [rng.choice(texts) for _ in range(size)]
        found = quality.counts(*text_buffers(pa.array(some, pa.string())))
        got = list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert got == [plain_counts(t) for t in some]


def test_compression_bands(spark, tmp_path):
    texts = odd_texts()
    rows = [(i, t, *CLASHING) for i, t in enumerate(texts)] + [(None, "x y", *CLASHING), (3, texts[9], *CLASHING), (3, texts[9], *CLASHING)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op12_compression_bands(spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in rows:
        counts, verdict = plain_counts(t), plain_verdict(t)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want.append((i, *counts, failed, not failed and verdict == "kept", verdict, len((t or "").encode())))
    assert sorted(map(repr, (tuple(r)[:10] for r in got))) == sorted(map(repr, want))
    verdicts = {r["doc_id"]: r["verdict"] for r in got}
    assert [verdicts[i] for i in (8, 9, 10, 11, 12, 13, 14)] == ["kept", "kept", "repetitive", "repetitive", "incompressible", "incompressible", "repetitive"]
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality.measure(df.where("false")).count() == 0 and quality.keep(df.where("false")).count() == 0


def test_limits_run_straight():
    for n in (1, 64, 65, 100, 511, 512, 700, 1024, 65535, 65536, 1 << 30):
        low, high = quality.limits(n)
        assert 0 < low < high and low % n == high % n == 0
    assert quality.limits(96)[0] == 96 * (400 + 280) // 2


# impact search -------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            scores += [(-s, i)] if s > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])] if item is not None else []
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_impact_search(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_BYTES", 300), ("SHARD_DOCS", 7), ("BLOCK_ITEMS", 3), ("BLOCK_BYTES", 200), ("HELD", 30)):
            monkeypatch.setattr(impacts, name, value)
        monkeypatch.setattr(impacts, "meet", lambda *a: common.meet(*a, most=0))
    rng = random.Random(2)
    words = ["a", "B", "c1", "É", "é", "字字", "the", "The", "x_y", "don't", "ß", "d\x00e", "f", "g", "h", " "]
    text = lambda n: rng.choice([" ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = [(i, text(30)) for i in range(150)] + [(3, "the a"), (3, "the a"), (None, "the a b"), (200, None), (201, ""), (202, " _- "), (203, "b " * 5000), (204, "rare"), (205, "rare")]
    items = [(i, text(6)) for i in range(20)] + [(4, "the f"), (4, "the f"), (None, "the"), (50, None), (51, ""), (52, "unknown"), (53, "RARE rare"), (54, " ".join(words * 40))]
    d = spark.createDataFrame([(*r, *CLASHING) for r in docs], f"doc_id long, text string, {CLASH}").repartition(3)
    q = spark.createDataFrame([(*r, *CLASHING) for r in items], f"item_id long, text string, {CLASH}").repartition(2)
    assert sorted(map(tuple, impacts.search(d, q, 5).collect())) == plain_ranking(docs, items, 5)
    for a, b in ((d.where("false"), q), (d, q.where("false")), (d.where("text is null"), q)):
        assert impacts.search(a, b, 5).count() == 0


def test_best_keeps_ties():
    scores = np.array([5, 7, 5, 5, 0, 5])
    ids = np.array([9, 8, 1, 4, 0, 2])
    assert [x.tolist() for x in impacts.best(ids, scores, 3)] == [[8, 1, 2], [7, 5, 5]]
    assert [x.tolist() for x in impacts.best(ids, scores, 9)] == [[8, 1, 2, 4, 9], [7, 5, 5, 5, 5]]


def test_impact_sql(spark, tmp_path):
    rows = [(1, "A a bé"), (2, "b c\x01d"), (3, None), (4, "x"), (None, "a"), (4, "x x"), (6, "a b c d"), (7, "q r s")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a X"), (2, "c d zzz"), (2, "c"), (None, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(duck.sql(impacts.OP13_SQL).fetchall()) == sorted(map(tuple, impacts.op13_impact_search(spark, str(tmp_path)).collect()))
