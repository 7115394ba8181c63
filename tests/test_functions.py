import itertools
import random

from pyspark.sql import functions as F

from quillgraph.functions import ids, lattice, text, vectors
from quillgraph.functions.chunk import chunk_text, chunks


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row if len(columns) > 1 else row[0]


def test_lattice_laws(spark):
    rows = list(itertools.product(range(4), repeat=3))
    df = spark.createDataFrame(rows, "a int, b int, c int")
    j, m = lattice.join, lattice.meet
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    laws = (j(a, b) == j(b, a)) & (m(a, b) == m(b, a)) & (j(a, j(b, c)) == j(j(a, b), c)) & (m(a, m(b, c)) == m(m(a, b), c)) & (j(a, m(a, b)) == a) & (m(a, j(a, b)) == a) & (j(a, a) == a)
    assert df.where(~laws).count() == 0
    assert one(spark, x=lattice.join(F.lit(1), F.lit(2))) == lattice.BOTH
    assert one(spark, x=lattice.vector_join(F.array(F.lit(1)), F.array(F.lit(2), F.lit(2)))) == [3, 2]
    assert one(spark, x=lattice.contradicted(F.lit(None).cast("array<int>"))) is False


def test_blake3_vectors():
    assert ids.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert ids.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    data = bytes(i % 251 for i in range(2049))
    assert ids.blake3(data).hex() == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"


def test_node_identity(spark):
    ref = F.struct(F.lit("artifact").alias("tag"), F.lit("a|b").alias("repo"), F.lit("p\\q").alias("path"), F.lit("s").alias("git_sha"), F.lit(0).alias("byte_start"), F.lit(9).alias("byte_end"), F.lit("x").alias("sha"), F.lit("k").alias("key"))
    assert one(spark, x=ids.source_bytes(ref)) == "artifact|a\\|b|p\\\\q|s|0|9"
    made = ids.node_preimage(F.lit("derived"), F.lit("commit"), F.lit("r"), F.lit("é"), F.lit("s"), F.lit(bytearray(b"xy")))
    got = bytes(one(spark, x=made))

    def field(tag, value):
        return bytes([tag]) + len(value).to_bytes(8, "little") + value

    want = b"".join(field(i, v) for i, v in enumerate((b"memory-node:v1", b"\x01\x00", b"derived", b"commit", b"r", "é".encode(), b"s", b"xy")))
    assert got == want
    row = spark.range(1).select(made.alias("p")).select(ids.blake3_hex("p").alias("h"), ids.sha2_id(F.col("p")).alias("s")).first()
    assert row["h"] == ids.blake3(want).hex() and len(row["s"]) == 64


def test_frontmatter(spark):
    def parse(t):
        return one(spark, fm=text.frontmatter(F.lit(t)), body=text.body(F.lit(t)))

    assert tuple(parse("---\na: 1\nb:  x:y \na: 2\nplain\n: none\n---\nbody\n")) == ({"a": "2", "b": "x:y"}, "body\n")
    assert tuple(parse("---\r\na: 1\r\n---\r\nrest")) == ({"a": "1"}, "rest")
    assert tuple(parse("---\na: 1\nno end")) == ({}, "---\na: 1\nno end")
    assert tuple(parse("text\n---\na: 1\n---\n")) == ({}, "text\n---\na: 1\n---\n")
    assert tuple(parse("")) == ({}, "")


def test_iso_ms(spark):
    cases = {
        "2024-02-03": 1706918400000, " 2024-02-03T01:02:03Z ": 1706922123000, "2024-02-03 01:02": 1706922120000, "2024-02-03T01:02:03.9Z": 1706922123000, "2024-02-03T01:02:03+05:00": 1706922123000,
        "2024-02-31": 1709337600000, "2024-13-01": None, "2024-00-10": None, "2024-01-32": None, "2024-02-03T01:02:03-05:00": None, "2024-02-03T24:00": None, "x": None, "": None, "1969-12-31": None, "2024-02": None, "2024-02-03T": 1706918400000,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want long")
    assert df.where(~text.iso_ms(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


def test_trailers_and_blocks(spark):
    def pairs(c):
        return [tuple(x) for x in one(spark, x=c)]

    assert pairs(text.trailers(F.lit("subject\n\nnote: prose here\nreally\n\nAgentile-Implements: x: y\nSigned-off-by: z\n"))) == [("Agentile-Implements", "x: y"), ("Signed-off-by", "z")]
    assert pairs(text.trailers(F.lit("a: b\nnot a pair"))) == []
    assert pairs(text.trailers(F.lit("1a: b"))) == [] and pairs(text.trailers(F.lit(" \n\n "))) == []
    block = "x\n```agentile\nnode: claim\nimplements: S1\nbad line\n```\nafter: no\n~~~agentile\nref: R\n~~~"
    assert pairs(text.directive_blocks(F.lit(block))) == [("node", "claim"), ("implements", "S1"), ("ref", "R")]
    got = one(spark, a=text.trailer_kind(F.lit("AGENTILE-See-Also")), b=text.trailer_kind(F.lit("other")), c=text.directive_kind(F.lit("Depends-On")))
    assert tuple(got) == ("References", None, "DependsOn")


def test_documents(spark):
    none = F.create_map().cast("map<string,string>")

    def kind(path, body="", fm=none):
        return one(spark, x=text.classify(F.lit(path), fm, F.lit(body)))

    assert kind("x/ADR-1.md") == "adr" and kind("adrs/a.md") == "adr"
    assert kind("sprints/a.md") == "sprint:kickoff" and kind("sprints/RETRO.md") == "sprint:close"
    assert kind("a.md", fm=F.create_map(F.lit("sprint"), F.lit("1"), F.lit("status"), F.lit("archived"))) == "sprint:close"
    assert [kind(p) for p in ("journal/a.md", "essays/a.md", "case-studies/a.md", "x/handoff-2.md", "a.md")] == ["narrative:journal", "narrative:essay", "narrative:casestudy", "handoff", "doc"]
    assert kind("adrs/a.md", "```agentile\nnode: Claim\nclaim-status: Refined\n```") == "claim:refined"
    assert kind("adrs/a.md", "```agentile\nnode: claim\nclaim-status: odd\n```") == "adr"
    title = lambda p, fm, b: one(spark, x=text.doc_title(F.lit(p), fm, F.lit(b)))
    assert title("d/a.md", none, "x\n # T \n# U") == "T" and title("d/a.md", none, "##no\n# ") == "a"
    assert title("d/a.md", F.create_map(F.lit("sprint"), F.lit("S")), "") == "S"
    corpus = lambda p, fm, b: one(spark, x=text.corpus_title(F.lit(p), F.lit(fm).cast("string"), F.lit(b)))
    assert corpus("a.adoc", None, "```\n# no\n```\n= Yes") == "Yes" and corpus("x/a.b.md", ' "Q" ', "") == "Q" and corpus("x/a.b.md", None, "") == "a.b" and corpus(".env", None, "") == ".env"


def test_citations(spark):
    ref = F.struct(F.lit("artifact").alias("tag"), F.lit("r").alias("repo"), F.lit("p.md").alias("path"))
    assert one(spark, x=text.slug(F.lit(" Über: Das_Ding-2 (neu)! "))) == "über-das_ding-2-neu"
    assert one(spark, x=text.cite(ref, F.lit("T › A › B c\nx"))) == "r:p.md#b-c"
    assert one(spark, x=text.cite(ref, F.lit("plain"))) == "r:p.md" and one(spark, x=text.cite(ref, F.lit(""))) == "r:p.md"
    assert one(spark, x=text.logical_key(F.lit("a@b@c"))) == "a@b"
    assert tuple(one(spark, a=text.repo_relative(F.lit("/x/"), F.lit("y")), b=text.repo_relative(F.lit(""), F.lit("y")))) == ("x/y", "y")
    assert tuple(one(spark, a=text.safe_relative_path(F.lit("a/../b")), b=text.safe_relative_path(F.lit("a/..b")), c=text.safe_repo_name(F.lit("..")))) == (False, True, False)


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, x=vectors.cosine(a(1, 0), a(0, 0))) == 0.0
    assert abs(one(spark, x=vectors.cosine(a(1, 2), a(2, 4, 9))) - 10 / (5**0.5 * 101**0.5)) < 1e-9
    assert one(spark, x=vectors.normalise(a(0, 0))) == [0.0, 0.0]
    import struct

    values = [0.0, -0.0, 1.0, -1.5, 3.14159, 1e-40, -1e-45, 65504.0, 1e38, 2.0**-126]
    rng = random.Random(1)
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(200)]
    got = spark.createDataFrame([(values,)], "v array<float>").select(vectors.bit_patterns(F.col("v"))).first()[0]
    assert got == [struct.unpack("<I", struct.pack("<f", x))[0] for x in values]


def test_chunks(spark):
    doc = "intro\n\n# A\none\n```\n# not\n```\n== B ==\n" + "x" * 25 + "\n\n\n"
    got = chunk_text("T", doc, 12)
    assert [c[0] for c in got][:2] == ["T", "T › A"] and got[-1][0] == "T › B"
    for _, part, a, z in got:
        assert doc.encode()[a:z].decode().strip("\r\n") == part and len(part) <= 12
    assert "".join(c[1] for c in chunk_text("T", "é" * 30, 12)) == "é" * 30
    assert chunk_text("A", "# A\nx", 100) == [("A", "# A\nx", 0, 5)]
    rows = chunks(spark.createDataFrame([(1, "T", doc), (2, "T", None), (3, "T", "")], "k long, title string, text string"), "k", 12).collect()
    assert {r["k"] for r in rows} == {1} and len(rows) == len(got)


def test_many_blake3_hashes_at_once(spark):
    import random

    rng = random.Random(3)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4097, 5000, 8192, 9217, 40_000] + [rng.randrange(300) for _ in range(50)]
    some = [rng.randbytes(n) for n in sizes]
    assert ids.blake3_all(some) == [ids.blake3(x) for x in some] and ids.blake3_all([]) == []
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(some)] + [(99, None)], "i int, p binary")
    got = {r["i"]: r["h"] for r in df.select("i", ids.blake3_hex("p").alias("h")).collect()}
    assert got == {**{i: ids.blake3(x).hex() for i, x in enumerate(some)}, 99: None}


def test_packed_ids_tell_all_texts_apart(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 31, "", "branch:7", "é", "g" * 64, "0" * 64, "\0" * 32]
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "id string").withColumn("b", ids.packed(F.col("id")))
    rows = rows.withColumn("back", ids.unpacked(F.col("b"))).collect()
    assert all(r["id"] == r["back"] for r in rows)
    assert len({bytes(r["b"]) for r in rows if r["b"] is not None}) == len(texts) and len(rows[0]["b"]) == 32
