"""Table functions of SQL against the verbs, and checks of tokens."""

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillgraph import tablefunctions
from quillgraph.functions import tokens
from quillgraph.functions.chunk import chunks
from quillgraph.memory import MemoryGraph


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_chunks(spark):
    tablefunctions.register(spark)
    text = "intro\n\n# One\n" + "line of words\n" * 8 + "## Two\nmore\n"
    docs = spark.createDataFrame([(1, "T", text, "x"), (2, None, None, "y"), (3, "U", "é" * 100, "z")], "id long, title string, text string, chunk string")
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("select * from chunks(table(select * from some_docs), 40)")
    assert got.columns == ["id", "chunk", "breadcrumb", "text", "byte_start", "byte_end"] and got.schema["id"].dataType.simpleString() == "bigint"
    assert rows(got) == rows(chunks(docs.drop("chunk"), "id", 40)) and got.count() > 5
    for bad in ("chunks(table(select id from some_docs), 40)", "chunks(table(select * from some_docs), 0)"):
        with pytest.raises(Exception, match="chunks:"):
            spark.sql(f"select * from {bad}").collect()


def test_functions_of_the_graph(spark):
    kinds = "id string, repo string, kind string, plane string, author string, status string, valid_from long, valid_to long, trust_tier string, signature binary, confidence array<tinyint>, content binary"
    node = lambda i, repo="r", kind="doc", at=1, until=None: (i, repo, kind, "Derived", "a", "Active", at, until, "DerivedDeterministic", None, [1], bytearray(i.encode()))
    nodes = spark.createDataFrame([node("a1", at=5), node("a2", at=7, until=9), node("b", kind="branch"), node("c", "s")], kinds)
    edges = spark.createDataFrame([("a1", "a2", "References", False), ("c", "a1", "References", False), ("a1", "gone", "Refutes", True)], "from_id string, to_id string, kind string, quarantined boolean")
    for readable in (None, spark.createDataFrame([("r",)], "repo string")):
        g = MemoryGraph(nodes, edges, readable)
        tablefunctions.register(spark, g, "g_")
        ask = lambda x: spark.sql(f"select * from {x}")
        assert rows(ask("g_recall('r', 1)")) == rows(g.recall("r", 1)) and ask("g_recall('r', 9)").count() == 2
        assert [r["id"] for r in ask("g_as_of('r', 10, 5)").collect()] == [r["id"] for r in g.as_of("r", 10, 5).collect()] == ["a1"]
        want = g.neighbors("a1", 20)
        assert rows(ask("g_neighbors('a1', 20)").select(*want.columns)) == rows(want) and ask("g_neighbors('a1', 1)").count() == 1
        assert rows(ask("g_verify('a1')")) == rows(g.verify().where("id = 'a1'"))
        assert sorted(r["id"] for r in ask("g_resolve('a')").collect()) == ["a1", "a2"]
    each = spark.sql("select t.id, n.far_id from g_nodes t, lateral g_neighbors(t.id, 20) n where t.id in ('a1', 'a2')")
    assert sorted(map(tuple, each.collect())) == [("a1", "a2"), ("a1", "gone"), ("a2", "a1")]
    assert "TakeOrderedAndProject" in spark.sql("select * from g_recall('r', 3)")._jdf.queryExecution().toString()


def part(x) -> str:
    raw = x if isinstance(x, bytes) else json.dumps(x).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def test_public_vectors(spark):
    """RFC 7515, appendices A.1 (HS256) and A.2 (RS256): signed right, for another audience."""
    body = "eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ"
    one = f"eyJ0eXAiOiJKV1QiLA0KICJhbGciOiJIUzI1NiJ9.{body}.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    two = f"eyJhbGciOiJSUzI1NiJ9.{body}.cC4hiUPoj9Eetdgtv3hF80EGrhuB__dzERat0XF9g2VtQgr9PJbu3XOiZj5RZmh7AAuHIm4Bh-0Qc_lF5YKt_O8W2Fp5jujGbds9uJdbF9CUAr7t1dnZcAcQjbKBYNX4BAynRFdiuB--f_nZLgrnbyTyWzO75vRK5h6xBArLIARNPvkSjtQBMHlb1L07Qe7K0GarZRmB_eSN9383LcOLn6_dO--xi12jzDwusC-eOkHWEsqtFZESc6BfI7noOPqvhJ1phCnvWh6IeYI2w9QOYEUipUTI8np6LbgGY9Fs98rqVt5AXLIhWkWywlVmtVrBp0igcN_IoypGlUPQGe77Rw"
    unpad = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
    secret = unpad("AyM1SysPpbyDfgZld3umj1qzKObwVMkoqQ-EstJQLr_T-1qS0gZH75aKtMN3Yj0iPS4hcgUuTwjAzZr1Z9CAow")
    n = int.from_bytes(unpad("ofgWCuLjybRlzo0tZWJjNiuSfb4p4fAkd_wWJcyQoTbji9k0l8W26mPddxHmfHQp-Vaw-4qPCJrcS2mJPMEzP1Pt0Bm4d4QlL-yRT-SFd2lZS-pCgNMsD1W_YpRPEwOWvG6b32690r2jZ47soMZo9wGzjb_7OMg0LOL-bSf63kpaSHSXndS5z5rexMdbBYUsLA9e-KXBdQOS-UTo7WTBEMa2R2CapHg665xsmtdVMTBQY4uDZlxvb3qCo5ZwKh9kG4LT6_I5IhlJH7aGhyxXFvUK-DWNmoudF8NAco9_h9iaGNj8q2ethFkMLs91kzk2PAcDTW9gb54h4FRWyuXpoQ"), "big")
    for token, key in ((one, {"alg": "HS256", "secret": secret}), (two, {"alg": "RS256", "n": n, "e": 65537})):
        for t, want in ((token, "audience"), (token[:-6] + "AAAAAA", "signature")):
            assert tokens.verify(spark.createDataFrame([(1, t)], "id long, token string"), {"k": key}, "joe", "us", 1300819000).first()["verdict"] == want


def _prime(start: int) -> int:
    n = start | 1
    while any(pow(a, n - 1, n) != 1 for a in (2, 3, 5, 7, 11, 13)):
        n += 2
    return n


def test_tokens(spark):
    p, q = _prime(1 << 512 | 12345), _prime(1 << 511 | 987654321 << 300)
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8

    def rs(message: bytes) -> bytes:
        digest = tokens.SHA256_PREFIX + hashlib.sha256(message).digest()
        return pow(int.from_bytes(b"\x00\x01" + b"\xff" * (size - len(digest) - 3) + b"\x00" + digest, "big"), d, n).to_bytes(size, "big")

    hs = lambda message: hmac.new(b"secret", message, hashlib.sha256).digest()
    keys = {"r": {"alg": "RS256", "n": n, "e": e}, "h": {"alg": "HS256", "secret": b"secret"}}
    claims = {"iss": "me", "aud": "us", "sub": "s", "org": "o", "exp": 1000}

    def token(sign=rs, kid="r", alg="RS256", **more):
        body = {k: v for k, v in {**claims, **more}.items() if v is not None}
        message = f"{part({'alg': alg, 'kid': kid} if kid else {'alg': alg})}.{part(body)}"
        return f"{message}.{part(sign(message.encode()))}"

    good = token()
    cases = {
        good: "ok", token(hs, "h", "HS256"): "ok", token(aud=["x", "us"]): "ok", token(exp=950): "ok", token(nbf=1050): "ok",
        # A public key's bytes taken as an HMAC secret, no algorithm at all, a key of the other algorithm.
        token(lambda m: hmac.new(str(n).encode(), m, hashlib.sha256).digest(), "r", "HS256"): "algorithm", token(lambda m: b"", "r", "none"): "algorithm", token(hs, "h", "RS256"): "algorithm",
        token(lambda m: b"", "r"): "signature", token(lambda m: rs(m + b"x")): "signature", token(lambda m: rs(m)[:-1]): "signature", token(lambda m: (int.from_bytes(rs(m), "big") + n).to_bytes(size + 1, "big")): "signature",
        token(hs, "h", "HS256")[:-4] + "AAAA": "signature", token(kid="x"): "key", token(kid=None): "key", token(iss="you"): "issuer", token(iss=None): "issuer", token(aud="them"): "audience", token(aud=["x"]): "audience", token(aud=None): "audience",
        token(exp=900): "expired", token(exp=None): "expired", token(nbf=1100): "not yet", "a.b": "malformed", "": "malformed", good + ".x": "malformed", "!" + good: "malformed", "e30.e30.e30": "key",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "id long, token string").repartition(3)
    got = {r["id"]: r for r in tokens.verify(df, keys, "me", "us", 1000).collect()}
    assert [got[i]["verdict"] for i in range(len(cases))] == list(cases.values()) and got[99]["verdict"] == "malformed"
    assert (got[0]["sub"], got[0]["org"]) == ("s", "o") and got[8]["sub"] is None
    alone = tokens.verify(df.where("id = 0").select("id", F.lit(token(kid=None)).alias("token")), {"r": keys["r"]}, "me", "us", 1000).first()
    assert alone["verdict"] == "ok"
