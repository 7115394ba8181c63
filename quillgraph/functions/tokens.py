"""Checks of bearer tokens in three dot-joined base64url parts (JWT): RS256 and HS256, issuer, audience and times.

The algorithm is the verifier's choice, by the key that it holds, and never the token's: a token that names another one is
refused, and so is one without a signature.  Tokens are parsed and their claims judged in the JVM; only signatures need Python,
a batch at a time: HMAC, or a modular power of the signature and a comparison with the whole padded digest.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands before a SHA-256 digest in a padded RSA signature (DER of its algorithm).
SHA256_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")
CLAIMS = "iss string, sub string, aud string, exp double, nbf double, org string"


def _decoded(part: Column) -> Column:
    """Bytes of unpadded base64url; null if it is none."""
    plain = F.translate(part, "-_", "+/")
    fine = part.rlike("^[A-Za-z0-9_-]*$") & (F.length(part) % 4 != 1)
    return F.when(fine, F.unbase64(F.rpad(plain, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))))


def rsa_ok(n: int, e: int, message: bytes, signature: bytes) -> bool:
    """Whether a PKCS#1 v1.5 signature over SHA-256 holds: the whole padded block must be what it should be."""
    size = (n.bit_length() + 7) // 8
    if len(signature) != size or int.from_bytes(signature, "big") >= n:
        return False
    digest = SHA256_PREFIX + hashlib.sha256(message).digest()
    if size < len(digest) + 11:
        return False
    block = pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big")
    return hmac.compare_digest(block, b"\x00\x01" + b"\xff" * (size - len(digest) - 3) + b"\x00" + digest)


def _signed(tokens: DataFrame, keys: dict[str, dict]) -> DataFrame:
    """tokens with `_signed`: whether the key of `_kid` (or the only key) signed `_message`."""

    def run(batches):
        for b in batches:
            out = []
            for kid, message, signature in zip(b["_kid"].to_pylist(), b["_message"].to_pylist(), b["_signature"].to_pylist(), strict=True):
                key = keys.get(kid) if kid is not None else next(iter(keys.values())) if len(keys) == 1 else None
                if key is None or message is None or not signature:
                    out.append(None if key is None else False)
                elif key["alg"] == "HS256":
                    out.append(hmac.compare_digest(hmac.new(key["secret"], message.encode(), hashlib.sha256).digest(), signature))
                else:
                    out.append(rsa_ok(key["n"], key["e"], message.encode(), signature))
            yield b.append_column("_signed", pa.array(out, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{kinds}, _signed boolean")


def verify(tokens: DataFrame, keys: dict[str, dict], issuer: str, audience: str, now: int, leeway: int = 60) -> DataFrame:
    """tokens (id, token) with `verdict` (ok, or what is wrong first), and sub and org of those that are ok.

    keys by their kid: {"alg": "RS256", "n": .., "e": ..} or {"alg": "HS256", "secret": ..}; a token without a kid is checked by
    the only key, if there is just one.  Reasons in order: malformed, algorithm, key, signature, issuer, audience, expired,
    not yet.  A token must expire; times are in seconds, with a leeway.
    """
    part = F.split("token", r"\.")
    parsed = tokens.select("id", "token", part.alias("_p")).where("true")
    three = F.size("_p") == 3
    head = F.from_json(F.decode(_decoded(F.col("_p")[0]), "UTF-8"), "alg string, kid string")
    body = F.decode(_decoded(F.col("_p")[1]), "UTF-8")
    # An audience may be one string or an array of them.
    parsed = parsed.withColumns({"_h": F.when(three, head), "_b": F.when(three, body)})
    parsed = parsed.withColumns({"_c": F.from_json("_b", CLAIMS), "_all": F.from_json(F.get_json_object("_b", "$.aud"), "array<string>"), "_kid": F.col("_h.kid"), "_message": F.when(three, F.concat_ws(".", F.col("_p")[0], F.col("_p")[1])), "_signature": F.when(three, _decoded(F.col("_p")[2]))})
    algorithms = {k: v["alg"] for k, v in keys.items()}
    only = next(iter(algorithms.values())) if len(algorithms) == 1 else None
    wanted = F.lit(None).cast("string")
    for kid, alg in algorithms.items():
        wanted = F.when(F.col("_kid") == kid, alg).otherwise(wanted)
    wanted = F.when(F.col("_kid").isNull(), F.lit(only)).otherwise(wanted)
    parsed = parsed.withColumn("_alg", wanted)
    checked = _signed(parsed.select("id", "_kid", "_message", "_signature", "_alg", F.col("_h.alg").alias("_named"), "_c", "_all", (F.col("_h").isNotNull() & F.col("_c").isNotNull() & F.col("_signature").isNotNull()).alias("_whole")), keys)
    ours = F.coalesce(F.array_contains("_all", audience), F.lit(False)) | F.col("_c.aud").eqNullSafe(F.lit(audience))
    verdict = (
        F.when(~F.coalesce("_whole", F.lit(False)), "malformed")
        .when(F.col("_alg").isNull(), "key")
        .when(~F.col("_named").eqNullSafe(F.col("_alg")), "algorithm")
        .when(~F.coalesce("_signed", F.lit(False)), "signature")
        .when(~F.col("_c.iss").eqNullSafe(F.lit(issuer)), "issuer")
        .when(~ours, "audience")
        .when(F.col("_c.exp").isNull() | (F.col("_c.exp") + leeway < now), "expired")
        .when(F.col("_c.nbf") - leeway > now, "not yet")
        .otherwise("ok")
    )
    out = checked.select("id", verdict.alias("verdict"), F.col("_c.sub").alias("sub"), F.col("_c.org").alias("org"))
    return out.select("id", "verdict", *[F.when(F.col("verdict") == "ok", F.col(c)).alias(c) for c in ("sub", "org")])
