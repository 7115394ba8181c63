"""Ed25519 after RFC 8032, and its check as a column of Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
Point = tuple[int, int, int, int]


def _sha(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _add(a: Point, b: Point) -> Point:
    e = (a[1] - a[0]) * (b[1] - b[0]) % P
    f = (a[1] + a[0]) * (b[1] + b[0]) % P
    g = 2 * a[3] * b[3] * D % P
    h = 2 * a[2] * b[2] % P
    w, x, y, z = f - e, h - g, h + g, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a = _add(a, a)
        n >>= 1
    return out


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * ROOT % P
    if x * x % P != square or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


_BASE_Y = 4 * pow(5, -1, P) % P
BASE: Point = (_x_of(_BASE_Y, 0), _BASE_Y, 1, _x_of(_BASE_Y, 0) * _BASE_Y % P)


def _packed(a: Point) -> bytes:
    inverse = pow(a[2], -1, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpacked(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    x = _x_of(y & (1 << 255) - 1, y >> 255)
    return None if x is None else (x, y & (1 << 255) - 1, 1, x * (y & (1 << 255) - 1) % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    own = _packed(_times(a, BASE))
    r = _sha(prefix, message) % Q
    point = _packed(_times(r, BASE))
    return point + ((r + _sha(point, own, message) * a) % Q).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpacked(key), _unpacked(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    left, right = _times(s, BASE), _add(r, _times(_sha(signature[:32], key, message) % Q, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


@F.pandas_udf(BooleanType())
def verified(key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether each signature holds; a null anywhere does not."""
    rows = zip(key, message, signature, strict=True)
    return pd.Series([None not in row and verify(*map(bytes, row)) for row in rows], dtype=bool)
