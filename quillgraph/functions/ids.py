"""Content ids: a hash over length-prefixed, tagged fields.  sha2 in the JVM is the default; BLAKE3 gives parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the domain that opens a node's id.
NODE_DOMAIN = "memory-node:v1"


def little_endian(n: Column, size: int) -> Column:
    """A whole number's bytes, least first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]))


def packed(node_id: Column) -> Column:
    """An id as bytes, for joins and groups: 64 hexadecimal digits as their 32 bytes, another text with 33 zero bytes after it.

    Different ids stay different, and equal ones equal; digests do not compress, so that this halves what is shuffled.
    """
    return F.when(node_id.rlike("^[0-9a-f]{64}$"), F.unhex(node_id)).otherwise(F.concat(F.encode(node_id, "UTF-8"), F.lit(bytearray(33))))


def unpacked(value: Column) -> Column:
    """The id that packed() made bytes of."""
    text = F.decode(F.substring(value, F.lit(1), F.octet_length(value) - 33), "UTF-8")
    return F.when(F.octet_length(value) == 32, F.lower(F.hex(value))).otherwise(text)


def field(tag: int, value: Column) -> Column:
    """tag, length as eight bytes, bytes."""
    return F.concat(F.unhex(F.lit(f"{tag:02x}")), little_endian(F.octet_length(value), 8), value)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def source_bytes(ref: Column) -> Column:
    """A source reference as `|`-joined text."""
    artifact = F.concat_ws("|", F.lit("artifact"), escape(ref["repo"]), escape(ref["path"]), escape(ref["git_sha"]), ref["byte_start"].cast("string"), ref["byte_end"].cast("string"))
    commit = F.concat_ws("|", F.lit("git_commit"), escape(ref["repo"]), escape(ref["sha"]))
    return F.when(ref["tag"] == "artifact", artifact).when(ref["tag"] == "git_commit", commit).otherwise(F.concat_ws("|", F.lit("dag_native"), escape(ref["key"])))


def node_preimage(plane: Column, kind: Column, repo: Column, author: Column, source: Column, content: Column, version: int = 1) -> Column:
    """Bytes whose hash is a node's id.  Times, tier, signature, embedding, confidence, anchors, status stay out."""
    text = lambda c: F.encode(c, "UTF-8")
    return F.concat(
        field(0, text(F.lit(NODE_DOMAIN))),
        field(1, F.unhex(F.lit(f"{version & 255:02x}{version >> 8:02x}"))),
        field(2, text(plane)),
        field(3, text(kind)),
        field(4, text(repo)),
        field(5, text(author)),
        field(6, text(source)),
        field(7, content),
    )


def sha2_id(preimage: Column) -> Column:
    return F.sha2(preimage, 256)


_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_MASK = 0xFFFFFFFF


def _compress(chain, block: bytes, counter: int, size: int, flags: int) -> list[int]:
    """The compression function of the published BLAKE3 paper."""
    words = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]
    for r in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for half, (x, y) in enumerate(((16, 12), (8, 7))):
                v[a] = (v[a] + v[b] + words[2 * k + half]) & _MASK
                v[d] ^= v[a]
                v[d] = (v[d] >> x | v[d] << (32 - x)) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                v[b] ^= v[c]
                v[b] = (v[b] >> y | v[b] << (32 - y)) & _MASK
        if r < 6:
            words = [words[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ chain[i] for i in range(8)]


def blake3(data: bytes) -> bytes:
    """32-byte BLAKE3 hash."""
    begin, end, parent, root = 1, 2, 4, 8

    def chunk(at: int, last_flag: int) -> list[int]:
        part = data[at * 1024 : (at + 1) * 1024]
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        chain = list(_IV)
        for i, b in enumerate(blocks):
            flags = (begin if i == 0 else 0) | (end | last_flag if i == len(blocks) - 1 else 0)
            out = _compress(chain, b.ljust(64, b"\0"), at, len(b), flags)
            chain = out[:8]
        return chain

    def tree(lo: int, hi: int, last_flag: int) -> list[int]:
        if hi - lo == 1:
            return chunk(lo, last_flag)
        left = 1 << ((hi - lo - 1).bit_length() - 1)
        both = tree(lo, lo + left, 0) + tree(lo + left, hi, 0)
        block = b"".join(w.to_bytes(4, "little") for w in both)
        return _compress(list(_IV), block, 0, 64, parent | last_flag)[:8]

    words = tree(0, max(1, -(-len(data) // 1024)), root)
    return b"".join(w.to_bytes(4, "little") for w in words)


def _compress_all(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The chaining values (n x 8) of n blocks at once: _compress with a column for each word."""
    n = len(chain)
    low, high = (counter & _MASK).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v = [*chain.T.copy(), *(np.full(n, x, np.uint32) for x in _IV[:4]), low, high, size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words.T.copy())
    for r in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for half, (x, y) in enumerate(((16, 12), (8, 7))):
                v[a] = v[a] + v[b] + m[2 * k + half]
                v[d] = v[d] ^ v[a]
                v[d] = v[d] >> np.uint32(x) | v[d] << np.uint32(32 - x)
                v[c] = v[c] + v[d]
                v[b] = v[b] ^ v[c]
                v[b] = v[b] >> np.uint32(y) | v[b] << np.uint32(32 - y)
        if r < 6:
            m = [m[i] for i in _ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], 1)


def blake3_all(messages: list[bytes]) -> list[bytes]:
    """32-byte BLAKE3 hashes of many messages: all their chunks a block at a time, then all their trees a level at a time.

    Neighbours are joined level by level and a last one without a neighbour moves up, which is the tree whose left sides are full.
    """
    begin, end, parent, root = 1, 2, 4, 8
    chunks = np.array([max(1, -(-len(x) // 1024)) for x in messages], np.int64)
    of = np.repeat(np.arange(len(messages)), chunks)
    place = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    raw = np.zeros((len(of), 1024), np.uint8)
    sizes = np.zeros(len(of), np.int64)
    for row, (i, k) in enumerate(zip(of.tolist(), place.tolist(), strict=True)):
        part = messages[i][k * 1024 : k * 1024 + 1024]
        raw[row, : len(part)] = np.frombuffer(part, np.uint8)
        sizes[row] = len(part)
    words, blocks = raw.view("<u4").astype(np.uint32), np.maximum(1, -(-sizes // 64))
    values = np.tile(np.array(_IV, np.uint32), (len(of), 1))
    for b in range(int(blocks.max(initial=0))):
        some = np.flatnonzero(blocks > b)
        last = blocks[some] == b + 1
        flags = (begin if b == 0 else 0) + np.where(last, end + np.where(chunks[of[some]] == 1, root, 0), 0)
        values[some] = _compress_all(values[some], words[some, 16 * b : 16 * b + 16], place[some], np.minimum(64, sizes[some] - 64 * b), flags)
    while len(of) > len(messages):
        count = np.bincount(of, minlength=len(messages))
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[of]))
        flags = parent + np.where(count[of[left]] == 2, root, 0)
        values[left] = _compress_all(np.tile(np.array(_IV, np.uint32), (len(left), 1)), np.concatenate([values[left], values[left + 1]], 1), np.zeros(len(left), np.int64), np.full(len(left), 64), flags)
        stays = place % 2 == 0
        values, of = values[stays], of[stays]
    return [x.tobytes() for x in values.astype("<u4")]


@F.pandas_udf(StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    known = [bytes(x) for x in data if x is not None]
    hashes, start = [], 0
    while start < len(known):  # some megabytes at a time
        stop, size = start, 0
        while stop < len(known) and (stop == start or size + len(known[stop]) + 1024 <= 4 << 20):
            size, stop = size + len(known[stop]) + 1024, stop + 1
        hashes += blake3_all(known[start:stop])
        start = stop
    found = iter(hashes)
    return pd.Series([None if x is None else next(found).hex() for x in data], index=data.index, dtype=object)
