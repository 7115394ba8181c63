"""Byte-level BPE encoding and decoding by a tree reduction over a monoid.

An element of the monoid is an encoded stretch of text: its string and its token ids.  A text longer than
a leaf is cut in the middle, both halves are encoded in the same way, and the two are joined: the tokens
next to the cut are taken off back to a place where the text provably splits alike in every context, and
what lies between two such places is encoded anew.  A place between a printable ASCII character and a
space or line feed is such a place for the pattern of public_tokenizers: no alternative matches a
non-space followed by white space, so every reading has a piece boundary there, and what follows it is read
without regard to what precedes it.  The window grows fourfold on a side until it reaches one or the end
of that half.  Decoding concatenates the bytes of two halves up the same tree.

A null or empty text has no tokens; ids_sha256 and decoded_sha256 are then those of the empty string.  A
repeated row is encoded again; an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import held, pieces, table

LEAF = 1024
_BREAK = re.compile(r"[!-~](?=[ \n])")


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file's bytes."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        self.encode_leaf = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = {i: t for t, i in ranks.items()}
        self.names = {i: str(i) for i in ranks.values()}
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, z: int) -> list[int]:
        if z - a <= self.leaf:
            return self.encode_leaf(text[a:z])
        mid = (a + z) // 2
        return self.join(text, a, mid, z, self._encode(text, a, mid), self._encode(text, mid, z))

    def join(self, text: str, a: int, mid: int, z: int, left: list[int], right: list[int]) -> list[int]:
        """ids of text[a:z] from those of text[a:mid] and text[mid:z]."""
        begin, end = self.stable_before(text, a, mid), self.stable_after(text, mid, z)
        keep = self.drop(left, len(text[begin:mid].encode()), -1)
        skip = self.drop(right, len(text[mid:end].encode()), 1)
        del left[keep:]
        if begin < end:
            left += self.encode_leaf(text[begin:end]) if end - begin < z - a or end - begin <= 4 * self.leaf else self.encode_leaf(text[a:z])
        left += right[skip:]
        return left

    @staticmethod
    def stable_before(text: str, a: int, mid: int) -> int:
        """The last provable boundary in (a, mid], or a; the cut itself counts only with what follows it."""
        width = 32
        while True:
            low = max(a, mid - width)
            at = -1
            for m in _BREAK.finditer(text, low, mid):
                at = m.end()
            if mid > low and text[mid - 1] > " " and text[mid - 1] <= "~" and text[mid : mid + 1] in (" ", "\n"):
                return mid
            if at > low:
                return at
            if low == a:
                return a
            width *= 4

    @staticmethod
    def stable_after(text: str, mid: int, z: int) -> int:
        """The first provable boundary at or after mid, or z."""
        if mid and "!" <= text[mid - 1] <= "~" and text[mid : mid + 1] in (" ", "\n"):
            return mid
        width = 32
        while True:
            high = min(z, mid + width)
            m = _BREAK.search(text, mid, min(z, high + 1))
            if m and m.end() < z:
                return m.end()
            if high == z:
                return z
            width *= 4

    def drop(self, ids: list[int], size: int, side: int) -> int:
        """How many ids lie outside the size bytes at the end (side -1: the kept count) or the start (side 1: the skipped)."""
        tokens = self.tokens
        if side < 0:
            k = len(ids)
            while size > 0:
                k -= 1
                size -= len(tokens[ids[k]])
        else:
            k = 0
            while size > 0:
                size -= len(tokens[ids[k]])
                k += 1
        if size:
            raise AssertionError("a token crosses a provable boundary")
        return k

    def decode(self, ids: list[int], a: int = 0, z: int | None = None) -> bytes:
        z = len(ids) if z is None else z
        if z - a <= self.leaf:
            return b"".join([self.tokens[i] for i in ids[a:z]])
        mid = (a + z) // 2
        return self.decode(ids, a, mid) + self.decode(ids, mid, z)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of documents (doc_id, text).

    ranks: path of a .tiktoken file, read on the driver; its size bounds what is broadcast.
    """
    with open(ranks, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = held(("tree", hash(lines.value), pattern), lambda: TreeCodec(read_ranks(lines.value), pattern))
        for whole in batches:
            for b in pieces(whole, "text"):
                n, coded, decoded, kept = [], [], [], []
                for text in b["text"].to_pylist():
                    ids = own.encode(text or "")
                    n.append(len(ids))
                    coded.append(sha256(" ".join([own.names[i] for i in ids]).encode()).hexdigest())
                    decoded.append(sha256(own.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [b["doc_id"], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.record_batch([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
