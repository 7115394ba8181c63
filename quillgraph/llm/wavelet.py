"""Token-ID output: one wavelet-matrix file per shard.

Format of a shard file (little-endian): `WVM1`, u8 planes, 3 zero bytes, u64 tokens, u64 documents, then
planes + 2 entries (u64 offset, u64 length), then those sections, each a zstd frame: the document ids
(int64), the document starts (uint32, one more than documents), and for each plane, highest bit first, a
u64 count of zero bits, the bits (8 to a byte, low first, padded to 512) and the uint32 count of one bits
before every 512.  Any plane can be read alone.

A shard holds whole documents in ascending doc_id order (nulls first, equal ids by their token ids); a text that is
null or empty has the end id alone; an empty table has no shards.  Input columns other than doc_id and
text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import held, materialize, pieces, remove, scratch_dir, table

MAGIC, BLOCK = b"WVM1", 512
#: Ranges of doc_id at most: tasks that write, and marks that are broadcast.
RANGES = 1 << 16
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Plane:
    def __init__(self, zeros: int, packed: np.ndarray, ranks: np.ndarray):
        self.zeros, self.packed, self.ranks = zeros, packed, ranks

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        padded = np.zeros((len(bits) // BLOCK + 1) * BLOCK, bool)
        padded[: len(bits)] = bits
        packed = np.packbits(padded, bitorder="little")
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        return cls(len(bits) - int(ranks[-1]), packed, ranks)

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.packed, count=n, bitorder="little").view(bool)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """One bits before each position."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        lines = self.packed.reshape(-1, BLOCK // 8)[np.minimum(block, len(self.packed) * 8 // BLOCK - 1)]
        left = np.clip((at - block * BLOCK)[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)
        return self.ranks[block] + _POP[lines & ((1 << left) - 1).astype(np.uint8)].sum(1, dtype=np.int64)

    def select(self, one: bool, j: int) -> int:
        """Position of the bit number j (from 0) of this kind."""
        seen = self.ranks[:-1].astype(np.int64) if one else np.arange(len(self.ranks) - 1) * BLOCK - self.ranks[:-1]
        block = int(np.searchsorted(seen, j, "right")) - 1
        line = np.unpackbits(self.packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(line == one)[j - seen[block]])


class WaveletMatrix:
    """Succinct sequence of ids under 2**planes."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, now = [], np.asarray(ids)
        for b in range(width - 1, -1, -1):
            bits = (now >> b & 1).astype(bool)
            planes.append(Plane.of(bits))
            now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids: the planes' stable partitions undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for b, plane in enumerate(reversed(self.planes)):
            bits = plane.bits(self.n)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bits)] = now[: plane.zeros]
            up[np.flatnonzero(bits)] = now[plane.zeros :] | kind(1 << b)
            now = up
        return now

    def access(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.bit(at), plane.rank1(at)
            out = out << 1 | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def rank(self, token: int, end: int) -> int:
        """How often the id occurs before position end."""
        a, z = 0, end
        for b, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            ra, rz = (int(x) for x in plane.rank1(np.array([a, z])))
            a, z = (plane.zeros + ra, plane.zeros + rz) if token >> b & 1 else (a - ra, z - rz)
        return z - a

    def count(self, token: int) -> int:
        return 0 if token < 0 or token >> len(self.planes) else self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Position of occurrence j (from 0); IndexError beyond the last."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        a = 0
        for b, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            ones = int(plane.rank1(np.array([a]))[0])
            a = plane.zeros + ones if token >> b & 1 else a - ones
        at = a + j
        for b, plane in enumerate(reversed(self.planes)):
            one = bool(token >> b & 1)
            at = plane.select(one, at - plane.zeros if one else at)
        return at


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A shard file's bytes."""
    matrix = WaveletMatrix.build(ids, width)
    sections = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(starts, "<u4").tobytes()]
    sections += [struct.pack("<Q", p.zeros) + p.packed.tobytes() + p.ranks.astype("<u4").tobytes() for p in matrix.planes]
    squeeze = zstandard.ZstdCompressor(level=1)
    sections = [squeeze.compress(x) for x in sections]
    at, entries = 24 + 16 * len(sections), b""
    for x in sections:
        entries += struct.pack("<QQ", at, len(x))
        at += len(x)
    return MAGIC + struct.pack("<BxxxQQ", width, len(ids), len(doc_ids)) + entries + b"".join(sections)


class ShardFile:
    """Reads a shard file's bytes; sections are opened on first use."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard file")
        self.data = data
        self.width, self.n_tokens, self.n_docs = struct.unpack_from("<BxxxQQ", data, 4)

    def section(self, k: int) -> bytes:
        at, size = struct.unpack_from("<QQ", self.data, 24 + 16 * k)
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + size])

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.section(0), "<i8")

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.section(1), "<u4").astype(np.int64)

    def matrix(self) -> WaveletMatrix:
        planes, lines = [], self.n_tokens // BLOCK + 1
        for k in range(self.width):
            raw = self.section(2 + k)
            cut = 8 + lines * BLOCK // 8
            planes.append(Plane(struct.unpack_from("<Q", raw)[0], np.frombuffer(raw[8:cut], np.uint8), np.frombuffer(raw[cut:], "<u4")))
        return WaveletMatrix(self.n_tokens, planes)


class ChunkEncoder:
    """Encodes whole texts with a tokenizers file, each distinct white-space-free chunk once.

    Holds for tokenizers that drop white space and treat what it separates independently, as the word
    BPE file does (its normaliser works by character or within a chunk, its splitter never crosses white
    space); the tests compare with encoding the texts whole.  Up to `keep` chunks are remembered in Arrow
    arrays, others are encoded anew in each batch.  Special tokens written in a text get their own ids, as in the
    library's plain encode, or with specials=False are text like any other.
    """

    def __init__(self, spec: bytes, dtype: str = "<u2", keep: int = 1_000_000, specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.tokenizer.encode_special_tokens = not specials
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and t.content]
        self.written = "(?i)" + "|".join(map(re.escape, names)) if specials and names else None
        self.dtype, self.keep = np.dtype(dtype), keep
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:  # then words of letters alone can be encoded as one text and told apart by their last tokens
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.names = pa.array([], pa.large_string())
        self.pool, self.bounds = np.zeros(0, self.dtype), np.zeros(1, np.int64)
        marks = [x.ids for x in self.tokenizer.encode_batch_fast([".", ","], add_special_tokens=False)]
        self.marks = np.array([x[0] for x in marks], self.dtype) if all(len(x) == 1 for x in marks) else None

    def chunks(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of chunks, one after the other, and len+1 bounds."""
        alone = np.fromiter((x.isalpha() and x.lower().isalpha() for x in names), bool, len(names))
        pools, sizes = [np.zeros(0, self.dtype)], np.zeros(len(names), np.int64)
        if self.ends is None:
            alone[:] = False
        where = np.flatnonzero(alone)
        joined = []
        for at in range(0, len(where), 20_000):
            some = where[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([names[i] for i in some])], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                sizes[some] = np.diff(cuts, prepend=0)
                joined.append(ids)
            else:
                alone[some] = False
        single = np.flatnonzero(~alone)
        for at in range(0, len(single), 20_000):
            some = single[at : at + 20_000]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([names[i] for i in some], add_special_tokens=False)]
            sizes[some] = [len(x) for x in ids]
            pools.append(np.array([y for x in ids for y in x], self.dtype))
        order = np.argsort(np.concatenate([np.flatnonzero(alone), single]), kind="stable")
        flat, own = np.concatenate([*joined, *pools]), np.concatenate([sizes[alone], sizes[single]])
        begins = np.cumsum(own) - own
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return flat[_stretches(begins[order], sizes)], bounds

    def look_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each key's ids begin in it and how many they are."""
        found = pc.index_in(keys, value_set=self.names)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        pool, bounds = self.pool, self.bounds
        if len(missing):
            fresh = keys.take(pa.array(missing))
            ids, more = self.chunks(fresh.to_pylist())
            at[missing] = len(bounds) - 1 + np.arange(len(missing))
            pool, bounds = np.concatenate([pool, ids]), np.concatenate([bounds, bounds[-1] + more[1:]])
            if len(self.names) + len(missing) <= self.keep:
                self.names = pa.concat_arrays([self.names, fresh])
                self.pool, self.bounds = pool, bounds
        return pool, bounds[at], bounds[at + 1] - bounds[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts and len+1 offsets."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = pc.list_flatten(lists).dictionary_encode()
        names = words.dictionary
        plain = pc.string_is_ascii(names)
        low = plain
        if self.written:  # special tokens are told by their case
            low = pc.and_(plain, pc.invert(pc.match_substring_regex(names, self.written)))
        names = pc.if_else(low, pc.ascii_lower(pc.if_else(low, names, "")), names)
        # An ASCII chunk's last full stop or comma after a letter is a piece of its own.
        mark = np.zeros(len(names), np.int8)
        if self.marks is not None:
            for k, x in enumerate(".,"):
                hit = pc.and_(plain, pc.match_substring_regex(names, f"[a-z][{x}]$"))
                mark[hit.to_numpy(zero_copy_only=False)] = k + 1
            cut = pa.array(mark > 0)
            names = pc.if_else(cut, pc.utf8_slice_codeunits(pc.if_else(cut, names, ""), 0, -1), names)
        keys = names.dictionary_encode()
        pool, begins, sizes = self.look_up(keys.dictionary)
        key = keys.indices.to_numpy(zero_copy_only=False)
        codes = words.indices.to_numpy(zero_copy_only=False)
        del words
        word_key, word_mark = key[codes], mark[codes]
        lengths = sizes[word_key]
        total = lengths + (word_mark > 0)
        ends = np.cumsum(total)
        marked = np.flatnonzero(word_mark)
        ids = np.empty(ends[-1] if len(ends) else 0, self.dtype)
        place = np.ones(len(ids), bool)
        place[ends[marked] - 1] = False
        ids[np.flatnonzero(place)] = pool[_stretches(begins[word_key], lengths)]
        if len(marked):
            ids[ends[marked] - 1] = self.marks[word_mark[marked] - 1]
        bounds = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], ends])[bounds - bounds[0]]


def _stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other; under 2**31."""
    ends = np.cumsum(sizes)
    out = np.repeat((begins - ends + sizes).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def shard_table(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_bytes: int = 8 << 20, width: int = 16, specials: bool = True) -> DataFrame:
    """(shard long, n_tokens long, file binary): documents (doc_id, text) as shard files in doc_id order.

    Documents are dealt by ranges of doc_id of about shard_bytes of text each, RANGES at most, whose bounds are
    quantiles of a sample of about 30 ids a range; a range that holds more, by long texts or many rows of one id, is cut
    into several files, so that no task holds more than about twice shard_bytes and one text.  Shards number
    range << 20 | file.  tokenizer: path of a tokenizers file, read on the driver; specials: see ChunkEncoder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total, rows = docs.agg(F.sum(weight.cast("long")), F.count("*")).first()
    shards = min(RANGES, max(1, -(-(total or 0) // shard_bytes)))
    share = min(1.0, 30 * shards / max(1, rows))
    some = docs.where("doc_id is not null").select("doc_id")
    some = np.sort(some.where(F.rand(7) < share).toArrow()["doc_id"].to_numpy()) if shards > 1 else np.zeros(0, np.int64)
    marks = some[np.arange(1, shards) * len(some) // shards] if len(some) else some
    bounds = spark.sparkContext.broadcast(np.unique(marks))
    with open(tokenizer, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    kind = "<u4" if width > 16 else "<u2"

    def encode(batches):
        encoder = held(("chunks", hash(spec.value), kind, specials), lambda: ChunkEncoder(spec.value, kind, specials=specials))
        for whole in batches:
            for b in pieces(whole, "text", 10 << 20):
                ids, at = encoder.encode(b["text"])
                raw, step = ids.tobytes(), ids.itemsize
                keys = b["doc_id"]
                shard = np.searchsorted(bounds.value, keys.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
                yield pa.record_batch([pa.array(shard), keys, pa.array([raw[step * a : step * z] for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        now, held, size, part = None, [], 0, 0

        def made():
            ids = [np.append(np.frombuffer(x, kind), np.dtype(kind).type(end_id)) for _, x in held]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            file = pack(np.array([i for i, _ in held]), starts, np.concatenate(ids), width)
            return pa.record_batch([pa.array([now << 20 | part], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([file], pa.binary())], ["shard", "n_tokens", "file"])

        for b in batches:
            for shard, key, ids in zip(*(b[c].to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if held and (shard != now or size > 2 * shard_bytes):
                    yield made()
                    held, size, part = [], 0, part + 1
                if shard != now:
                    now, part = shard, 0
                held.append((-(1 << 63) if key is None else key, ids))
                size += 2 * len(ids) + 64
        if held:
            yield made()

    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return dealt.mapInArrow(write, "shard long, n_tokens long, file binary")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in shard files; start counts over all shards."""

    def read(batches):
        for b in batches:
            for shard, data in zip(b["shard"].to_pylist(), b["file"].to_pylist(), strict=True):
                f = ShardFile(data)
                ids, at = f.matrix().decode().astype("<u4"), f.starts()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                keys = f.doc_ids()
                yield pa.record_batch([pa.array(np.full(f.n_docs, shard)), pa.array(keys, mask=keys == -(1 << 63)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    from pyspark.sql import Window

    sizes = files.select("shard", "n_tokens", F.shiftright("shard", 32).alias("block"))
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("shard")) - F.col("n_tokens")
    bases = sizes.withColumn("within", within).join(blocks, "block").select("shard", (F.col("within") + F.col("before")).alias("base"))
    rows = files.mapInArrow(read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> None:
    """Each shard file of a table (shard, file) on its own in a mounted folder, written under a temporary name and renamed;
    a file that is there already is replaced.  Other columns are not read; a null file is an error."""

    def put(batches):
        import os

        for b in batches:
            for shard, data in zip(b["shard"].to_pylist(), b["file"].to_pylist(), strict=True):
                to = f"{folder}/shard-{shard:015d}.wvm"
                with open(f"{to}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{to}.{os.getpid()}", to)
            yield b.select(["shard"])

    files.mapInArrow(put, "shard long").count()


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark)
    files = shard_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    files.write.option("compression", "none").parquet(f"{path}/files")
    out = materialize(read_documents(spark.read.parquet(f"{path}/files")), f"{path}/rows")
    remove(spark, f"{path}/files")
    return out
