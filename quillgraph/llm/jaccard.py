"""N-gram Jaccard join by a grouped prefix join, and its connected components.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a document's set holds the 64-bit hashes of its
distinct k-word shingles.  Sets link when intersection * den >= union * num.  Steps:

1. Sketch: counts of shingles in a fixed number of hash cells over all documents, summed and kept as one
   byte a cell (how far a cell is above the mean, in doublings).  (byte, hash) is the global order of
   shingles: common passages come last.  The order affects speed only.
2. One more pass gives each text its set's 128-bit digest, size, prefix (the first shingles in that order,
   as many as a partner must share at least one of) and a parity bitmap of about as many bits as shingles,
   also folded to 1,024.  Equal sets become one node; nodes with equal size and prefix one group.
3. Prefix shingles are posted by group; a shingle in very many places is dealt to several tasks.  In the order of
   sizes a posting list is cut wherever neighbours' sizes rule a link out; lists of one group are dropped.  Two
   groups of a list are a candidate if size and positions allow enough overlap.
4. First round: in each list only neighbours in a random order are candidates, and in each group only
   successive members; so rows stay linear in the postings.  Candidates are expanded to members, filtered by
   bitmap (the parity of two sets differs in no more bits than the sets in elements) and verified on whole
   sets, rebuilt from the texts of just these documents.  Links give components.
5. Second round: every other pair of a list or group that the first round left in different components,
   with the same filters, again verified; so no link between components is lost, while pairs inside a
   component, which cannot change the result, are not formed: lists within one component are dropped by an
   aggregate, others are paired component by component.  Lists of two have no other pair.  Long lists are cut
   into blocks, and pairs of blocks are the tasks.

Documents with no words (null, empty, white space) have n_shingles 0 and are their own component; with
fewer words than k the whole sequence is the only shingle.  Rows that repeat a doc_id are separate nodes
under one id.  A null doc_id stands for itself: component_id is the smallest non-null id, or null.  An
empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import U64, materialize, mix, pieces, raw_shingles, release, remove, scratch_dir, shingle_hashes, table, text_buffers, unused

CELL_BITS, CHUNK_BITS = 22, 16
BITMAP = 128  # bytes
BLOCK = 2048
BLOOM_MOST = 1 << 26  # bits
HOT = 1 << 20  # places of a shingle from which its list is dealt to several tasks


def _prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many shingles of a set of n are its prefix: n - ceil(n * num / den) + 1."""
    return np.where(n > 0, n + (-n * num) // den + 1, 0)


def _needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection with which sets of sizes a and b link."""
    return -((-(a + b) * num) // (num + den))


def sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """One byte for each of 2**CELL_BITS cells: doublings of its count over the mean, from all documents; and that mean."""
    cells, chunk = 1 << CELL_BITS, 1 << CHUNK_BITS

    def count(batches):
        release()
        total = np.zeros(cells, np.uint32)
        held, size = [], 0
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                h = raw_shingles(*text_buffers(b["text"]), k)[0]
                held.append((h >> U64(64 - CELL_BITS)).astype(np.uint32))
                size += len(h)
                if size > 4_000_000:
                    total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
        if total.any():
            parts = [zlib.compress(total[i * chunk : (i + 1) * chunk].tobytes(), 1) for i in range(cells // chunk)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
        if sums:
            logs = [np.minimum(255, 5 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], ["chunk", "logs", "total"])

    counted = docs.mapInArrow(count, "chunk int, counts binary").repartition(cells // chunk, "chunk")
    found = counted.mapInArrow(add, "chunk int, logs binary, total long").toArrow()
    logs = np.zeros(cells, np.uint8)
    for i, x in zip(found["chunk"].to_pylist(), found["logs"].to_pylist(), strict=True):
        logs[i * chunk : (i + 1) * chunk] = np.frombuffer(x, np.uint8)
    mean = max(1.0, sum(found["total"].to_pylist()) / cells)
    return np.maximum(np.floor(logs / 5 - np.log2(mean)), 0).astype(np.uint8), mean


def _bitmap(h: np.ndarray) -> bytes:
    """Parity of the set's elements by the low bits of another hash: a power of two of bits, as many as elements at least."""
    size = max(BITMAP * 8, 1 << (len(h) - 1).bit_length())
    bits = np.bincount((mix(h) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def _folded(bitmap: bytes, size: int) -> bytes:
    """The bitmap that the set has with only size bytes."""
    x = np.frombuffer(bitmap, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes()


def _describe(docs: DataFrame, k: int, num: int, den: int, order) -> DataFrame:
    """(doc_id, digest, n, grp, prefix, bitmap, fine) and docs' other columns but text: all but doc_id and n are null without words.

    grp is a 64-bit hash of size and prefix; were two to meet, their members would be candidates in vain.
    """

    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in more)

    def run(batches):
        release()
        rank = order.value
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                digest, n, grp, prefix, bitmap, fine = [], [], [], [], [], []
                for h in shingle_hashes(*text_buffers(b["text"]), k):
                    n.append(len(h))
                    if not len(h):
                        for column in (digest, grp, prefix, bitmap, fine):
                            column.append(None)
                        continue
                    size = int(_prefix_size(np.int64(len(h)), num, den))
                    level = rank[h >> U64(64 - CELL_BITS)]
                    low = h[level == 0]  # sorted by hash already
                    head = low[:size] if len(low) >= size else h[np.argsort(level, kind="stable")[:size]]
                    raw = head.astype("<u8").tobytes()
                    digest.append(blake2b(h.tobytes(), digest_size=16).digest())
                    grp.append(int.from_bytes(blake2b(raw, digest_size=8, salt=len(h).to_bytes(8, "little")).digest(), "little", signed=True))
                    prefix.append(raw)
                    fine.append(_bitmap(h))
                    bitmap.append(_folded(fine[-1], BITMAP))
                yield pa.record_batch([b["doc_id"], pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(grp, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bitmap, pa.binary()), pa.array(fine, pa.binary()), *(b[c] for c in more)], ["doc_id", "digest", "n", "grp", "prefix", "bitmap", "fine", *more])

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, grp long, prefix binary, bitmap binary, fine binary" + kinds)


def _post(described: DataFrame, order, mean: float) -> DataFrame:
    """(token, salt, at, grp) of each prefix shingle, once for a group in each task (so copies meet before the shuffle).

    at is n << 32 | pos.  salt deals a shingle that the sketch shows to be in over HOT places to several tasks by
    group, from 1 on; 0 for all others.
    """

    def run(batches):
        release()
        parts = np.array([0, 0, *np.ceil(mean * np.exp2(np.arange(3, 60)) / HOT).astype(np.int64)])
        parts[parts == 1] = 0
        seen: set[int] = set()  # ids of groups of this task's rows
        for b in batches:
            keep = []
            for i, g in enumerate(b["grp"].to_pylist()):
                if g not in seen:
                    seen.add(g)
                    keep.append(i)
            b = b.take(pa.array(keep, pa.int64()))
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                prefixes = [np.frombuffer(x, "<i8") for x in part["prefix"].to_pylist()]
                sizes = np.array([len(x) for x in prefixes], np.int64)
                token = np.concatenate(prefixes)
                grp = np.repeat(part["grp"].to_numpy(), sizes)
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                several = parts[order.value[token.view(U64) >> U64(64 - CELL_BITS)]]
                salt = np.where(several > 0, (mix(grp.view(U64)) % np.maximum(several, 1).astype(U64)).astype(np.int64) + 1, 0)
                yield pa.record_batch([pa.array(token), pa.array(salt.astype(np.int32)), pa.array(np.repeat(part["n"].to_numpy(), sizes) << 32 | pos), pa.array(grp)], ["token", "salt", "at", "grp"])

    return described.mapInArrow(run, "token long, salt int, at long, grp long")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A column of values of `width` bytes as len x width/8 of uint64 (for comparing and copying, not for order)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width // 8)


def _runs(batches, key: list[str], widths: dict[str, int], apart=None):
    """Whole runs of equal keys from sorted batches: dicts of numpy arrays, and where the runs start.

    apart, if given, says of a dict's rows from the second on whether a run ends before them too.
    """
    held = None

    def cut(t):
        change = np.zeros(len(t[key[0]]), bool)
        change[0] = True
        for c in key:
            change[1:] |= t[c][1:] != t[c][:-1]
        if apart is not None:
            change[1:] |= apart(t)
        return np.flatnonzero(change)

    for b in batches:
        t = {c: _rows(b[c], widths[c]) if c in widths else b[c].to_numpy(zero_copy_only=False) for c in b.schema.names}
        if not len(b):
            continue
        if held is not None:
            t = {c: np.concatenate([held[c], t[c]]) for c in t}
        starts = cut(t)
        last = starts[-1]
        held = {c: x[last:] for c, x in t.items()}
        if last:
            yield {c: x[:last] for c, x in t.items()}, starts[:-1]
    if held is not None:
        yield held, cut(held)


def _shared(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Postings (token, low, grp, at) for round two, and round one's candidates as rows (grp, other).

    A list in the order of sizes is cut wherever two neighbours' sizes rule a link out, as then no pair across the cut
    can link.  What is left is a list of its own, named by its least size (low); lists of one group are dropped.
    Round one takes groups next to each other in bands of size and random order within a band; for lists of
    two there is nothing beyond it.  Lists dealt to several tasks are not cut (low -1), as a task sees only some groups.
    """

    def run(batches):
        release()
        gap = lambda t: (t["salt"][1:] == 0) & ((t["at"][:-1] >> 32) * den < (t["at"][1:] >> 32) * num)
        for t, starts in _runs(batches, ["token", "salt"], {}, gap):
            begin = np.zeros(len(t["token"]), bool)
            begin[starts] = True
            fresh = begin.copy()
            fresh[1:] |= t["grp"][1:] != t["grp"][:-1]
            sizes = np.add.reduceat(fresh, starts, dtype=np.int64)
            lengths = np.diff(np.append(starts, len(fresh)))
            size = np.repeat(sizes, lengths)
            salt = t["salt"]
            low = np.where(salt == 0, np.repeat(t["at"][starts] >> 32, lengths), -1)
            which = np.repeat(np.arange(len(starts)), lengths)
            keep = fresh & ((size > 2) | (salt > 0))
            if keep.any():
                yield pa.record_batch([pa.array(t["token"][keep]), pa.array(low[keep]), pa.array(t["grp"][keep]), pa.array(t["at"][keep]), pa.nulls(int(keep.sum()), pa.int64())], names)
            keep = fresh & (size > 1)
            if not keep.any():
                continue
            token, which, grp, at = t["token"][keep], which[keep], t["grp"][keep], t["at"][keep]
            n, pos = at >> 32, at & 0xFFFFFFFF
            order = np.lexsort((mix(grp.view(U64) ^ mix(token.view(U64))), np.floor(np.log(n) * 8), which))
            i, j = order[:-1], order[1:]
            same = which[i] == which[j]
            i, j = i[same], j[same]
            ok = _fits({"n": n, "pos": pos}, i, j, num, den)
            if ok.any():
                pairs = _pairs(grp[i[ok]], grp[j[ok]])
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.record_batch([none, none, pairs["a"], none, pairs["b"]], names)

    names = ["token", "low", "grp", "at", "other"]
    return posted.repartition("token", "salt").sortWithinPartitions("token", "salt", "at", "grp").mapInArrow(run, "token long, low long, grp long, at long, other long")


def _fits(t: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes, and the positions of one shared shingle, leave enough overlap for a link."""
    a, b, p, q = (t[c][x].astype(np.int64) for c in ("n", "pos") for x in (i, j))
    need = _needed(a, b, num, den)
    return (np.minimum(a, b) >= need) & (np.minimum(a - p, b - q) + np.minimum(p, q) >= need)


def _near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bits in which bitmaps differ leave a link possible."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= a + b - 2 * _needed(a, b, num, den)


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Distinct unordered pairs as (a, b) with a < b."""
    both = np.sort(np.stack([x, y], 1), axis=1)
    both = both[np.unique(both.view("V16").ravel(), return_index=True)[1]]
    return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _across(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Round two: all pairs of a list (token, low, id, n, pos, df, comp, bitmap, one) in different components.

    comp of -1: of several components, so any pair counts.  one: the bitmap stands for the id.  Rows come in the
    order of components, so that pairs within one are not even formed.
    """
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "token"), F.col("blocks")).cast("int")
    cut = lists.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("token", "low", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "pos", "comp", "bitmap", "one")
    key = ["token", "low", "x", "y"]

    def run(batches):
        release()
        for t, starts in _runs(batches, key, {"bitmap": BITMAP}):
            rows = np.arange(len(t["token"]))
            sizes = np.diff(np.append(starts, len(rows)))
            begin = np.zeros(len(rows), bool)
            begin[starts] = True
            begin[1:] |= (t["comp"][1:] != t["comp"][:-1]) | (t["comp"][1:] == -1)
            runs = np.flatnonzero(begin)
            first = np.repeat(np.append(runs[1:], len(rows)), np.diff(np.append(runs, len(rows))))  # of the next component
            after = np.repeat(starts + sizes, sizes) - first
            ends = np.cumsum(after)
            done = 0
            while done < len(rows):  # about 150,000 pairs at a time
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 150_000, "right")))
                n = after[done:upto]
                i = np.repeat(rows[done:upto], n)
                j = np.repeat(first[done:upto], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                done = upto
                for ok in (
                    lambda i, j: np.minimum(t["n"][i], t["n"][j]) * den >= np.maximum(t["n"][i], t["n"][j]) * num,
                    lambda i, j: (t["x"][i] == t["y"][i]) | (t["own"][i] != t["own"][j]),
                    lambda i, j: _fits(t, i, j, num, den),
                    lambda i, j: ~(t["one"][i] & t["one"][j]) | _near(t["bitmap"][i], t["bitmap"][j], t["n"][i], t["n"][j], num, den),
                ):
                    if len(i):
                        keep = ok(i, j)
                        i, j = i[keep], j[keep]
                if len(i):
                    yield _pairs(t["id"][i], t["id"][j])

    return cut.repartition(*key).sortWithinPartitions(*key, "comp").mapInArrow(run, "a long, b long").distinct()


def _mixed(lists: DataFrame) -> DataFrame:
    """(token, low, df) of the lists (token, low, comp) of three rows or more that lie in more than one component."""
    sums = lists.groupBy("token", "low").agg(F.count("*").alias("df"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    return sums.where("df > 2 and (least <> most or least = -1)").select("token", "low", "df")


def _close(pairs: DataFrame, nodes: DataFrame, num: int, den: int, path: str) -> DataFrame:
    """(a, b, apart) of the pairs of nodes whose sizes and bitmaps leave a link possible."""

    def run(batches):
        release()
        for b in batches:
            if len(b):
                na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
                x, y = b["xa"].to_pylist(), b["xb"].to_pylist()
                sizes = np.minimum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
                apart = np.zeros(len(b), np.int64)
                for size in np.unique(sizes).tolist():  # few: the sizes are powers of two
                    at = np.flatnonzero(sizes == size)
                    p, q = (np.frombuffer(b"".join([v[i] if len(v[i]) == size else _folded(v[i], size) for i in at]), np.uint64).reshape(len(at), -1) for v in (x, y))
                    apart[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
                ok = apart <= na + nb - 2 * _needed(na, nb, num, den)
                ok &= np.minimum(na, nb) * den >= np.maximum(na, nb) * num
                yield pa.record_batch([b["a"], b["b"], pa.array(apart)], ["a", "b", "apart"]).filter(pa.array(ok))

    some = materialize(_among(nodes.select("node", "n", "fine"), "node", pairs), f"{path}-ends")
    x = some.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("xa"))
    y = some.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("xb"))
    close = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, apart long"), path)
    remove(pairs.sparkSession, f"{path}-ends")
    return close


def _bloom(ids: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bits in which the ids (one long column, about `count` values) are marked, twice each; at most BLOOM_MOST of them."""
    bits = 1 << min(BLOOM_MOST.bit_length() - 1, max(16, (16 * max(count, 1)).bit_length()))

    def run(batches):
        release()
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _marks(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if own.any():
            yield pa.record_batch([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out, bits


def _marks(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(U64) + U64(1))
    return (h & U64(bits - 1)).astype(np.int64), (h >> U64(34) & U64(bits - 1)).astype(np.int64)


def _marked(bloom: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    one, two = _marks(ids, bits)
    return (bloom[one >> 3] >> (one & 7).astype(np.uint8) & bloom[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)


def _among(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """rows without most of those whose key is in no pair: fewer to shuffle for the join that follows."""
    marks = rows.sparkSession.sparkContext.broadcast(_bloom(pairs.select("a").union(pairs.select("b")), 2 * pairs.count()))

    def run(batches):
        release()
        bloom, bits = marks.value
        for b in batches:
            yield b.filter(pa.array(_marked(bloom, bits, b[key].to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, path: str) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets from the texts of their first documents."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(_among(nodes.select("node", "digest", F.coalesce("doc_id", F.lit(-1)).alias("id")), "node", pairs).join(ends, "node", "left_semi"), f"{path}-wanted")
    marks = spark.sparkContext.broadcast(_bloom(wanted.select("id"), wanted.count()))

    def sets(batches):
        release()
        bloom, bits = marks.value
        seen: set[bytes] = set()
        for whole in batches:
            hit = _marked(bloom, bits, whole["doc_id"].fill_null(-1).to_numpy())
            for b in pieces(whole.filter(pa.array(hit)), "text", 2 << 20):
                digests, rows = [], []
                for h in shingle_hashes(*text_buffers(b["text"]), k):
                    digest = blake2b(h.tobytes(), digest_size=16).digest()
                    if len(h) and digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        rows.append(h.tobytes())
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["digest", "shingles"])

    found = docs.mapInArrow(sets, "digest binary, shingles binary").join(wanted.select("digest", "node"), "digest").select("node", "shingles")
    found = materialize(found, f"{path}-sets")

    def check(batches):
        release()
        for b in batches:
            if not len(b):
                continue
            ok = []
            for x, y in zip(b["xa"], b["xb"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(same * den >= (len(both) - same) * num)
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok))

    x = found.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    y = found.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    links = materialize(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(check, "a long, b long").distinct(), f"{path}-links")
    for name in ("sets", "wanted"):
        remove(spark, f"{path}-{name}")
    return links


def connected(links: DataFrame, path: str) -> DataFrame:
    """(node, comp) of the links' ends: comp is the least node of the component.

    Each round gives a node the least label around it, then its label's label, until nothing changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{path}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), f"{path}-labels-0")
    step = 0
    while True:
        step += 1
        around = edges.join(labels.withColumnsRenamed({"node": "b", "comp": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("comp", "near").alias("low"), "comp")
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        fresh = materialize(lower.join(jump, "low").select("node", F.least("low", "next").alias("comp"), (F.least("low", "next") != F.col("comp")).alias("changed")), f"{path}-labels-{step}")
        labels = fresh.select("node", "comp")
        remove(links.sparkSession, f"{path}-labels-{step - 1}")
        if fresh.where("changed").isEmpty():
            remove(links.sparkSession, f"{path}-edges")
            return labels


def components(docs: DataFrame, k: int, num: int, den: int, heads: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text).

    With `heads` also own, the MD5 of the text, and stays: whether (doc_id, own) is the least of its component,
    null ids last; texts without words are on their own and stay.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark)
    work = f"{path}/work"
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    levels, mean = sketch(docs, k)
    order = spark.sparkContext.broadcast(levels)
    own, head = ["own"] if heads else [], ["head"] if heads else []
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own") if heads else None
    known = docs.withColumn("own", F.unhex(F.md5("text"))) if heads else docs
    described = materialize(_describe(known, k, num, den, order).withColumn("row", F.monotonically_increasing_id()), f"{work}/described")
    worded = described.where("digest is not null")
    first = F.min(F.struct("row", "doc_id", "n", "grp", "bitmap", "fine")).alias("first")
    nodes = worded.groupBy("digest").agg(first, F.min("doc_id").alias("first_id"), *(F.min(key).alias(c) for c in head))
    nodes = materialize(nodes.select(F.col("first.row").alias("node"), "digest", "first.doc_id", "first.n", "first.grp", "first.bitmap", "first.fine", "first_id", *head), f"{work}/nodes")
    found = materialize(_shared(_post(worded.select("grp", "n", "prefix"), order, mean), num, den), f"{work}/shared")
    shared = found.where("other is null").select("token", "low", "grp", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos"))
    # Prefixes have served; without them and the bitmaps what is kept of each document is small.
    described = materialize(described.select("doc_id", "n", "digest", *own), f"{work}/documents")
    remove(spark, f"{work}/described")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("node"), F.count("*").alias("members"))

    # Round one: neighbours in lists by their groups' first members, successive members within groups.
    near = materialize(found.where("other is not null").select(F.col("grp").alias("a"), F.col("other").alias("b")).distinct(), f"{work}/near")
    firsts = materialize(_among(groups.select("grp", "node"), "grp", near), f"{work}/firsts")
    pairs = near.join(firsts.withColumnsRenamed({"grp": "a", "node": "na"}), "a").join(firsts.withColumnsRenamed({"grp": "b", "node": "nb"}), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    crowded = nodes.select("grp", "node").join(groups.where("members > 1").select("grp"), "grp", "left_semi")
    chain = crowded.select(F.lag("node").over(Window.partitionBy("grp").orderBy("node")).alias("a"), F.col("node").alias("b")).where("a is not null")
    pairs = materialize(pairs.union(chain).distinct(), f"{work}/pairs")
    close = _close(pairs, nodes, num, den, f"{work}/close")
    # Of each node's pairs the nearest are enough here: round two takes up what they leave apart.
    both = close.union(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    best = both.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).where("place <= 8")
    best = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{work}/best")
    links = _verify(docs, best, nodes, k, num, den, f"{work}/one")
    comps = connected(links, f"{work}/one")

    # Round two: everything that is still apart.
    members = nodes.select("node", "grp", "n", "bitmap").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = materialize(members, f"{work}/members")
    alone = F.col("size") == 1
    grouped = members.groupBy("grp").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("bitmap").alias("bitmap"))
    grouped = materialize(grouped.select("grp", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(-1)).alias("comp"), "bitmap", alone.alias("one"), "size"), f"{work}/groups")
    lists = materialize(shared.join(grouped.select("grp", "comp"), "grp"), f"{work}/lists")
    remove(spark, f"{work}/shared")
    lists = lists.join(_mixed(lists), ["token", "low"]).join(grouped.select("grp", "bitmap", "one"), "grp").withColumnRenamed("grp", "id")
    wide = materialize(near.union(_across(lists, num, den)).distinct(), f"{work}/wide")
    remove(spark, f"{work}/lists")
    member = _among(members.select("grp", "node", "comp"), "grp", wide)
    left = member.withColumnsRenamed({"grp": "a", "node": "na", "comp": "ca"})
    right = member.withColumnsRenamed({"grp": "b", "node": "nb", "comp": "cb"})
    expanded = wide.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    mixed = grouped.where("size > 1 and comp = -1").select(F.col("grp").alias("token"), F.col("size").alias("df"))
    inner = members.withColumnRenamed("grp", "token").join(mixed, "token").select("token", F.lit(0).cast("long").alias("low"), F.col("node").alias("id"), "n", F.lit(0).cast("long").alias("pos"), "df", "comp", "bitmap", F.lit(True).alias("one"))
    apart = materialize(expanded.union(_across(inner, num, den)).distinct(), f"{work}/apart")
    fresh = materialize(apart.join(pairs, ["a", "b"], "left_anti"), f"{work}/fresh")
    left_over = close.select("a", "b").join(best, ["a", "b"], "left_anti").join(apart, ["a", "b"], "left_semi")
    more = materialize(_close(fresh, nodes, num, den, f"{work}/closer").select("a", "b").union(left_over), f"{work}/more")
    if not more.isEmpty():
        further = _verify(docs, more, nodes, k, num, den, f"{work}/two")
        if not further.isEmpty():
            comps = connected(links.union(further), f"{work}/two")

    ids = nodes.select("node", "digest", "first_id", *head).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min("first_id").alias("component_id"), *(F.min(c).alias(c) for c in head))
    of_node = ids.drop(*head).join(least, "comp").select("digest", "component_id", *head)
    out = described.join(of_node, "digest", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *own, *((F.col("digest").isNull() | key.eqNullSafe(F.col(c))).alias("stays") for c in head))
    out = materialize(out, f"{path}/out")
    remove(spark, work)
    return out


def keep_one_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id; docs' own columns, whatever their names.

    Null ids come last; of several texts under the smallest id, that with the least MD5 stays.  Rows that repeat
    a doc_id and its text are one document; one row of them stays.  Most rows are known to stay by a bitmap of
    the ids that go or repeat; only the others, with a few that it cannot tell, are joined with the exact list.
    """
    groups = components(docs, k, num, den, heads=True)
    doc, own, place, known, of, stays = (unused(c, docs.columns) for c in ("_doc", "_own", "_place", "_id", "_of", "_stays"))
    unsure = groups.groupBy("doc_id", "own").agg(F.count("*").alias("rows"), F.bool_or("stays").alias("stays")).where("rows > 1 or not stays")
    count = unsure.count()
    marks = docs.sparkSession.sparkContext.broadcast(_bloom(unsure.select(F.coalesce("doc_id", F.lit(-1)).alias("id")), count))
    rows = docs.withColumn(doc, F.col("doc_id").cast("long"))

    def split(wanted: bool):
        def run(batches):
            release()
            bloom, bits = marks.value
            for b in batches:
                hit = _marked(bloom, bits, b[doc].fill_null(-1).to_numpy())
                yield b.filter(pa.array(hit == wanted))

        return run

    sure = rows.mapInArrow(split(False), rows.schema)
    listed = unsure.select(F.col("doc_id").alias(known), F.col("own").alias(of), F.col("stays").alias(stays))
    rest = rows.mapInArrow(split(True), rows.schema).withColumn(own, F.unhex(F.md5(F.col("text").cast("string"))))
    rest = rest.join(listed, F.col(doc).eqNullSafe(F.col(known)) & F.col(own).eqNullSafe(F.col(of)), "left").where(F.col(stays).isNull() | F.col(stays))
    same = Window.partitionBy(doc, own).orderBy(F.lit(0))
    rest = rest.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*kept).unionByName(rest.select(*kept))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 3, 90, 100)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS same
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * same >= 90 * (na + nb - same)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.far = g.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
