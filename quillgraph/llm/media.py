"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY, difference hashes.

Decoding takes binary and plain PBM, PGM and PPM (P1 to P6, samples of 8 or 16 bits) and uncompressed BMP
of 1, 4, 8, 24 and 32 bits, top-down or bottom-up.  Anything else, a null or a truncated image gives a row
with null results; an image without pixels too.

The op9 query stores each text's bytes as samples of an image of width 24 (rows of 24 samples, so any multiple of
576 fills whole rows): a grey BMP where the payload is an even number of units of 576, else a binary PGM.  The
images are a Parquet media table in the shared folder.  What is read back is decoded, its payload digested, and
its area-resized NPY tile and difference hash written as a table of tiles; the query's rows come from that table.
A null text counts as empty (one payload of 576 bytes 255); equal texts give equal values; a repeated row is
repeated; an empty table gives no rows; other columns are not read.  A long text is held as bytes and as its
image; resizing adds only the sums of the rows at the edges of cells.
"""

from __future__ import annotations

import io
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, pieces, release, remove, scratch_dir, table, unused

UNIT, WIDTH, TILE = 576, 24, 16


class BadImage(ValueError):
    """Not an image that can be decoded."""


def _fields(data: bytes, count: int) -> tuple[list[int], int]:
    """Whole numbers of a Netpbm header (with # comments), and where the samples begin."""
    out, at = [], 2
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                at = data.find(b"\n", at)
                if at < 0:
                    raise BadImage("comment without an end")
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise BadImage("header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """height x width (x 3 for pixmaps) of uint8, or uint16 where the largest value is over 255; PBM: 0 or 255."""
    kind = int(data[1:2])
    (w, h, *rest), at = _fields(data, 2 if kind in (1, 4) else 3)
    top, depth = rest[0] if rest else 1, 3 if kind in (3, 6) else 1
    if not (w and h and 0 < top < 65536):
        raise BadImage("no pixels")
    n = w * h * depth
    if kind == 4:
        row = -(-w // 8)
        if len(data) < at + row * h:
            raise BadImage("truncated")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind == 1:
        digits = bytes(x for x in data[at - 1 :] if x in b"01")[:n]
        if len(digits) < n:
            raise BadImage("truncated")
        return np.where(np.frombuffer(digits, np.uint8).reshape(h, w) == 49, 0, 255).astype(np.uint8)
    if kind in (2, 3):
        values = np.array(data[at - 1 :].split()[:n], np.int64)
        if len(values) < n or values.max() > top:
            raise BadImage("truncated")
        samples = values.astype(np.uint8 if top < 256 else np.uint16)
    else:
        one = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) < at + n * one.itemsize:
            raise BadImage("truncated")
        samples = np.frombuffer(data, one, n, at).astype(one.newbyteorder("="))
    return samples.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """height x width x 3 of uint8 in RGB order."""
    if len(data) < 54:
        raise BadImage("truncated")
    start, header, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packing, _, _, _, used = struct.unpack_from("<HIIiiI", data, 28)
    if packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise BadImage("kind of BMP")
    row = (w * bits + 31) // 32 * 4
    if len(data) < start + row * abs(h):
        raise BadImage("truncated")
    lines = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    if h > 0:
        lines = lines[::-1]
    if bits >= 24:
        return lines[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    colours = used or 1 << bits
    if len(data) < 14 + header + 4 * colours:
        raise BadImage("palette")
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(colours, 4)[:, 2::-1]
    index = lines if bits == 8 else np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], -1).reshape(abs(h), -1)
    index = index[:, :w]
    if index.max() >= colours:
        raise BadImage("palette")
    return palette[index]


def decode(data: bytes | None) -> np.ndarray | None:
    """The image as an array, or None."""
    try:
        if data and data[:1] == b"P" and data[1:2] in b"123456":
            return decode_netpbm(data)
        if data and data[:2] == b"BM":
            return decode_bmp(data)
    except (BadImage, ValueError, OverflowError, struct.error):
        return None
    return None


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed BMP of 8 bits, its palette the 256 greys, rows from the bottom up."""
    h, w = samples.shape
    row = -(-w // 4) * 4
    lines = np.zeros((h, row), np.uint8)
    lines[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + row * h, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, row * h, 2835, 2835, 256, 256)
    return head + palette.tobytes() + lines.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """One plane: float64 from 0 to 255, or the bytes themselves where all channels are equal or there is one."""
    if image.dtype == np.uint8 and (image.ndim == 2 or (image[..., 0] == image[..., 1]).all() and (image[..., 1] == image[..., 2]).all()):
        return image if image.ndim == 2 else image[..., 0]
    x = image.astype(np.float64) / (257 if image.dtype == np.uint16 else 1)
    return x @ np.array([0.299, 0.587, 0.114]) if x.ndim == 3 else x


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, by differences in the (linearly continued) integral image.

    Only the integral image's rows beside the edges of cells are needed and formed.
    """
    h, w = plane.shape

    def along(n: int, m: int):
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(int), n - 1)
        return low, at - low

    r, rf = along(h, height)
    c, cf = along(w, width)
    edges = np.unique(np.concatenate([r, r + 1]))  # from 0 to h
    sums = np.add.reduceat(plane, edges[:-1], axis=0, dtype=np.float64)
    integral = np.zeros((len(edges), w + 1))
    integral[1:, 1:] = sums.cumsum(0).cumsum(1)
    r, after = np.searchsorted(edges, r), np.searchsorted(edges, r + 1)
    rows = integral[r] + (integral[after] - integral[r]) * rf[:, None]
    both = rows[:, c] + (rows[:, c + 1] - rows[:, c]) * cf
    cells = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return cells / ((h / height) * (w / width))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 x 9 reduction is brighter than the next to its right."""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(plane: np.ndarray, height: int, width: int) -> bytes:
    """The plane resized to height x width of uint8, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(np.round(area_resize(plane, height, width), 6)), 0, 255), np.uint8), allow_pickle=False)
    return out.getvalue()


def image_tiles(images: DataFrame, key: str, media: str, size: int = TILE) -> DataFrame:
    """(key, height, width, tile binary, dhash) of a table with encoded images in column media; a key column named as
    one of these has _ put before its name."""
    own = unused(key, ["height", "width", "tile", "dhash"])

    def run(batches):
        release()
        for b in batches:
            out = []
            for data in b["media"].to_pylist():
                image = decode(data)
                out.append((None,) * 4 if image is None else (*image.shape[:2], npy_tile(plane := grey(image), size, size), difference_hash(plane)))
            h, w, tile, dhash = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([b["key"], pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(tile, pa.binary()), pa.array(dhash, pa.string())], ["key", "height", "width", "tile", "dhash"])

    kind = images.schema[key].dataType.simpleString()
    found = images.selectExpr(f"`{key}` key", f"`{media}` media").mapInArrow(run, f"key {kind}, height int, width int, tile binary, dhash string")
    return found.withColumnRenamed("key", own)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's padded UTF-8 bytes as a grey BMP or a PGM."""

    def run(batches):
        release()
        for whole in batches:
            for b in pieces(whole, "text"):
                n, media = [], []
                for text in b["text"].to_pylist():
                    raw = (text or "").encode()
                    n.append(len(raw))
                    units = max(1, -(-len(raw) // UNIT))
                    samples = np.full((units * UNIT // WIDTH, WIDTH), 255, np.uint8)
                    samples.ravel()[: len(raw)] = np.frombuffer(raw, np.uint8)
                    media.append(encode_pgm(samples) if units % 2 else encode_bmp(samples))
                yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_tiles(stored: DataFrame, size: int = TILE) -> DataFrame:
    """Of a stored media table (doc_id, n_bytes, media): digests of the decoded payload and of the stored form, the
    NPY tile of size x size and the difference hash; a media value that is no image is an error."""

    def run(batches):
        release()
        for whole in batches:
            for b in pieces(whole, "media"):
                out = []
                for data in b["media"].to_pylist():
                    image = decode(data)
                    if image is None:
                        raise BadImage("a stored image cannot be read back")
                    plane = grey(image)
                    payload = np.ascontiguousarray(plane).data
                    out.append((len(payload.cast("B")), sha256(payload).hexdigest(), zlib.crc32(payload.cast("B")[-32:]), len(data), sha256(data).hexdigest(), npy_tile(plane, size, size), difference_hash(plane)))
                columns = zip(*out, strict=True)
                yield pa.record_batch([b["doc_id"], b["n_bytes"], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"]
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: the difference hash and the CRC-32 of the written NPY tile, in hex, joined by a colon."""
    path = scratch_dir(spark)
    stored = materialize(text_media(table(spark, sf_dir, "documents")), f"{path}/media")
    tiles = materialize(media_tiles(stored), f"{path}/tiles")
    remove(spark, f"{path}/media")
    feature = F.concat_ws(":", "dhash", F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0"))
    return tiles.select(*tiles.columns[:7], feature.alias("feature"), F.octet_length("tile").cast("long").alias("tile_bytes"))
