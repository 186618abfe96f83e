"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images and
written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks

TILE = 8
WIDTH = 64
_PNM = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAX = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """uint8 (h, w, 3) as P6, (h, w) as P5."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """uint8 (h, w, 3) as 24-bit uncompressed BMP: rows from the bottom, BGR, padded to 4 bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = np.array([40, w, h], "<i4").tobytes() + np.array([1, 24], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 0, 0], "<i4").tobytes()
    return b"BM" + np.array([54 + rows.size, 0, 54], "<u4").tobytes() + head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1-P6 or BMP of 8 (palette), 24 or 32 bits -> uint8 (h, w) or (h, w, 3); ValueError otherwise."""
    if data[:2] == b"BM":
        if len(data) < 54:
            raise ValueError("short BMP")
        first, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
        w, h = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
        bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
        if packed or bits not in (8, 24, 32) or w <= 0:
            raise ValueError("unsupported BMP")
        line = (w * bits // 8 + 3) // 4 * 4
        if len(data) < first + line * abs(h):
            raise ValueError("short BMP")
        rows = np.frombuffer(data, np.uint8, line * abs(h), first).reshape(abs(h), line)[:, : w * bits // 8]
        rows = rows[::-1] if h > 0 else rows
        if bits == 8:
            colours = np.frombuffer(data, np.uint8, first - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
            return colours[rows]
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    m = _PNM.match(data)
    if not m:
        raise ValueError("neither Netpbm nor BMP")
    kind, w, h, at = m[1], int(m[2]), int(m[3]), m.end()
    top = 1
    if kind not in (b"P1", b"P4"):
        m = _MAX.match(data, at)
        if not m:
            raise ValueError("no sample maximum")
        top, at = int(m[1]), m.end()
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        raw = np.array(list(body.translate(None, b" \t\r\n\v\f")) if kind == b"P1" else body.split(), np.int64)[:n]
        raw = raw - 48 if kind == b"P1" else raw
    elif kind == b"P4":
        raw = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 1)[: h * ((w + 7) // 8)].reshape(h, -1), axis=1)[:, :w].reshape(-1)
    else:
        raw = np.frombuffer(data, np.uint8 if top < 256 else ">u2", -1, at + 1)[:n]
    if len(raw) < n:
        raise ValueError("short Netpbm")
    if kind in (b"P1", b"P4"):
        raw = 255 * (1 - raw)
    elif top != 255:
        raw = (raw.astype(np.int64) * 255 + top // 2) // top
    return raw.astype(np.uint8).reshape(shape)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) source areas, from one integral image; float64."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, *image.shape[2:]))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cuts(n, size):
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(int), size - 1)
        return low, (at - low).reshape(-1, *[1] * (image.ndim - 1))

    y, fy = cuts(height, h)
    x, fx = cuts(width, w)
    rows = total[y] * (1 - fy) + total[y + 1] * fy
    fx = fx.reshape(1, -1, *[1] * (image.ndim - 2))
    both = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return (both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 grey means larger than its left neighbour; 16 hex digits."""
    grey = image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """A side x side uint8 tile in NPY form."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tile_columns(images: DataFrame, side: int = TILE) -> DataFrame:
    """images (id long, data binary) -> id, height, width, channels, dhash, tile (NPY bytes), error.

    Null, empty or undecodable data give nulls and the reason in ``error``; no row fails a task, whatever
    its bytes.  Repeated rows and ids are decoded each for itself; an empty table gives no rows, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1):
                try:
                    image = decode(data.as_py() or b"")
                    if not image.size:
                        raise ValueError("no pixels")
                    rows.append((*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), npy_tile(image, side), None))
                except (ValueError, IndexError, OverflowError, TypeError, MemoryError) as e:
                    rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "height", "width", "channels", "dhash", "tile", "error"])

    return images.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, "id long, height int, width int, channels int, dhash string, tile binary, error string")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for big in batches for part in chunks(big)):
        rows = []
        for text in b.column(1):
            raw = (text.as_py() or "").encode()
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
            media = encode_bmp(image) if zlib.crc32(raw) & 1 else encode_ppm(image)
            back = decode(media)
            read = back.tobytes()
            rows.append((len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(back), npy_tile(back), media))
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in STORED.split(", ")])


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, media binary"


def text_as_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> each text's UTF-8 bytes, padded with spaces to a positive multiple of
    192, as the pixels of a 64-column RGB image (P6, or BMP where the text's CRC-32 is odd), read
    back and hashed, with its difference hash (feature) and NPY tile.  Null counts as empty; equal
    texts have equal values; null and repeated ids keep their rows, an empty table gives none; other
    columns are ignored.  A task holds one text at least, and some 40 bytes for each of its bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stored, STORED)


def op6_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile", "media")
