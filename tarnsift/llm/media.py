"""Texts as PNG images in a binary column, read back with checksum tests, and low-frequency cosine hashes of them.

Edge cases: a null or empty text is one row of padding. Equal texts, repeated rows too, give equal bytes; bytes that are no UTF-8 are kept as they are. An empty table gives no rows; further columns are ignored. A damaged chunk, a wrong checksum, an unknown filter or a wrong length raises ValueError. Very long texts are tall images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mapped, table

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PAD = 255
SIDE, LOW = 32, 8


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text with bytes 255 up to a positive multiple of the unit."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // unit)) * unit - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """8-bit greyscale PNG. Each row takes the filter (none or up) with the lesser sum of magnitudes."""
    height, width = pixels.shape
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    cost = lambda x: np.minimum(x, 0 - x).sum(axis=1, dtype=np.int64)
    use = cost(up) < cost(pixels)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = use * 2
    rows[:, 1:] = np.where(use[:, None], up, pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters for one byte a pixel. Rows of none, sub and up are whole-array sums; average and Paeth go pixel by pixel."""
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    if (kinds <= 2).all():
        # Runs of up-filtered rows add up from the row before them.
        base = np.maximum.accumulate(np.where(kinds == 2, -1, np.arange(len(kinds))))
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        before = np.where((base > 0)[:, None], total[base - 1], 0).astype(np.uint8)
        return np.where((kinds == 2)[:, None], total - before, out)
    last = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        if kind == 2:
            out[y] = rows[y] + last
        elif kind > 2:
            line, above = rows[y].tolist(), last.tolist()
            for x in range(len(line)):
                left = line[x - 1] if x else 0
                guess = (left + above[x]) // 2 if kind == 3 else _paeth(left, above[x], above[x - 1] if x else 0)
                line[x] = (line[x] + guess) & 255
            out[y] = line
        last = out[y]
    return out


def decode(png: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("chunk cut short")
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no end, or not 8-bit greyscale without interlace")
    width, height = head[:2]
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong length")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_BASIS = _cosines(SIDE, LOW)


def shrink(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Mean brightness over side x side cells; cells of fewer rows than one repeat the nearest row."""
    height, width = pixels.shape
    y = np.arange(side) * height // side
    y_end = np.maximum(y + 1, (np.arange(side) + 1) * height // side)
    x = np.arange(side + 1) * width // side
    columns = np.add.reduceat(pixels, x[:-1], axis=1, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, side), np.int64), np.cumsum(columns, axis=0)])
    return (sums[y_end] - sums[y]) / ((y_end - y)[:, None] * np.diff(x)[None, :])


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: which low-frequency cosine terms exceed their median; the constant term is left out of the median."""
    low = np.round(_BASIS @ shrink(pixels) @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_bytes and the PNG in binary column media."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = encoded(b)
            png = [encode(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(png, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, n_bytes long, media binary")


def features(stored: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Reads each stored image back: payload length, its SHA-256, the CRC-32 of its last 32 bytes, the image's length and SHA-256, and its cosine hash."""
    kind = stored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for png in b.column("media").to_pylist():
                pixels = decode(png)
                back = pixels.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *map(pa.array, columns, types)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(F.col(key).alias("doc_id"), "n_bytes", F.col(media).alias("media")).transform(mapped, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
