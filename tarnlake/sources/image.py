"""Decoding of PNG, baseline JPEG and BMP, perceptual hash, pixel statistics, resizing and masks with numpy; and the same
as columns of tables, over Arrow batches.

Statuses: ``ok``; ``truncated`` (rows or blocks are missing, and are zeros); ``unreadable`` (no picture, or a broken
one); ``unsupported`` (a format or kind that isn't decoded here, which says nothing about the file)."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.sources import jpeg


@dataclass
class Decoded:
    width: int = 0
    height: int = 0
    mode: str = ""
    pixels: np.ndarray | None = None
    status: str = "unreadable"


_CHANNELS = {0: ("L", 1), 2: ("RGB", 3), 4: ("LA", 2), 6: ("RGBA", 4)}


#: A picture's bytes after decoding, at most; larger ones count as unsupported.
MAX_PIXEL_BYTES = 1 << 29


def decode(data: bytes) -> Decoded:
    """A picture of any format, by its first bytes."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(data)
    if data.startswith(b"\xff\xd8\xff"):
        return _jpeg(data)
    if data.startswith(b"BM"):
        return _bmp(data)
    other = data.startswith((b"GIF8", b"II*\0", b"MM\0*")) or data.startswith(b"RIFF") and data[8:12] == b"WEBP"
    return Decoded(status="unsupported") if other else Decoded()


def _jpeg(data: bytes) -> Decoded:
    try:
        pixels, whole = jpeg.decode(data)
    except jpeg.Unsupported:
        return Decoded(status="unsupported")
    except (ValueError, IndexError, KeyError, struct.error):
        return Decoded()
    h, w, c = pixels.shape
    return Decoded(w, h, "L" if c == 1 else "RGB", pixels, "ok" if whole else "truncated")


def _bmp(data: bytes) -> Decoded:
    """Uncompressed, of 8 (with a palette), 24 or 32 bits."""
    if len(data) < 54:
        return Decoded()
    start, head, w, h, _, depth, packed = struct.unpack("<10xIIiiHHI", data[:34])
    up, h = h > 0, abs(h)
    if not w > 0 or not h:
        return Decoded()
    if head < 40 or depth not in (8, 24, 32) or packed not in (0, 3) or w * h * 4 > MAX_PIXEL_BYTES:
        return Decoded(status="unsupported")
    stride = (w * depth + 31) // 32 * 4
    body = data[start : start + stride * h]
    rows = len(body) // stride
    if not rows:
        return Decoded(w, h, "RGB")
    raw = np.zeros((h, stride), np.uint8)
    raw[:rows] = np.frombuffer(body, np.uint8, rows * stride).reshape(rows, stride)
    raw = raw[::-1] if up else raw
    if depth == 8:
        palette = np.frombuffer(data[14 + head : start][:1024].ljust(1024, b"\0"), np.uint8).reshape(256, 4)
        out = palette[raw[:, :w]][:, :, 2::-1]
    else:
        out = raw[:, : w * depth // 8].reshape(h, w, depth // 8)[:, :, 2::-1]
    return Decoded(w, h, "RGB", np.ascontiguousarray(out), "ok" if rows == h else "truncated")


def _png(data: bytes) -> Decoded:
    """8 bits a channel, not interlaced."""
    at, raw, w = 8, [], 0
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR" and len(body) == 13:
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if not w or not h:
                return Decoded()
            if depth != 8 or color not in _CHANNELS or interlace or w * h * 4 > MAX_PIXEL_BYTES:
                return Decoded(status="unsupported")
        elif kind == b"IDAT":
            raw.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if not w:
        return Decoded()
    mode, c = _CHANNELS[color]
    stride = w * c
    try:
        flat = zlib.decompressobj().decompress(b"".join(raw), h * (stride + 1))  # never more than the picture has
    except zlib.error:
        return Decoded(w, h, mode)
    out, before = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    rows = min(h, len(flat) // (stride + 1))
    for y in range(rows):
        kind, line = flat[y * (stride + 1)], np.frombuffer(flat, np.uint8, stride, y * (stride + 1) + 1)
        out[y] = before = _unfilter(kind, line, before, c)
    if not rows:
        return Decoded(w, h, mode)
    return Decoded(w, h, mode, out.reshape(h, w, c), "ok" if rows == h else "truncated")


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + up
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out, u, x = [0] * len(line), up.tolist(), line.tolist()
    for i in range(len(x)):
        left, top, corner = (out[i - c] if i >= c else 0), u[i], (u[i - c] if i >= c else 0)
        if kind == 3:
            guess = (left + top) // 2
        else:
            p = left + top - corner
            a, b, d = abs(p - left), abs(p - top), abs(p - corner)
            guess = left if a <= b and a <= d else top if b <= d else corner
        out[i] = (x[i] + guess) & 255
    return np.array(out, np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of (h, w, 1 or 3) bytes; for fixtures and re-encoding."""
    h, w, c = pixels.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def rgb(pixels: np.ndarray) -> np.ndarray:
    c = pixels.shape[2]
    return np.repeat(pixels[:, :, :1], 3, 2) if c < 3 else pixels[:, :, :3]


def gray(pixels: np.ndarray) -> np.ndarray:
    """Whole gray values, 0 to 255."""
    return np.rint(rgb(pixels).astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def area_resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Each output pixel is the mean of the input area under it."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = edge[:-1, None], edge[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None)
        return cover / cover.sum(1, keepdims=True)

    return weights(x.shape[0], h) @ x @ weights(x.shape[1], w).T


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(math.pi * k * (2 * i + 1) / (2 * n))


_DCT = dct_matrix(32)


def phash(pixels: np.ndarray) -> str:
    """64 bits as hex: low frequencies of a 32 x 32 gray image over their median."""
    low = (_DCT @ area_resize(gray(pixels), 32, 32) @ _DCT.T)[:8, :8]
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).ravel()), 2):016x}"


def statistics(pixels: np.ndarray) -> dict[str, float]:
    """Mean, standard deviation, dark and bright shares of the gray image, and colourfulness."""
    g, c = gray(pixels), rgb(pixels).astype(np.float64)
    rg, yb = c[:, :, 0] - c[:, :, 1], 0.5 * (c[:, :, 0] + c[:, :, 1]) - c[:, :, 2]
    colour = math.hypot(rg.std(), yb.std()) + 0.3 * math.hypot(rg.mean(), yb.mean())
    return {"mean": float(g.mean()), "std": float(g.std()), "dark": float((g < 12).mean()), "bright": float((g > 243).mean()), "colour": colour}


def mask_grid(mask: np.ndarray, grid: int) -> np.ndarray:
    """Share of pixels over 127 in each cell, as a binary grid."""
    return (area_resize((mask > 127).astype(np.float64), grid, grid) > 0.5).astype(np.int8)


def upsample(grid: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def weights(n: int, m: int) -> np.ndarray:
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(x.astype(int), n - 1)
        hi, f, out = np.minimum(lo + 1, n - 1), x - lo, np.zeros((m, n))
        out[np.arange(m), lo] += 1 - f
        out[np.arange(m), hi] += f
        return out

    return weights(grid.shape[0], size) @ grid @ weights(grid.shape[1], size).T


def resized(pixels: np.ndarray, size: int) -> np.ndarray:
    """The short side brought down to ``size`` and never up, no side under it; each new pixel is the mean of its area."""
    h, w = pixels.shape[:2]
    scale = size / min(w, h)
    if scale >= 1:
        return pixels
    nw, nh = max(size, round(w * scale)), max(size, round(h * scale))
    planes = [area_resize(pixels[:, :, k].astype(np.float64), nh, nw) for k in range(pixels.shape[2])]
    return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8)


# --- columns --------------------------------------------------------------------------------------------------------

FACTS = "status string, width int, height int, mode string, phash string, mean double, std double, dark double, bright double, colour double"
#: Pictures that a worker holds at once.
SLICE = 32


def _mapped(rows: DataFrame, one: Callable, schema: str, payload: str) -> DataFrame:
    """``rows`` without the payload and with what ``one`` makes of it, as columns of ``schema``."""
    kept = [c for c in rows.columns if c != payload]
    names = [x.split()[0] for x in schema.split(", ")]
    whole = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), schema])
    from pyspark.sql.types import StructType

    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                part = b.slice(a, SLICE)
                found = [one(x) for x in part.column(len(kept)).to_pylist()]
                new = [pa.array([f.get(n) for f in found], made.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *names])

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(payload)).mapInArrow(run, whole)


def _facts(payload: bytes | None) -> dict:
    d = decode(payload or b"")
    out = {"status": d.status, "width": d.width, "height": d.height, "mode": d.mode, "phash": ""}
    return out if d.pixels is None else out | {"phash": phash(d.pixels)} | statistics(d.pixels)


def with_facts(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Decode status, true size, mode, perceptual hash and intensity statistics of each picture (FACTS)."""
    return _mapped(rows, _facts, FACTS, payload)


def with_resized(rows: DataFrame, size: int, payload: str = "payload") -> DataFrame:
    """Each picture as a PNG of at most the short side ``size`` (payload), with its new size; null where it can't be decoded."""

    def one(x: bytes | None) -> dict:
        d = decode(x or b"")
        if d.pixels is None:
            return {"payload": None, "width": 0, "height": 0}
        small = resized(rgb(d.pixels), size)
        return {"payload": encode(small), "width": small.shape[1], "height": small.shape[0]}

    return _mapped(rows, one, "payload binary, width int, height int", payload)


def with_mask_grid(rows: DataFrame, grid: int = 14, size: int = 224, payload: str = "payload") -> DataFrame:
    """A mask picture as a binary grid of ``grid`` cells a side (grid, by rows) and its share of foreground when the grid
    is brought to ``size`` pixels again (share)."""

    def one(x: bytes | None) -> dict:
        d = decode(x or b"")
        if d.pixels is None:
            return {"grid": None, "share": None}
        g = mask_grid(gray(d.pixels), grid)
        return {"grid": g.ravel().tolist(), "share": float((upsample(g.astype(float), size) > 0.5).mean())}

    return _mapped(rows, one, "grid array<tinyint>, share double", payload)
