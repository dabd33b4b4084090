"""Baseline JPEG decoding: Huffman codes in Python, everything after them (dequantisation, inverse DCT, colours) on
whole arrays. Progressive, lossless, arithmetic-coded and four-channel files are told apart and not decoded."""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np


class Unsupported(ValueError):
    """A JPEG of a kind that isn't decoded here."""


#: Places of coefficients in the order of their transmission.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K, _I = np.arange(8)[:, None], np.arange(8)[None, :]
_IDCT = np.cos(math.pi * _K * (2 * _I + 1) / 16) * np.where(_K == 0, math.sqrt(1 / 8), 0.5)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Frame:
    width: int
    height: int
    parts: list[Component]

    def mcus(self) -> tuple[int, int]:
        """Columns and rows of coding units."""
        h, v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For the next 16 bits: the code's length (times 256) and its symbol; 0 where there is no such code."""
    out, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            begin = code << (16 - length)
            if begin >= 65536:
                raise ValueError("more codes than there is room for")
            span = 1 << (16 - length)
            out[begin : begin + span] = [length << 8 | s] * span
            code += 1
        at += n
        code <<= 1
    return out


class Bits:
    """Bits of a stretch of coded data, first bit highest; reading past the end raises."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 8]
        self.at += 8
        if not more and self.at > len(self.data) + 16:
            raise EOFError
        more = more.ljust(8, b"\0")  # codes at the very end may look a little further
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(more, "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise EOFError
        self.n -= found >> 8
        return found & 255

    def number(self, size: int) -> int:
        """A coefficient of ``size`` bits; numbers that begin with 0 are negative."""
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _stretch(bits: Bits, frame: Frame, coders: dict, first: int, count: int) -> None:
    """The coding units from ``first`` on; differences of mean values begin anew."""
    columns, _ = frame.mcus()
    before = [0] * len(frame.parts)
    for unit in range(first, first + count):
        y, x = divmod(unit, columns)
        for k, c in enumerate(frame.parts):
            dc, ac = coders[0, c.dc], coders[1, c.ac]
            for i in range(c.v):
                for j in range(c.h):
                    block = c.blocks[y * c.v + i, x * c.h + j]
                    size = bits.symbol(dc)
                    if size:
                        before[k] += bits.number(size)
                    block[0] = before[k]
                    at = 1
                    while at < 64:
                        s = bits.symbol(ac)
                        run, size = s >> 4, s & 15
                        if not size:
                            if run < 15:
                                break
                            at += 16
                            continue
                        at += run
                        if at > 63:
                            raise EOFError
                        block[at] = bits.number(size)
                        at += 1


def _plane(c: Component, table: np.ndarray, frame: Frame) -> np.ndarray:
    """The component's samples at the size of the picture."""
    rows, columns, _ = c.blocks.shape
    full = np.zeros((rows, columns, 64))
    full[:, :, ZIGZAG] = c.blocks * table
    pixels = _IDCT.T @ full.reshape(rows, columns, 8, 8) @ _IDCT
    plane = np.clip(np.rint(pixels + 128), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    h, v = max(p.h for p in frame.parts) // c.h, max(p.v for p in frame.parts) // c.v
    return plane.repeat(v, 0).repeat(h, 1)[: frame.height, : frame.width]


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """Pixels (height, width, 1 or 3) and whether the coded data was whole. Broken files raise ValueError."""
    at, tables, coders, frame, interval, adobe = 2, {}, {}, None, 0, None
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            raise ValueError("no picture")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0 or kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            raise ValueError("no picture")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                tables[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                coders[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            frame = _frame(body)
        elif 0xC2 <= kind <= 0xCF and kind != 0xCC:
            raise Unsupported("not a baseline JPEG")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            adobe = body[11]
        elif kind == 0xDA:
            break
    if frame is None or body[0] != len(frame.parts):
        raise Unsupported("components in scans of their own") if frame else ValueError("no frame")
    for k, c in enumerate(frame.parts):
        if c.id != body[1 + 2 * k]:
            raise ValueError("components in another order")
        c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
    whole = _scan(data[at:], frame, coders, interval)
    planes = [_plane(c, tables[c.table], frame) for c in frame.parts]
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[:, :, None], whole
    y, b, r = planes
    if adobe != 0:
        b, r = b - 128, r - 128
        y, b, r = y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b
    return np.clip(np.rint(np.stack([y, b, r], 2)), 0, 255).astype(np.uint8), whole


def _frame(body: bytes) -> Frame:
    depth, height, width, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or n not in (1, 3) or not height:
        raise Unsupported("not of one or three components of 8 bits")
    if not width or len(body) < 6 + 3 * n:
        raise ValueError("no size")
    parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    if n == 1:
        parts[0].h = parts[0].v = 1  # a single component's units are blocks
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    if any(not c.h or not c.v or h % c.h or v % c.v for c in parts):
        raise Unsupported("odd sampling factors")
    frame = Frame(width, height, parts)
    columns, rows = frame.mcus()
    if columns * rows > 1 << 22:
        raise Unsupported("too large a picture")
    for c in parts:
        c.blocks = np.zeros((rows * c.v, columns * c.h, 64), np.int32)
    return frame


def _scan(coded: bytes, frame: Frame, coders: dict, interval: int) -> bool:
    """Decode up to the next marker; restart markers part the data. False where it ends too early."""
    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", coded)
    coded = coded[: end.start()] if end else coded
    columns, rows = frame.mcus()
    left, first = columns * rows, 0
    for stretch in re.split(rb"\xff+[\xd0-\xd7]", coded) if interval else [coded]:
        count = min(interval or left, left)
        if not count:
            break
        try:
            _stretch(Bits(stretch.replace(b"\xff\x00", b"\xff")), frame, coders, first, count)
        except (EOFError, KeyError):
            return False
        first, left = first + count, left - count
    return not left
