"""Vectorised word, shingle and window hashing over Arrow string columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; nulls count as empty texts. All arithmetic is on whole
arrays of bytes or words, so no Python statement runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are taken in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


#: Folds of labelled rows; those of fold 0 are held out of every fit.
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a slice of texts. ``doc`` is each word's text; text d owns words first[d]:first[d+1]."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these lie in one text."""
        n = len(self.hash)
        valid = np.arange(n) + k <= self.first[self.doc + 1] if n else np.zeros(0, bool)
        return mix(_run(self.hash, k)), valid


def _run(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of k consecutive entries, by doubling; entries past the end count as 0."""
    shift = lambda a, m: np.concatenate([a[m:], np.zeros(min(m, len(a)), np.uint64)])
    step = powers(_STEP, k + 1)
    done, have, part, size = None, 0, h, 1
    while True:
        if k & size:
            done = part.copy() if done is None else done * step[size] + shift(part, have)
            have += size
        size *= 2
        if size > k:
            return done
        part = part * step[size // 2] + shift(part, size // 2)


def words_of(texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """The words of texts; ``apart`` marks the bytes between words."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, z, z, z, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64))
    space = apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    start = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    end = np.flatnonzero(~space & after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    if not len(start):
        return Words(data, offsets, start, end, doc, first, np.zeros(0, np.uint64))
    at = np.arange(n, dtype=np.int64)
    at -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [n]])))
    value = data.astype(np.uint64) + np.uint64(1)
    value[space] = 0
    longest = int((end - start).max())
    power = powers(_BASE, longest + 1)
    value *= power[np.minimum(at, longest)]
    value[: start[0]] = 0
    return Words(data, offsets, start, end, doc, first, mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64)))


def release() -> None:
    """Give freed memory back at the end of a task: Python workers are kept and serve operators of other needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        part = np.cumsum(size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)
    release()
