"""Hamming distances by tiles of hashes, for distances at which bands of bits don't select.

Distinct hashes are dealt into blocks of ``TILE_ROWS``, and each pair of blocks is a group of its own: hashes * hashes
comparisons of 64 bits, spread over all tasks. A tile keeps a slice of distances at a time, and returns a row or fewer for each of
its hashes, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 16_384
MOST_PARTS = 4096
_ROWS, _COLUMNS = 256, 1024
_CLOSE = 8


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in x and y of hashes within the distance, a slice at a time."""
    for i in range(0, len(x), _ROWS):
        for j in range(0, len(y), _COLUMNS):
            row, column = np.nonzero(np.bitwise_count(x[i : i + _ROWS, None] ^ y[None, j : j + _COLUMNS]) <= distance)
            if len(row):
                yield row + i, column + j


def _adjacent(h: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the positions of hashes within the distance: of those that are close in the order of their rotated bits."""
    for shift in range(1, 64, 4):
        order = np.argsort(h << np.uint64(shift) | h >> np.uint64(64 - shift))
        x = h[order]
        for k in range(1, min(_CLOSE, len(x) - 1) + 1):
            at = np.flatnonzero(np.bitwise_count(x[:-k] ^ x[k:]) <= distance)
            yield order[at], order[at + k]


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _roots(h: np.ndarray, cut: int, distance: int) -> np.ndarray:
    """The least position of each hash's component. The first ``cut`` hashes are compared with the others, or, where there are
    no others, with each other.

    Two hashes that are both in the largest component so far are not compared: they are linked already. What is near in the order
    of some of their bits is linked first, so that most of a large component need no more.
    """
    n, own = len(h), cut == len(h)
    parent = np.arange(n)

    def find(nodes: np.ndarray) -> np.ndarray:
        to = parent[nodes]
        while True:
            onward = parent[to]
            if np.array_equal(onward, to):
                parent[nodes] = to
                return to
            to = onward

    def join(i: np.ndarray, j: np.ndarray) -> None:
        a, b = find(i), find(j)
        apart = a != b
        while apart.any():  # each root points at its least neighbour; at least one pair is joined each time
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(parent, high, low)
            a, b = find(low), find(high)
            apart = a != b

    for i, j in _adjacent(h, distance):
        join(i, j)
    for i in range(0, cut, _ROWS):
        rows, columns = np.arange(i, min(i + _ROWS, cut)), np.arange(i if own else cut, n)
        root = find(np.arange(n))
        large = np.bincount(root).argmax()
        inside = root[rows] == large
        for r, c in ((rows[inside], columns[root[columns] != large]), (rows[~inside], columns)):
            for x, y in _near(h[r], h[c], distance):
                join(r[x], c[y])
    return find(np.arange(n))


def _blocks(hashes: DataFrame, tile_rows: int) -> int:
    return max(1, -(-hashes.count() // tile_rows))


def _every(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _dealt(rows: DataFrame, tiles: int):
    """Groups of tiles; the count is given, as Spark would merge such small partitions."""
    return rows.repartition(min(tiles, MOST_PARTS), "p", "q").groupBy("p", "q")


def tile_links(unique: DataFrame, distance: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): edges with the components of all pairs of hashes within the distance. ``unique``: id, hash, each hash once.

    A tile links each of its rows to the least row of its component in the row's own block, and these two of a component to each
    other: tiles of one block repeat most links, so few more than the rows are left when they are made distinct.
    """
    blocks = _blocks(unique, tile_rows)
    own = F.pmod(F.xxhash64("hash"), F.lit(blocks))
    rows = unique.select("id", "hash", own.alias("own")).withColumn("other", _every(blocks))
    rows = rows.select("id", "hash", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("own", "ascending"), ("id", "ascending")]).combine_chunks()
        own, ids = t.column("own").to_numpy(), t.column("id")
        cut = int(np.searchsorted(own, own[0], "right"))
        root = _roots(_unsigned(t.column("hash")), cut, distance)
        of, first = np.unique(root[cut:], return_index=True)
        to = np.concatenate([root[:cut], cut + first[np.searchsorted(of, root[cut:])]])
        to[cut + first] = of  # the second block's least row of a component links to the first block's
        at = np.flatnonzero(to != np.arange(len(to)))
        return pa.table({"a": ids.take(pa.array(at)), "b": ids.take(pa.array(to[at]))})

    kind = unique.schema["id"].dataType.simpleString()
    return _dealt(rows, blocks * (blocks + 1) // 2).applyInArrow(run, f"a {kind}, b {kind}")


def tile_matches(left: DataFrame, right: DataFrame, distance: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(hash): those of ``left`` within the distance of one of ``right``; both have distinct hashes."""
    n, m = _blocks(left, tile_rows), _blocks(right, tile_rows)
    own = lambda k: F.pmod(F.xxhash64("hash"), F.lit(k))
    rows = left.select("hash", F.lit(True).alias("asks"), own(n).alias("p")).withColumn("q", _every(m))
    rows = rows.unionByName(right.select("hash", F.lit(False).alias("asks"), own(m).alias("q")).withColumn("p", _every(n)))

    def run(t: pa.Table) -> pa.Table:
        asks, h = t.column("asks").to_numpy(), _unsigned(t.column("hash"))
        x, y = h[asks], h[~asks]
        found = np.zeros(len(x), bool)
        for j in range(0, len(y), _COLUMNS):
            open_ = np.flatnonzero(~found)
            for i, _ in _near(x[open_], y[j : j + _COLUMNS], distance):
                found[open_[i]] = True
        return pa.table({"hash": pa.array(x[found].view(np.int64))})

    return _dealt(rows, n * m).applyInArrow(run, "hash long").distinct()
