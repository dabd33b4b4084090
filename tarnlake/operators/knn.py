"""k-nearest-neighbour join by cosine, and weighted votes.

The references are shipped to the query scan if they are at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` of
numbers, else both sides are dealt into blocks and each (query block, reference block) yields partial top-k lists, which
a window merges. The search is exact, so every query meets every reference: blocks cost queries * references * numbers
multiplications, spread over all tasks, but only k rows a query and block move; no pair table is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import materialize

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 50_000
SLICE_BYTES = 16 << 20
_SCHEMA = "id long, y int, ref_id long, ref_y int, sim double"


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Rows of a list column over their norm + 1e-12; NaN and infinities count as 0."""
    n = len(lists)
    x = np.asarray(lists.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def slice_rows(references: int) -> int:
    """Queries whose similarities to all these references take ``SLICE_BYTES``; finding the best of them takes three times that."""
    return max(1, SLICE_BYTES // (8 * max(1, references)))


def top_k(q: np.ndarray, r: np.ndarray, ref_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k most similar of r (similarity down, then id up): positions and similarities."""
    k = min(k, len(r))
    sim = q @ r.T
    if k < len(r):
        bar = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]  # ties at the bar are settled by id below
    else:
        bar = np.full((len(q), 1), -np.inf)
    above = sim >= bar
    row, at = np.nonzero(above)
    val = sim[row, at]
    order = np.lexsort((ref_id[at], -val, row))
    row, at, val = row[order], at[order], val[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    keep = (begin[:, None] + np.arange(k)).ravel()  # ties at the bar come after these
    return at[keep].reshape(len(q), k), val[keep].reshape(len(q), k)


def _neighbours(ids, y, q, ref_ids, ref_y, r, k) -> Iterator[pa.RecordBatch]:
    rows = slice_rows(len(r))
    for s in range(0, len(ids), rows):
        at, val = top_k(q[s : s + rows], r, ref_ids, k)
        n, kk = at.shape
        rep = lambda a: np.repeat(a[s : s + rows], kk)
        yield pa.RecordBatch.from_arrays([pa.array(rep(ids)), pa.array(rep(y).astype(np.int32)), pa.array(ref_ids[at].ravel()), pa.array(ref_y[at].ravel().astype(np.int32)), pa.array(val.ravel())], names=["id", "y", "ref_id", "ref_y", "sim"])


def knn_join(query: DataFrame, reference: DataFrame, k: int, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, y, ref_id, ref_y, sim, rank): the k nearest references of each query. Both sides: id, y, v."""
    q, r = (d.select(F.col("id").cast("long"), F.col("y").cast("int"), "v") for d in (query, reference))
    n, numbers = r.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if not n:
        return query.sparkSession.createDataFrame([], _SCHEMA + ", rank int")
    if n <= broadcast_rows and 8 * numbers <= BROADCAST_BYTES:
        t = r.toArrow().combine_chunks()  # at most broadcast_rows rows and BROADCAST_BYTES
        own = q.sparkSession.sparkContext.broadcast((t.column("id").to_numpy(), t.column("y").to_numpy(), unit_rows(t.column("v").chunk(0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from _neighbours(b.column(0).to_numpy(), b.column(1).to_numpy(), unit_rows(b.column(2)), *own.value, k)

        found = q.mapInArrow(run, _SCHEMA)
    else:
        blocks = -(-n // block_rows)
        parts = max(1, -(-q.count() // block_rows))
        left = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        right = r.select(*[F.col(c).alias(f"r_{c}") for c in ("id", "y", "v")])  # new names: both sides may come from one table
        right = right.withColumn("block", F.pmod(F.xxhash64("r_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("y", pa.int32()), ("ref_id", pa.int64()), ("ref_y", pa.int32()), ("sim", pa.float64()))})
            a, b = a.combine_chunks(), b.combine_chunks()
            v = lambda t, c: unit_rows(t.column(c).chunk(0))
            return pa.Table.from_batches(_neighbours(a.column("id").to_numpy(), a.column("y").to_numpy(), v(a, "v"), b.column("r_id").to_numpy(), b.column("r_y").to_numpy(), v(b, "r_v"), k))

        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(both, _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_naive(query: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """The same by a join of all pairs and a window; for tests and the bench only."""
    from tarnlake.functions.scalars import dot, doubles, l2_normalise

    q = query.select("id", "y", l2_normalise(doubles(F.col("v"))).alias("a"))
    r = reference.select(F.col("id").alias("ref_id"), F.col("y").alias("ref_y"), l2_normalise(doubles(F.col("v"))).alias("b"))
    s = q.join(r, F.lit(True)).select("id", "y", "ref_id", "ref_y", dot(F.col("a"), F.col("b")).alias("sim"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "ref_id"))).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, k: int, tau: float) -> DataFrame:
    """(id, y, cls, vote): softmax weights of the first k neighbours, summed by class."""
    n = neighbours.where(F.col("rank") <= k)
    w = F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("id"))) / tau)
    return n.withColumn("w", w).groupBy("id", "y", F.col("ref_y").alias("cls")).agg(F.sum("w").alias("vote"))


def probabilities(vote: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, y, cls, p) over the full id by class grid; ``classes`` (column cls) is the short class list."""
    line = classes.agg(F.sort_array(F.collect_set("cls")).alias("line"))  # one row, an entry a class
    every = vote.select("id", "y").distinct().join(line, F.lit(True)).select("id", "y", F.explode("line").alias("cls"))
    total = F.sum("vote").over(Window.partitionBy("id"))
    dense = every.join(vote.select("id", "cls", "vote"), ["id", "cls"], "left").withColumn("vote", F.coalesce("vote", F.lit(0.0)))
    return dense.select("id", "y", "cls", (F.col("vote") / F.greatest(total, F.lit(1e-7))).alias("p"))


def k_sweep(neighbours: DataFrame, ks: tuple[int, ...], tau: float) -> DataFrame:
    """(k, acc) for every k from one neighbour list: the softmax is renewed over each k's own neighbours."""
    each = neighbours.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    w = F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("k", "id"))) / tau)
    vote = each.withColumn("w", w).groupBy("k", "id", "y", "ref_y").agg(F.sum("w").alias("vote"))
    best = vote.groupBy("k", "id", "y").agg(F.max_by("ref_y", F.struct("vote", -F.col("ref_y"))).alias("pred"))
    return best.groupBy("k").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"))


def knn_probs(query: DataFrame, reference: DataFrame, k: int = 20, tau: float = 0.07) -> DataFrame:
    neighbours = materialize(knn_join(query, reference, k), "neighbours")
    classes = reference.select(F.col("y").cast("int").alias("cls")).distinct()
    return probabilities(votes(neighbours, k, tau), classes)
