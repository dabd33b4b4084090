"""Iterative fits and linear algebra: each round is one aggregate; the driver only sees its few numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.metrics import tempered


def fit_temperature(probs: DataFrame, rounds: int = 40) -> float:
    """The temperature of least cross-entropy, by Newton's method on s = 1 / T, where it is convex."""
    z = F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-6)))
    base = probs.withColumn("z", z).cache()
    s = 1.0
    try:
        for _ in range(rounds):
            q = tempered(base, 1.0 / s)
            m = q.groupBy("id").agg(F.sum(F.col("p") * F.col("z")).alias("m"), F.sum(F.col("p") * F.col("z") * F.col("z")).alias("m2"), F.sum(F.when(F.col("y") == F.col("cls"), F.col("z"))).alias("zy"))
            g, h = m.agg(F.avg(F.col("m") - F.col("zy")), F.avg(F.col("m2") - F.col("m") * F.col("m"))).first()
            if g is None or not h or not math.isfinite(g) or not math.isfinite(h):
                return 1.0
            step = max(-0.5 * s, min(s, g / h))
            s = min(100.0, max(1e-3, s - step))
            if abs(step) < 1e-9 * s:
                break
    finally:
        base.unpersist()
    return min(1e3, max(1e-2, 1.0 / s))


def fit_evidence_scale(probs: DataFrame, low: float = 1e-3, high: float = 1e3, rounds: int = 60) -> float:
    """The scale of least NLL of the Dirichlet mean: golden section on its logarithm."""
    classes = probs.select("cls").distinct().count()
    own = probs.where("y = cls").select("p").cache()
    try:
        loss = lambda l: own.agg(F.avg(-F.log((F.lit(l) * F.col("p") + 1) / (l + classes)))).first()[0]
        a, b, ratio = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = loss(math.exp(c)), loss(math.exp(d))
        if fc is None:
            return 1.0
        for _ in range(rounds):
            if b - a < 1e-4:
                break
            if fc < fd:
                b, d, fd = d, c, fc
                c = b - ratio * (b - a)
                fc = loss(math.exp(c))
            else:
                a, c, fc = c, d, fd
                d = a + ratio * (b - a)
                fd = loss(math.exp(d))
        return math.exp((a + b) / 2)
    finally:
        own.unpersist()


def gram(vectors: DataFrame, column: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and d * d sum of products: one partial a partition, so only d * d numbers a task move."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1)
                n += len(x)
                s, g = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), g + x.T @ x)
        if n:
            k = np.arange(len(s) + g.size)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.concatenate([s, g.ravel()])), pa.array(np.where(k == 0, n, 0))], names=["k", "x", "n"])

    rows = vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "k long, x double, n long").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").toPandas()  # d * d + d rows
    x = rows["x"].to_numpy()
    d = int((math.isqrt(1 + 4 * len(x)) - 1) // 2)
    return int(rows["n"].sum()), x[:d], x[d:].reshape(d, d)


def effective_rank(vectors: DataFrame, column: str = "v") -> float:
    """exp of the entropy of the centred matrix' normalised singular values, from its Gram matrix."""
    n, s, g = gram(vectors, column)
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(g - np.outer(s, s) / n), 0))
    p = values / max(values.sum(), 1e-12)
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def sigreg(vectors: DataFrame, directions: list[list[float]], points: list[float], column: str = "v") -> DataFrame:
    """(dir, t, re, im): the empirical characteristic function of the vectors' projections, and a normal's value."""
    from tarnlake.functions.scalars import dot, doubles

    dirs = vectors.sparkSession.createDataFrame([(i, d) for i, d in enumerate(directions)], "dir int, u array<double>")
    proj = vectors.join(F.broadcast(dirs), F.lit(True)).select("dir", dot(doubles(F.col(column)), F.col("u")).alias("x"), F.explode(F.array(*map(F.lit, points))).alias("t"))  # a few fixed directions
    return proj.groupBy("dir", "t").agg(F.avg(F.cos(F.col("t") * F.col("x"))).alias("re"), F.avg(F.sin(F.col("t") * F.col("x"))).alias("im")).withColumn("normal", F.exp(-F.col("t") * F.col("t") / 2))


def variance_hinge(vectors: DataFrame, column: str = "v", eps: float = 1e-4) -> DataFrame:
    """Mean over dimensions of max(0, 1 - sqrt(var + eps))."""
    per = vectors.select(F.posexplode(F.col(column).cast("array<double>")).alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("v"))
    return per.agg(F.avg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.col("v") + eps))).alias("hinge"))
