import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import fits, knn, metrics, splits
from tarnlake.operators.lake import batch_sizes


def long_probs(spark, p, y):
    return spark.createDataFrame([(i, int(y[i]), c, float(p[i, c])) for i in range(len(y)) for c in range(p.shape[1])], "id long, y int, cls int, p double")


def sampled(n=1500, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 3)) * 1.5
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    s = np.exp(z * scale)
    return s / s.sum(1, keepdims=True), y


def numpy_ece(p, y, bins=15):
    conf, hit = p.max(1), p.argmax(1) == y
    edge, out = np.linspace(0, 1, bins + 1), 0.0
    for i, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)):
        m = (conf >= lo if i == 0 else conf > lo) & (conf <= hi)
        if m.any():
            out += m.mean() * abs(hit[m].mean() - conf[m].mean())
    return out


def test_calibrated_probabilities_have_low_ece(spark):
    p, y = sampled()
    got = metrics.ece(metrics.reliability(metrics.predictions(long_probs(spark, p, y)), 15)).first()[0]
    assert got == pytest.approx(numpy_ece(p, y), abs=1e-9)
    assert got < 0.05


def test_temperature_of_overconfident_probabilities(spark):
    p, y = sampled(scale=4.0)
    d = long_probs(spark, p, y)
    t = fits.fit_temperature(d)
    assert 3.0 < t < 5.0
    before, after = (x.agg(metrics.nll(None)).first()[0] for x in (d, metrics.tempered(d, t)))
    assert after < before


def test_nll_of_certain_errors_is_finite(spark):
    d = long_probs(spark, np.array([[1.0, 0, 0], [0, 1.0, 0]]), [1, 0])
    assert math.isfinite(d.agg(metrics.nll(None)).first()[0])


def test_tied_confidences_share_one_adaptive_bin(spark):
    d = long_probs(spark, np.full((4, 2), 0.5), [0, 1, 0, 1])
    assert metrics.adaptive_bins(metrics.predictions(d), 15).count() == 1


def blobs(spark, n=300):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(3, 16)) * 5
    y = np.repeat(np.arange(3), n // 3)
    x = centre[y] + rng.normal(size=(n, 16))
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "id long, y int, v array<double>")


def test_knn_on_blobs(spark):
    b = blobs(spark)
    p = knn.knn_probs(b.where("id % 3 = 0"), b.where("id % 3 <> 0"), 20, 0.1).cache()
    sums = p.groupBy("id").agg(F.sum("p").alias("s"), F.min("p").alias("m")).agg(F.min("s"), F.max("s"), F.min("m")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and sums[2] >= 0
    assert metrics.predictions(p).agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0] > 0.9
    d = metrics.dirichlet(p, 5.0).agg(F.min("alpha"), F.max("vacuity"), F.min("vacuity")).first()
    assert d[0] >= 1 and 0 < d[2] <= d[1] <= 1
    assert fits.fit_evidence_scale(p) > 0


@pytest.mark.parametrize("limits", [{"broadcast_rows": 10, "block_rows": 37}, {}])
def test_knn_join_is_the_naive_join(spark, limits):
    b = blobs(spark, 150)
    q, r = b.where("id % 4 = 0"), b.where("id % 4 <> 0")
    key = lambda d: sorted((x.id, x.rank, x.ref_id) for x in d.select("id", "rank", "ref_id").collect())
    assert key(knn.knn_join(q, r, 7, **limits)) == key(knn.knn_naive(q, r, 7))


def test_knn_slices_are_bounded_by_bytes():
    """2,048 queries against 20,000 references took 330 MB for their similarities alone, and copies of that."""
    rng = np.random.default_rng(0)
    q, r, ids = rng.normal(size=(2048, 8)), rng.normal(size=(20_000, 8)), np.arange(20_000)
    y = np.zeros(len(r), np.int32)
    tracemalloc.start()
    n = sum(b.num_rows for b in knn._neighbours(np.arange(len(q)), y[: len(q)], q, ids, y, r, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5 * len(q) and peak < 6 * knn.SLICE_BYTES
    assert all(knn.slice_rows(m) * 8 * m <= knn.SLICE_BYTES for m in (1, 50_000, 1_000_000))


def test_knn_without_references(spark):
    b = blobs(spark, 30)
    assert knn.knn_join(b, b.where("false"), 5).count() == 0


def test_effective_rank(spark):
    rng = np.random.default_rng(0)
    full, one = rng.normal(size=(256, 32)), np.outer(rng.normal(size=256), rng.normal(size=32))
    make = lambda m: spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>")
    assert fits.effective_rank(make(full)) > 20
    assert fits.effective_rank(make(one)) < 3
    assert fits.variance_hinge(make(full)).first()[0] < 0.1
    assert fits.variance_hinge(make(full * 0.01)).first()[0] > 0.5


def test_batch_sizes():
    assert batch_sizes(9, 4) == [4, 5] and batch_sizes(10, 4) == [4, 4, 2]
    with pytest.raises(ValueError):
        batch_sizes(1, 4)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 12, 13, 100])
def test_split_sizes(spark, n):
    d = spark.range(n).select(F.col("id"), F.lit("a").alias("y"))
    got = {r.split: r["count"] for r in splits.stratified_split(d, "y", "id").groupBy("split").count().collect()}
    ref = min(n, max(1, round(0.6 * n)))
    cal = min(n - ref, round(0.15 * n))
    assert (got.get("reference", 0), got.get("cal", 0), got.get("query", 0)) == (ref, cal, n - ref - cal)


def test_quotas():
    assert splits.quota_order({"a": 2, "b": 1}) == ["a", "a", "b"]
    assert sorted(splits.quota_order({"a": 3, "b": 2, "c": 1})) == list("aaabbc")


def test_layer_norm_takes_a_mean_once_a_row(spark):
    """A mean for each element of each deviation took a time that grew with the cube of the length: some 40 s here."""
    x = np.random.default_rng(0).normal(size=600)
    d = spark.createDataFrame([(0, x.tolist()), (1, []), (2, None)], "id int, v array<double>").coalesce(1)
    began = time.monotonic()
    got = {r.id: r.n for r in d.select("id", S.layer_norm(F.col("v")).alias("n")).collect()}
    assert time.monotonic() - began < 10
    assert np.allclose(got[0], (x - x.mean()) / np.sqrt(x.var() + 1e-5)) and got[1] == [] and got[2] is None
