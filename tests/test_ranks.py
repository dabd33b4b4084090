"""Row numbers and running sums in two steps, on groups that lie in several parts; reports and configuration."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnlake import config
from tarnlake.functions import scalars as S
from tarnlake.operators import lake, metrics, reports, splits
from tarnlake.operators.ranks import numbered, running
from tarnlake.plans.inspect import plan_of


@pytest.fixture
def many_parts(spark):
    """Groups are really cut: small parts aren't joined again."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(spark, n=500):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), rng.randrange(-5, 20)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, k long, v long")


@pytest.mark.parametrize("by", [["g"], []])
def test_numbers_and_sums(many_parts, by):
    rows, d = rows_of(many_parts)
    got = {r.id: (r.rank, r.n, r.upto) for r in running(numbered(d, by, ["k", -F.col("id")], "rank", "n"), by, ["k", -F.col("id")], "v", "upto").collect()}
    want = {}
    for g in {r[1] for r in rows} if by else {None}:
        own = sorted((r for r in rows if not by or r[1] == g), key=lambda r: (r[2], -r[0]))
        total = 0
        for i, r in enumerate(own, 1):
            total += r[3]
            want[r[0]] = (i, len(own), total)
    assert got == want


def test_no_window_over_a_whole_group(many_parts):
    _, d = rows_of(many_parts)
    plan = plan_of(numbered(d, ["g"], ["k", "id"]))
    assert "__part" in plan and plan.count("Window") >= 1
    for line in (x for x in plan.split("\n") if x.startswith("Arguments: [row_number") or "sum(__value" in x and "windowspecdefinition" in x):
        assert "__part" in line


def test_auroc_of_ties(many_parts):
    rng = random.Random(5)
    rows = [(c, rng.randrange(12) / 10, rng.random() < 0.3) for c in range(3) for _ in range(200)] + [(9, 0.5, True)]
    got = {r.cls: r.auroc for r in metrics.mid_rank_auroc(many_parts.createDataFrame(rows, "cls int, score double, positive boolean"), ["cls"]).collect()}
    for c in range(3):
        pos, neg = ([s for k, s, p in rows if k == c and p == side] for side in (True, False))
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[c] == pytest.approx(want)
    assert got[9] is None


def test_plans_of_batches_and_splits(many_parts):
    d = many_parts.range(1000).select(F.col("id"), F.lit("x").alias("g"), (F.col("id") % 2).alias("y"))
    sizes = [r["count"] for r in lake.batch_plan(d, "g", ["id"], 111).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == lake.batch_sizes(1000, 111) == [111] * 8 + [112]
    assert len(sizes) == lake.batch_count(1000, 111)
    assert splits.negative_cap(d.withColumn("y", (F.col("id") < 100).cast("int")), "y", "id", 3).count() == 400
    packed = lake.pack_shards(d, "g", ["id"], 300, "pack").groupBy("pack").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("pack").collect()
    assert [(r.pack, r.a, r.b) for r in packed] == [(0, 0, 299), (1, 300, 599), (2, 600, 899), (3, 900, 999)]


def test_report_order(spark):
    rows = spark.createDataFrame([("b", "t1", 1.0), ("a", "t2", 2.0), (None, "t0", 3.0), ("a", "t1", None)], "dataset string, task string, acc double")
    assert [(r.dataset, r.task) for r in reports.ordered(rows).orderBy("pos").collect()] == [("a", "t1"), ("a", "t2"), ("b", "t1"), (None, "t0")]


def test_kinds_and_probabilities(spark):
    d = spark.createDataFrame([("ckpt-7.ckpt", "polyp", [0.25, 0.75]), ("events.1", None, [1.0, 2.0])], "name string, task string, x array<double>")
    got = d.select(S.checkpoint_kind(F.col("name")), S.cache_task(F.col("task")), S.as_probabilities(F.col("x")).alias("p")).collect()
    assert [tuple(r)[:2] for r in got] == [("periodic ckpt", "cache/polyp"), ("tb / other", "cache (unattributed)")]
    assert got[0].p == [0.25, 0.75] and got[1].p == pytest.approx([0.2689414, 0.7310586])


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"root": "${oc.env:ROOT}", "out": {"dir": "${root}/out", "n": 3, "copy": "${out.n}", "list": ["${out.dir}/a"]}, "d": "${oc.env:NONE,x y}"}))
    got = config.load(str(path), {"ROOT": "/r"})
    assert got == {"root": "/r", "out": {"dir": "/r/out", "n": 3, "copy": 3, "list": ["/r/out/a"]}, "d": "x y"}
    for bad, error in (({"a": "${b}"}, KeyError), ({"a": "${oc.env:NOPE}"}, KeyError), ({"a": "${b}", "b": "${a}"}, ValueError)):
        with pytest.raises(error):
            config.resolve(bad, {})
    assert config.expand("~/x").endswith("/x") and config.expand("~/x").startswith("/")
