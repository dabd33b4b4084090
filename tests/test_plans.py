"""The plans that matter: what reaches the scan, and what doesn't get shuffled or paired."""

from pyspark.sql import functions as F

from tarnlake.operators import hamming, knn, lake
from tarnlake.plans.inspect import plan_of, read_columns
from tarnlake.queries import documents, embeddings


def test_counts_read_only_their_columns(spark, sf):
    d = documents.manifest(spark, sf).groupBy("shard").agg(F.sum("bytes"))
    assert read_columns(d) == {"source", "n_chars"}


def test_filters_reach_the_scan(spark, sf):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan_of(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'"))


def test_joins_aggregate_or_meet_by_key(spark, sf):
    h = embeddings.hashes(spark, sf)
    for d in (hamming.banded_pairs(h, 6), lake.global_dedup(documents.manifest(spark, sf), "phash", "member"), knn.knn_join(*embeddings.sides(spark, sf), 5)):
        plan = plan_of(d)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
