import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import hamming, tiles
from tarnlake.operators.components import connected_components
from tarnlake.plans.inspect import plan_of


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def planted(n=40, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.getrandbits(64)
        out.append(base)
        for d in (0, 1, 2, 6, 7):
            h = base
            for b in rng.sample(range(64), d):
                h ^= 1 << b
            out.append(h)
    return out


def frame(spark, values):
    return spark.createDataFrame([(i, signed(h)) for i, h in enumerate(values)], "id long, hash long")


@pytest.mark.parametrize("distance", [0, 1, 2, 6, 12])
def test_banded_pairs_are_all_pairs(spark, distance):
    rows = frame(spark, planted())
    key = lambda d: sorted(map(tuple, d.select("a", "b", "d").collect()))
    assert key(hamming.banded_pairs(rows, distance)) == key(hamming.naive_pairs(rows, distance))


def test_few_rows_go_by_bands_too(spark):
    rows = frame(spark, planted()).union(spark.createDataFrame([(9999, None)], "id long, hash long"))
    assert sorted(hamming.hamming_pairs(rows, 2).collect()) == sorted(hamming.naive_pairs(rows, 2).collect())
    assert "NestedLoop" not in plan_of(hamming.hamming_pairs(rows, 2))


def test_rows_without_hash_stay(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id long, hash long")
    assert [r.id for r in hamming.near_duplicate_anti_join(rows, rows.where("id = 1"), 3).collect()] == [2]


def test_hex_and_bits(spark):
    d = spark.createDataFrame([("ffffffffffffffff", "0000000000000001")], "a string, b string")
    a, b = S.hash_bits(F.col("a")), S.hash_bits(F.col("b"))
    assert tuple(d.select(a, b, S.hamming(a, b)).first()) == (-1, 1, 63)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(rows).collect()} == {x: find(x) for x in par}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges)
    assert got.count() == 301 and got.where("component <> 0").count() == 0


@pytest.mark.parametrize("tile_rows", [30, 10_000])
def test_tiles_have_the_components_and_matches_of_all_pairs(spark, tile_rows):
    rows = frame(spark, sorted(set(planted())))
    ends = lambda e: sorted(map(tuple, connected_components(e).collect()))
    assert ends(tiles.tile_links(rows, 18, tile_rows)) == ends(hamming.naive_pairs(rows, 18))
    left, right = rows.where("id % 3 = 0").select("hash"), rows.where("id % 3 <> 0").select("hash")
    near = left.join(right.withColumnRenamed("hash", "other"), S.hamming(F.col("hash"), F.col("other")) <= 18, "left_semi")
    assert sorted(tiles.tile_matches(left, right, 18, tile_rows).collect()) == sorted(near.collect())


def test_large_distances_list_no_values_of_bands(spark):
    """At 18 bits bands name two pairs in three; a row went into 322 keys."""
    assert not hamming.selective(18) and hamming.selective(6)
    rows = frame(spark, planted(10))
    kept = hamming.near_duplicate_anti_join(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 18)
    assert "Generate" not in plan_of(kept)
    links = tiles.tile_links(rows, 18)
    assert links.count() < rows.count()


def test_redundancy_of_tiles_is_that_of_all_pairs(spark, monkeypatch):
    rows = frame(spark, planted(12))
    monkeypatch.setattr(hamming, "hamming_pairs", lambda *_: pytest.fail("pairs by bands at a distance at which bands don't select"))
    got = hamming.redundancy(rows, 18).first()
    pairs = hamming.naive_pairs(rows, 18).select("a", "b")
    ends = {r.node: r.component for r in connected_components(pairs).collect()}
    clusters = len({ends.get(r.id, r.id) for r in rows.select("id").collect()})
    assert (got.n, got.clusters, got.redundant, got.with_neighbour) == (72, clusters, 72 - clusters, len(ends))


def test_redundancy_counts_each_row_once(spark):
    """Rows of one id were joined with each other by it; rows without a hash are clusters of their own."""
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 4), (3, -1), (4, None), (5, None)], "id long, hash long")
    assert tuple(hamming.redundancy(rows, 18).first()) == (7, 4, 3, 4)
    assert tuple(hamming.redundancy(rows.where("false"), 18).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("cut", [700, 2000])
def test_tiles_compare_few_pairs_of_a_large_component(monkeypatch, cut):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 1, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1900, 6), np.uint64)
    h = np.unique(np.concatenate([center ^ np.bitwise_xor.reduce(flips, 1), rng.integers(0, 1 << 63, 500, np.uint64)]))
    h = rng.permutation(h)[:2000]
    compared, near = [], tiles._near
    monkeypatch.setattr(tiles, "_near", lambda x, y, d: compared.append(len(x) * len(y)) or near(x, y, d))
    root = tiles._roots(h, cut, 18)
    assert sum(compared) < 0.6 * cut * (len(h) - cut or len(h))
    x, y = (h[:cut], h[cut:]) if cut < len(h) else (h, h)
    for i, j in near(x, y, 18):
        assert (root[i] == root[j + (cut if cut < len(h) else 0)]).all()
    assert len(np.unique(root)) > 50


def test_tiles_of_a_block_repeat_their_links(spark):
    rng = np.random.default_rng(4)
    hashes = {int(np.bitwise_xor.reduce(1 << rng.integers(0, 62, 6))) for _ in range(400)}
    rows = frame(spark, sorted(hashes))
    assert tiles.tile_links(rows, 18, 40).distinct().count() < 2 * rows.count()
