"""Joins of 64-bit hashes by Hamming distance.

Within distance d, one of d + 1 bands of a hash is equal in both (pigeonhole), so pairs are found by an equi-join on
(band, bits) and verified with bit_count. Bands under ``MIN_BAND_BITS`` would hardly select; then bits are spread
over fewer bands, and each is matched up to the distance that the pigeonhole leaves to it, by listing its near values.
Where even these would name a large share of all pairs, components and matches are found by tiles (see ``tiles``).
Hashes are made distinct first: equal ones are counted, not joined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.scalars import hamming
from tarnlake.operators.nearest import nearest_distance
from tarnlake.operators.components import connected_components
from tarnlake.operators.tiles import tile_links, tile_matches
from tarnlake.session import materialize

MIN_BAND_BITS = 9
MAX_FLIPS = 2


def bands(distance: int) -> tuple[list[tuple[int, int]], int]:
    """(shift, bits) of each band, and how many of its bits may differ."""
    for flips in range(MAX_FLIPS + 1):
        count = distance // (flips + 1) + 1
        if 64 // count >= MIN_BAND_BITS * (flips + 1) or flips == MAX_FLIPS:
            break
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], flips


def selective(distance: int) -> bool:
    """Whether bands name few pairs beside the near ones."""
    cuts, flips = bands(distance)
    return min(bits for _, bits in cuts) >= MIN_BAND_BITS * (flips + 1)


def _keys(column: str, cuts: list[tuple[int, int]], flips: int):
    out = []
    for i, (shift, bits) in enumerate(cuts):
        value = F.expr(f"shiftrightunsigned({column}, {shift}) & {(1 << bits) - 1 if bits < 64 else -1}")
        masks = [sum(1 << p for p in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
        out.append(F.struct(F.lit(i).alias("band"), F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), _flip(value)).alias("values")))
    return F.flatten(F.transform(F.array(*out), lambda s: F.transform(s["values"], lambda v: F.struct(s["band"].alias("band"), v.alias("value")))))


def _flip(value):
    return lambda m: value.bitwiseXOR(m)


def banded_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b, d), a < b, of the distinct ids whose hashes are within the distance. Rows: id, hash."""
    cuts, flips = bands(distance)
    left = rows.select(F.col("id").alias("a"), F.col("hash").alias("ha"), F.explode(_keys("hash", cuts, flips)).alias("k"))
    right = rows.select(F.col("id").alias("b"), F.col("hash").alias("hb"), F.explode(_keys("hash", cuts, 0)).alias("k"))
    found = left.join(right, "k").where("a < b").withColumn("d", hamming(F.col("ha"), F.col("hb"))).where(F.col("d") <= distance)
    return found.select("a", "b", "d").distinct()


def hamming_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """All pairs (a, b, d) of rows with a hash within the distance."""
    return banded_pairs(rows.where("hash is not null"), distance)


def near_duplicate_anti_join(rows: DataFrame, reference: DataFrame, distance: int) -> DataFrame:
    """Rows without a reference row within the distance; rows without a hash stay."""
    r = reference.where("hash is not null").select("hash").distinct()
    if not selective(distance):
        asked = materialize(rows.where("hash is not null").select("hash").distinct(), "asked")
        return rows.join(materialize(tile_matches(asked, materialize(r, "references"), distance), "near"), "hash", "left_anti")
    cuts, flips = bands(distance)
    left = rows.where("hash is not null").select(F.col("hash").alias("ha")).distinct().select("ha", F.explode(_keys("ha", cuts, flips)).alias("k"))
    right = r.select(F.col("hash").alias("hb"), F.explode(_keys("hash", cuts, 0)).alias("k"))
    near = left.join(right, "k").where(hamming(F.col("ha"), F.col("hb")) <= distance).select(F.col("ha").alias("hash")).distinct()
    return rows.join(near, "hash", "left_anti")


def naive_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """All pairs compared: the plain form, for tests and the bench only."""
    a, b = rows.select(F.col("id").alias("a"), F.col("hash").alias("ha")), rows.select(F.col("id").alias("b"), F.col("hash").alias("hb"))
    near = hamming(F.col("ha"), F.col("hb"))
    return a.join(b, (F.col("a") < F.col("b")) & (near <= distance)).select("a", "b", near.alias("d"))


def _links(unique: DataFrame, distance: int) -> DataFrame:
    return hamming_pairs(unique, distance) if selective(distance) else tile_links(unique, distance)


def hash_components(rows: DataFrame, distance: int) -> DataFrame:
    """(id, component): single-linkage clusters, named by their least id."""
    unique = materialize(rows.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id")), "hashes")
    label = connected_components(_links(unique, distance)).withColumnRenamed("node", "id")
    named = unique.join(label, "id", "left").select("hash", F.coalesce("component", "id").alias("component"))
    return rows.join(named, "hash", "left").select("id", F.coalesce("component", "id").alias("component"))


def redundancy(rows: DataFrame, distance: int) -> DataFrame:
    """n, clusters, redundant (n - clusters) and with_neighbour (rows that have another row near).

    Hashes are made once a row and counted; only the counts are joined to the clusters. A row without a hash is a cluster of its own.
    """
    counted = materialize(rows.groupBy("hash").agg(F.count("*").alias("m")), "hashes")
    nodes = counted.where("hash is not null").select(F.col("hash").alias("id"), "hash")
    label = connected_components(_links(nodes, distance)).select(F.col("node").alias("hash"), "component")
    named = counted.where("hash is not null").join(label, "hash", "left")
    size = named.groupBy(F.coalesce("component", "hash")).agg(F.sum("m").alias("m")).select("m", F.lit(1).cast("long").alias("clusters"))
    size = size.unionByName(counted.where("hash is null").select(F.col("m"), F.col("m").alias("clusters")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    near = F.when(F.col("m") > F.col("clusters"), F.col("m"))
    return size.agg(total("m").alias("n"), total("clusters").alias("clusters"), total(F.col("m") - F.col("clusters")).alias("redundant"), total(near).alias("with_neighbour"))


def nearest_histogram(rows: DataFrame, cap: int = 32) -> DataFrame:
    """(d, n): how far each row's nearest other row is; ``cap`` stands for that and more.

    Every hash is compared with every other, in blocks (see ``nearest``): the histogram reaches far beyond the
    distances that bands can find.
    """
    n = nearest_distance(rows, cap)
    return n.groupBy("d").agg(F.count("*").alias("n"))
