"""Catalog and curation: shard order, dedup, packing, selection, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators.ranks import numbered

# --- dedup ----------------------------------------------------------------------------------------------------------


def first_seen(rows: DataFrame, group: str, digest: str, key: str, order: list[str]) -> DataFrame:
    """Adds ``dup_of``: the key of the first row of the same digest in the group, null for that row itself."""
    w = Window.partitionBy(group, digest).orderBy(*order)
    first = F.first(key).over(w)
    return rows.withColumn("dup_of", F.when(F.col(digest).isNotNull() & (F.row_number().over(w) > 1), first))


def global_dedup(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """The least key of each digest; rows without a digest stay. A partial aggregate, so copies don't meet in one task."""
    kept = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias(key))
    return rows.join(kept, [digest, key], "left_semi").unionByName(rows.where(F.col(digest).isNull()))


def unseen(rows: DataFrame, state: DataFrame, digest: str) -> DataFrame:
    """Rows whose digest isn't in the state of earlier sessions."""
    return rows.join(state.select(digest).distinct(), digest, "left_anti")


def seen_state(*states: DataFrame) -> DataFrame:
    """Union of digests over sessions, each once."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.distinct()


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items without a row in the done log."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def to_copy(spec: DataFrame, listing: DataFrame) -> DataFrame:
    """Files to copy: not listed, or listed with another size than a declared one. Both: name, size."""
    have = listing.select(F.col("name").alias("h_name"), F.col("size").alias("h_size"))
    same = (F.col("name") == F.col("h_name")) & (F.col("size").isNull() | (F.col("size") == F.col("h_size")))
    return spec.join(have, same, "left_anti")


def duplicate_clusters(rows: DataFrame, digest: str) -> DataFrame:
    """One row: clusters of equal digests and the rows that could go. Blank and null digests are left out."""
    n = rows.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


# --- packing and batches --------------------------------------------------------------------------------------------


def pack_shards(rows: DataFrame, group: str, order: list[str], pack: int, name: str = "shard") -> DataFrame:
    """Adds ``name`` (from 0 in each group): every ``pack`` rows in order."""
    rows = numbered(rows, [group], order, "__rank")
    return rows.withColumn(name, F.floor((F.col("__rank") - 1) / pack).cast("int")).drop("__rank")


def batch_plan(rows: DataFrame, part: str, order: list, size: int) -> DataFrame:
    """Adds batch (from 0): full batches and a shorter tail; a tail of one row joins the batch before it."""
    if size < 2:
        raise ValueError("a batch takes two rows at least")
    rows = numbered(rows, [part], order, "__rank", "__n")
    rn, n = F.col("__rank"), F.col("__n")
    alone = (n % size == 1) & (rn == n)
    return rows.withColumn("batch", (F.floor((rn - 1) / size) - F.when(alone, 1).otherwise(0)).cast("int")).drop("__rank", "__n")


def batch_count(n: int, size: int) -> int:
    """How many batches ``batch_plan`` makes of n rows."""
    if n < 2 or size < 2:
        raise ValueError("two items and a batch size of two at least")
    return max(1, -(-n // size) - (n % size == 1))


def batch_sizes(n: int, size: int) -> list[int]:
    """Sizes of these batches: all full but the last."""
    full = batch_count(n, size) - 1
    return [size] * full + [n - full * size]


# --- selection ------------------------------------------------------------------------------------------------------


def stratified_cap(rows: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most most // groups (1 at least) rows a group, then at most ``most`` in all, by seeded order."""
    groups = rows.select(group).distinct().count()
    per = max(1, most // max(1, groups))
    order = S.seeded_order(seed, F.col(key))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("_k") <= per).drop("_k")
    return ranked.orderBy(order, key).limit(most)


def keep_fraction(narrowed: DataFrame, before: DataFrame, shard: str, fraction: float) -> DataFrame:
    """Shards that still hold the fraction of the rows that they had before narrowing."""
    had = before.groupBy(shard).agg(F.count("*").alias("had"))
    has = narrowed.groupBy(shard).agg(F.count("*").alias("has"))
    return has.join(had, shard).where(F.col("has") >= F.lit(fraction) * F.col("had"))


# --- data quality ---------------------------------------------------------------------------------------------------


def dq_summary(rows: DataFrame, expected: int, digest: str = "phash") -> DataFrame:
    """One row: counts, corrupt share, duplicate clusters, short sides and the verdict.

    The least short side skips zeros, the median doesn't.
    """
    side = S.short_side(F.col("width"), F.col("height"))
    a = rows.agg(
        F.count("*").alias("n"), F.count_if("corrupt").alias("corrupt"), F.min(F.when(side > 0, side)).alias("side_min"), F.median(side).cast("double").alias("side_median"), F.max(side).alias("side_max")
    ).withColumn("one", F.lit(1))
    d = duplicate_clusters(rows, digest).withColumn("one", F.lit(1))
    share = F.col("corrupt") / F.col("n")
    ok = (share < 0.001) & (F.abs(F.col("n") - expected) < 0.1 * expected)
    return a.join(d, "one").drop("one").withColumn("delta", F.col("n") - expected).withColumn("corrupt_share", share).withColumn("verdict", F.when(ok, "PASS").otherwise("REVIEW"))


def curated_rollup(curated: DataFrame) -> DataFrame:
    """Kept, duplicate and corrupt rows, bytes kept and distinct shards, from the stored sentinels."""
    kept = F.col("wds_shard") != ""
    corrupt = F.col("dup_of") == "CORRUPT"
    return curated.agg(
        F.count_if(kept).alias("kept"), F.count_if((F.col("dup_of") != "") & ~corrupt).alias("dup"), F.count_if(corrupt).alias("corrupt"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("bytes_kept"), F.count_distinct(F.when(kept, F.col("wds_shard"))).alias("shards"),
    )


def curated_status(row: str = "dup_of") -> Column:
    return F.when(F.col(row) == "CORRUPT", "corrupt").when(F.col(row) != "", "dup").otherwise("kept")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
