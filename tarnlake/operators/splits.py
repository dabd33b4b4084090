"""Splits, class lists, caps and joins that build evaluation tasks. Seeded orders are by digest (see scalars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators.ranks import numbered


def canonical_classes(rows: DataFrame, label: str, min_class: int = 1) -> DataFrame:
    """(label, n, index): labels with enough rows, numbered in order. The window runs over labels."""
    n = rows.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, min_class))
    return n.withColumn("index", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def stratified_split(rows: DataFrame, label: str, key: str, reference: float = 0.6, cal: float = 0.15, seed: int = 0) -> DataFrame:
    """Adds split: by seeded rank within the class; max(1, round(.6 n)) reference, round(.15 n) cal, the rest query.
    Halves round to even."""
    rows = numbered(rows, [label], [S.seeded_order(seed, F.col(key)), key], "__rank", "__n")
    rank, n = F.col("__rank"), F.col("__n")
    n_ref, n_cal = F.greatest(F.lit(1), F.bround(F.lit(reference) * n)), F.bround(F.lit(cal) * n)
    split = F.when(rank <= n_ref, "reference").when(rank <= n_ref + n_cal, "cal").otherwise("query")
    return rows.withColumn("split", split).drop("__rank", "__n")


def quota_order(quotas: dict[str, int]) -> list[str]:
    """The part that each next group goes to: that of the largest remaining quota, ties in declaration order."""
    left, out = dict(quotas), []
    while any(left.values()):
        part = max(left, key=lambda p: left[p])  # the first of equals
        out.append(part)
        left[part] -= 1
    return out


def grouped_split(rows: DataFrame, group: str, stratum: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """(group, stratum, part): whole groups; strata in order, groups by seeded order; surplus groups are in no part.

    A group counts once, with its first stratum. What part a position gets is known beforehand, so only that short
    list meets the numbered groups.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(group).agg(F.min(stratum).alias(stratum))
    have = groups.count()
    if sum(quotas.values()) > have:
        raise ValueError(f"{sum(quotas.values())} groups asked for, {have} there")
    order = spark.createDataFrame(list(enumerate(quota_order(quotas), 1)), "pos int, part string")
    placed = numbered(groups, [], [F.col(stratum), S.seeded_order(seed, F.col(group)), group], "pos")
    return placed.join(order, "pos").select(group, stratum, "part")


def class_cap(rows: DataFrame, label: str, order: list, cap: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def stride_sample(rows: DataFrame, part: str, order: list, stride: int) -> DataFrame:
    return numbered(rows, [part], order, "_k").where((F.col("_k") - 1) % stride == 0).drop("_k")


def negative_cap(rows: DataFrame, label: str, key: str, per_positive: int, seed: int = 0) -> DataFrame:
    """All positives (label 1) and per_positive * max(1, positives) negatives at most, by seeded order."""
    most = per_positive * max(1, rows.where(F.col(label) == 1).count())
    neg = numbered(rows.where(F.col(label) == 0), [], [S.seeded_order(seed, F.col(key)), key], "__rank")
    return rows.where(F.col(label) == 1).unionByName(neg.where(F.col("__rank") <= most).drop("__rank"))


def group_cap(rows: DataFrame, group: list[str], key: str, cap: int, seed: int = 0) -> DataFrame:
    return class_cap_by(rows, group, [S.seeded_order(seed, F.col(key)), F.col(key)], cap)


def class_cap_by(rows: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def balanced_subset(rows: DataFrame, shard: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """max(1, n // shards) rows a shard, then n in all, by seeded orders."""
    shards = max(1, rows.select(shard).distinct().count())
    per = class_cap_by(rows, [shard], [S.seeded_order(seed, F.col(key)), F.col(key)], max(1, n // shards))
    return per.orderBy(S.seeded_order(f"{seed}:all", F.col(key)), key).limit(n)


def support_query(rows: DataFrame, key: str, support: int, seed: int = 0) -> DataFrame:
    """Adds role: the first ``support`` rows of a seeded order are support, the others query."""
    first = rows.orderBy(S.seeded_order(seed, F.col(key)), key).limit(support).select(key).withColumn("_s", F.lit(True))
    return rows.join(first, key, "left").withColumn("role", F.when(F.col("_s"), "support").otherwise("query")).drop("_s")


def labelled(scan: DataFrame, labels: DataFrame, key: str, column: str, fallback) -> DataFrame:
    """Scan rows with the label table's value, else the fallback expression; rows with neither go."""
    got = scan.join(labels.select(key, F.col(column).alias("_l")), key, "left").withColumn(column, F.coalesce("_l", fallback)).drop("_l")
    return got.where(F.col(column).isNotNull())


def first_match(left: DataFrame, right: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Each left name with the first right name that matches: equal ones first; else one ends with the other, or their
    last tokens after '_' are equal, by the right side's order.

    Candidates of the second kind share their last token, so an equi-join on it finds them: a name that ends with
    another one also ends with its last token. Names without '_' inside a longer token are found by the suffix keys.
    """
    tail = lambda c: F.regexp_extract(c, r"([^_]*)$", 1)
    r = right.select(F.col(name).alias("r_name"), F.col(ordinal).alias("r_ord"))
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(c))), lambda i: F.substr(c, i))
    a = left.select(name, F.explode(F.array_distinct(F.concat(F.array(tail(F.col(name))), suffixes(tail(F.col(name)))))).alias("k"))
    b = r.select("*", F.explode(F.array_distinct(F.concat(F.array(tail(F.col("r_name"))), suffixes(tail(F.col("r_name")))))).alias("k"))
    n, m = F.col(name), F.col("r_name")
    ok = n.endswith(m) | m.endswith(n) | (tail(n) == tail(m))
    meets = a.join(b, "k").where((F.col("k") == tail(n)) | (F.col("k") == tail(m))).where(ok).select(name, "r_name", "r_ord").distinct()
    best = meets.groupBy(name).agg(F.min_by("r_name", F.struct(F.when(n == m, 0).otherwise(1), F.col("r_ord"))).alias("match"))
    return left.join(best, name, "left")


def size_mismatch(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, local_size, remote_size) of files on both sides whose sizes differ."""
    r = remote.select("name", F.col("size").alias("remote_size"))
    return local.select("name", F.col("size").alias("local_size")).join(r, "name").where("local_size <> remote_size")


def sampled_stream(rows: DataFrame, shard: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, shard, key): shards drawn with replacement, each read in seeded order; a shard may be drawn again or never.

    The shard list is short: draws meet it by number.
    """
    spark = rows.sparkSession
    shards = rows.select(shard).distinct().withColumn("_i", F.row_number().over(Window.orderBy(shard)) - 1)
    n = shards.count()
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(S.seeded_order(seed, F.col("id")), 1, 12), 16, 10).cast("long"), F.lit(max(1, n))).alias("_i"))
    return picks.join(shards, "_i").join(rows.select(shard, key), shard).withColumn("pos", F.row_number().over(Window.partitionBy("draw").orderBy(S.seeded_order(seed, F.col("draw"), F.col(key)), key))).select("draw", "pos", shard, key)


def whole_archives(rows: DataFrame, archive: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n archives, the first by seeded order."""
    picked = rows.select(archive).distinct().orderBy(S.seeded_order(seed, F.col(archive)), archive).limit(n)
    return rows.join(picked, archive, "left_semi")


def first_paths(files: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files by path."""
    return files.orderBy("path").limit(cap)
