"""Long results, deltas, audits, balance, redundancy and storage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("dataset", "init", "task", "protocol", "temp_scaled")
METRICS = ("ece_ew", "ece_adaptive", "nll", "brier", "accuracy", "balanced_acc", "auroc", "dice", "miou")


def long_results(docs: DataFrame, columns: tuple[str, ...], provenance: tuple[str, ...] = ()) -> DataFrame:
    """Result documents with ``rows`` exploded; a column that is missing in a row comes from the provenance."""
    r = docs.where(F.col("rows").isNotNull()).select("*", F.explode("rows").alias("r"))
    fields = {f.name for f in docs.schema["rows"].dataType.elementType.fields}
    prov = {f.name for f in docs.schema["provenance"].dataType.fields} if "provenance" in docs.columns else set()

    def value(c: str) -> Column:
        own = [F.col(f"r.{c}")] if c in fields else []
        back = [F.col(f"provenance.{c}")] if c in prov and c in provenance else []
        return (F.coalesce(*own, *back) if own or back else F.lit(None)).alias(c)

    return r.select(*[value(c) for c in columns])


#: What reports are ordered by, as far as they have it.
ORDER = ("dataset", "task", "protocol", "init", "objective", "stage", "temp_scaled")


def ordered(results: DataFrame, name: str = "pos") -> DataFrame:
    """Adds ``name``: each row's place in the order of reports, from 1; missing values last, then by all other columns."""
    keys = [F.col(c).asc_nulls_last() for c in ORDER if c in results.columns]
    rest = [F.col(c).asc_nulls_last() for c in results.columns if c not in ORDER]
    return results.withColumn(name, F.row_number().over(Window.orderBy(*keys, *rest)))  # a report's rows, not the corpus'


def delta_view(results: DataFrame) -> DataFrame:
    """Post rows against the pre row of the same keys: d_<metric> = post - pre. Null keys are equal to each other."""
    there = [m for m in METRICS if m in results.columns]
    pre = results.where("stage = 'pre'").dropDuplicates(list(KEYS)).select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[F.col(m).alias(f"_{m}") for m in there])
    post = results.where("stage = 'post'")
    on = F.lit(True)
    for k in KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    extra = [c for c in ("objective", "corpus", "run_tag") if c in results.columns]
    return post.join(pre, on).select(*KEYS, *extra, *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in there]).dropDuplicates()


def model_selection(deltas: DataFrame, metric: str = "d_balanced_acc", worst: float = -0.02) -> DataFrame:
    """Mean delta by objective over tasks, and whether no task fell below the gate."""
    return deltas.groupBy("objective").agg(F.avg(metric).alias("mean_delta"), F.min(metric).alias("worst_delta")).withColumn("passes", F.col("worst_delta") >= worst)


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """One row: classes, shares of the largest and smallest, max:min, entropy over its maximum, effective classes, chance."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a class
    h = F.sum(-F.col("p") * F.log("p"))
    return p.agg(F.count("*").alias("classes"), F.max("p").alias("majority"), F.min("p").alias("minority"), (F.max("n") / F.greatest(F.lit(1), F.min("n"))).alias("imbalance"), F.when(F.count("*") > 1, h / F.log(F.count("*"))).otherwise(1.0).alias("norm_entropy"), F.exp(h).alias("effective"), (F.lit(1.0) / F.count("*")).alias("chance"))


def ontology(rows: DataFrame, finding: str, tract: str) -> DataFrame:
    return rows.groupBy(finding).agg(F.sort_array(F.collect_set(tract)).alias("tracts")).withColumn("single", F.size("tracts") == 1)


def storage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and files by bucket, with a total (null bucket)."""
    return rows.rollup(*by).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def last_value(series: DataFrame) -> DataFrame:
    """(tag, last, max_step, n) of (tag, step, value); of equal steps the largest value counts."""
    return series.groupBy("tag").agg(F.max_by("value", F.struct("step", "value")).alias("last"), F.max("step").alias("max_step"), F.count("*").alias("n"))


def by_step(series: DataFrame, tags: list[str]) -> DataFrame:
    """One row a step with a column for each tag."""
    return series.groupBy("step").pivot("tag", tags).agg(F.max("value"))


def histogram(x: Column, edges: list[float]) -> Column:
    """Bin (from 0) of fixed edges, the last closed on the right; null outside."""
    last = len(edges) - 2
    out = F.when(x == edges[-1], last)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((x >= a) & (x < b), i)
    return out


def rule_of_three(n: Column) -> Column:
    """95 % upper bound of a share of which none was seen in n."""
    return F.lit(3.0) / n


def bootstrap_rates(units: DataFrame, hits: str, total: str, key: str, resamples: int, seed: int = 0) -> DataFrame:
    """(b, rate): resamples of whole units, each unit with a Poisson(1) weight from a hash of the key and b."""
    u = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    x = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", key).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight, cut, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        cut += p
        weight = weight + F.when(x >= cut, 1).otherwise(0)
        p /= k
    w = u.withColumn("w", weight)
    return w.groupBy("b").agg((F.sum(F.col("w") * F.col(hits)) / F.nullif(F.sum(F.col("w") * F.col(total)), F.lit(0))).alias("rate"))


def redundancy_rollup(rows: DataFrame, archive: str, digest: str) -> DataFrame:
    """(archive, n, redundant, rate) of exact repeats inside each archive."""
    per = rows.groupBy(archive, digest).agg(F.count("*").alias("m"))
    return per.groupBy(archive).agg(F.sum("m").alias("n"), F.sum(F.col("m") - 1).alias("redundant")).withColumn("rate", F.col("redundant") / F.col("n"))


def histogram_sum(rows: DataFrame, histogram: str) -> DataFrame:
    """(bin, n): the element-wise sum of histograms kept as arrays."""
    return rows.select(F.posexplode(histogram).alias("bin", "x")).groupBy("bin").agg(F.sum("x").alias("n"))
