"""Row numbers and running sums inside groups of any size, in two steps.

A window over a group sorts the whole group in one task. Here rows are dealt by ranges of (group, order), so that a
group lies in as many parts as it needs; each part numbers its own rows, and a short table of part sizes, a row for
each group and part, tells where a part's numbers begin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import materialize

_PART, _BASE, _ALL = "__part", "__base", "__all"


def _named(rows: DataFrame, order: list) -> tuple[DataFrame, list[str]]:
    """Order expressions as columns of their own."""
    names = [f"__order{i}" for i in range(len(order))]
    return rows.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)}), names


def running(rows: DataFrame, by: list[str], order: list, value: str | Column, name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the group's rows up to this one; and ``total``: that of the whole group.

    Rows of one order are summed in any sequence; give an order that tells rows apart where that matters.
    """
    named, keys = _named(rows.withColumn("__value", F.col(value) if isinstance(value, str) else value), order)
    dealt = named.repartitionByRange(*[F.col(c) for c in (*by, *keys)]) if by or keys else named
    dealt = materialize(dealt.withColumn(_PART, F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*by, _PART).agg(F.sum("__value").alias("__size"))
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    every = Window.partitionBy(*by)
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(_PART).alias("__p"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias(_BASE), F.sum("__size").over(every).alias(_ALL))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col(_PART) == F.col("__p"))
    own = Window.partitionBy(*by, _PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("__own", F.sum("__value").over(own)).join(sizes, same)
    out = out.withColumn(name, F.col(_BASE) + F.col("__own"))
    if total:
        out = out.withColumn(total, F.col(_ALL))
    return out.select(*rows.columns, name, *([total] if total else []))


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``name``: the row's number in its group, from 1; and ``total``: how many rows the group has."""
    return running(rows, by, order, F.lit(1).cast("long"), name, total)
