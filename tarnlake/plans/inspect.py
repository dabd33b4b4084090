"""What a plan does, for tests and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the scans read."""
    return {c for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan_of(df)) for c in re.findall(r"(\w+):", schema)}


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan_of(df), re.M))
