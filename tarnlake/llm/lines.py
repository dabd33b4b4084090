"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the host's
pages; lines over the boilerplate ratio, and on ``min_pages`` pages or more, are dropped from all of the host's pages, also
where that leaves a page empty.

Lines are split at \\n; those of blanks only are neither counted nor dropped. A null text stays null with no
lines. Pages of a null host are one group. Repeated rows count as pages of their own. A line at exactly the ratio
stays. A very long text is handled whole, in its own row. An empty table gives an empty result.

A line over the ratio takes its share of the host's pages, so a host has at most (mean lines a page) / ratio such
lines; what is joined back to the pages is that short list. It is one row a host, kept as digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import materialize, table

RATIO = 0.05
MIN_PAGES = 3
_BLANK = " \t\n\x0b\x0c\r"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _full(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANK)) != ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): digests of each host's boilerplate lines; hosts without any are left out."""
    p = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    total = p.groupBy("host").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), _full), _digest))
    on = p.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    on = on.withColumnRenamed("host", "h")
    hot = on.join(total, F.col("h").eqNullSafe(F.col("host"))).where(F.col("n") / F.col("pages") > F.lit(float(ratio)))
    return hot.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("bad"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``pages`` with the text cleaned, and the counts of lines and dropped lines after its own columns.

    Columns of the input that are called as the counts give way; other extra columns stay.
    """
    own = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    bad = materialize(boilerplate(pages, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias("__host"), F.col("bad").alias("__bad"))
    joined = pages.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    is_bad = lambda x: _full(x) & F.coalesce(F.array_contains(F.col("__bad"), _digest(x)), F.lit(False))
    marked = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(x.alias("line"), is_bad(x).alias("bad"), _full(x).alias("full")))
    lines = joined.withColumn("__lines", marked)
    lines = lines.withColumn("__all", F.coalesce(F.size(F.filter("__lines", lambda x: x.full)), F.lit(0))).withColumn("__n", F.size(F.filter("__lines", lambda x: x.bad)))
    drop = F.coalesce(F.col("__n") > 0, F.lit(False))
    cleaned = F.when(drop, F.array_join(F.transform(F.filter("__lines", lambda x: ~x.bad), lambda x: x.line), "\n")).otherwise(F.col(text))
    lines = lines.withColumn("__dropped", F.when(drop, F.col("__n")).otherwise(0).cast("long")).withColumn("__all", F.when(F.col(text).isNull(), 0).otherwise(F.col("__all")).cast("long"))
    return lines.withColumn(text, cleaned).select(*own, F.col("__all").alias(names[0]), F.col("__dropped").alias(names[1]))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = r"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> '' AS full_
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE full_ GROUP BY source, line) c
  JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND CAST(n AS DOUBLE) / CAST(pages AS DOUBLE) > CAST(0.05 AS DOUBLE)),
m AS (SELECT l.*, bad.line IS NOT NULL AS bad FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line AND l.full_),
d AS (SELECT doc_id, count(*) FILTER (full_) AS n_lines, count(*) FILTER (bad) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS cut FROM m GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_dropped,
  CASE WHEN n > 0 THEN coalesce(cut, '') ELSE text END AS text
FROM documents LEFT JOIN d USING (doc_id)
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": ORACLE}
