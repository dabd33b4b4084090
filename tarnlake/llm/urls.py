"""URL filtering by a Bloom filter cascade.

The keys of a url are the pairs of its host or a parent domain and a leading part of its path, of the lengths
that the rules have. Level 0 of the cascade encodes the listed keys; each further level encodes the keys of the
corpus' complete key universe which the level before answers wrongly, until none is left. As every key that is
ever asked is in that universe, membership is exact, and no url is joined with anything. The first level is so sparse
that about as many keys of the universe pass it as are listed, so the levels grow with the list and only with the
logarithm of the universe. Levels go with the plan; a list whose levels would take over ``MAX_LEVEL_BYTES`` is looked
up by an ordinary join instead, with the same result.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is allowed. Very long urls are judged
whole. Of rules of one length the least by code points wins. Repeated rows get repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import free, materialize, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
#: Of the universe's other keys, the first level lets about this many through for each listed key; later levels half.
PASS_A_KEY = 0.7
#: The most bytes of a level; longer lists are looked up by a join.
MAX_LEVEL_BYTES = 8 << 20
MAX_LEVELS = 64


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Candidate keys, longest first; each is host or parent domain, then a leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = lambda n: F.transform(domains, lambda d: F.when(F.char_length(path) >= n, F.concat(d, F.substring(path, 1, n))))
    found = F.filter(F.concat(*map(with_path, lengths)), lambda k: k.isNotNull())
    return F.array_sort(found, lambda a, b: F.coalesce(F.nullif(F.char_length(b) - F.char_length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))


@dataclass
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        """All bits of the key are set; one binary literal, read by byte."""
        bits, found = F.lit(self.bits), None
        for j in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.size))
            byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
            bit = F.getbit(byte, (at % 8).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def level_size(n: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and hashes of a level that encodes n keys, against so many others."""
    share = min(0.5, PASS_A_KEY * n / others) if first and n and others else 0.5
    hashes = max(1, math.ceil(-math.log2(share)))
    return max(64, -(-math.ceil(n * hashes / math.log(2)) // 64) * 64), hashes


def _level(listed: DataFrame, size: int, hashes: int, seed: int) -> Level:
    """A Bloom filter of the ``key`` column, its bits gathered by byte on the executors."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed), F.lit(j)), F.lit(size)) for j in range(hashes)])).alias("at")
    set_ = listed.select(at).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 AS INT))")).alias("v"))
    bits = bytearray(size // 8)
    for r in set_.toLocalIterator():  # at most MAX_LEVEL_BYTES rows
        bits[r["byte"]] = r["v"]
    return Level(bytes(bits), size, hashes, seed)


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level] | None:
    """Levels that tell exactly which keys of ``universe`` (distinct, column key) are in ``listed``; None if they are too large."""
    inside = materialize(universe.join(listed.select("key").distinct(), "key", "left_semi"), "urls-listed")
    outside = universe.join(inside, "key", "left_anti")
    encode, other, levels, written = inside, outside, [], [inside]
    n, others = inside.count(), universe.count()
    for depth in range(MAX_LEVELS):
        size, hashes = level_size(n, others - n, depth == 0)
        if size // 8 > MAX_LEVEL_BYTES:
            return None
        levels.append(_level(encode, size, hashes, depth))
        wrong = materialize(other.where(levels[-1].has(F.col("key"))), f"urls-wrong{depth}")
        written.append(wrong)
        encode, other, others, n = wrong, encode, n, wrong.count()
        if not n or depth == 0 and not others:
            free(*written)
            return levels
    raise RuntimeError("the cascade doesn't end")


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe: the first level without it decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[depth].has(key), F.lit(depth % 2 == 1)).otherwise(out)
    return out


def listed_by_join(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """For lists too long for a level: the universe's keys with a flag, by an ordinary join."""
    return universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").fillna(False, ["listed"])


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row."""
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    split = urls.select("page_id", host.alias("host"), path.alias("path"))
    own = keys(F.col("host"), F.col("path"), lengths)
    universe = materialize(split.select(F.explode(own).alias("key")).distinct(), "urls-universe")
    listed = spark.createDataFrame([(r,) for r, _ in rules], "key string")
    levels = cascade(universe, listed)
    if levels is None:
        hit = _hits_by_join(split, own, listed)
    else:
        found = F.filter(own, lambda k: member(k, levels))
        hit = split.withColumn("rule", F.when(F.size(found) > 0, F.element_at(found, 1)))
    free(universe)
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    verdict = F.coalesce(F.element_at(verdicts, F.col("rule")), F.lit(default))
    return hit.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict")


def _hits_by_join(split: DataFrame, own: Column, listed: DataFrame) -> DataFrame:
    """``split`` with the first of its keys that is listed, by a join of the keys."""
    numbered = materialize(split.withColumn("row", F.monotonically_increasing_id()), "urls")
    each = numbered.select("row", F.posexplode(own).alias("place", "key")).join(listed.distinct(), "key")
    return numbered.join(each.groupBy("row").agg(F.min_by("key", "place").alias("rule")), "row", "left")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS k
  FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT s.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.k = 1
"""

QUERIES = {"op6_url_filters": op6_url_filters}
ORACLES = {"op6_url_filters": ORACLE}
