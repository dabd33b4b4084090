"""Queries on ``documents`` as the lake's manifest: shard = source, member = doc_id, digest = md5 of the text.

``corrupt`` is a proxy: fewer than 20 characters. Width and height are derived from the size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import lake
from tarnlake.operators.reports import histogram_sum, redundancy_rollup, storage
from tarnlake.operators.splits import size_mismatch
from tarnlake.session import materialize, table
from tarnlake.sources import lake as lake_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    index = S.shard_index(F.col("source"), F.lit(0))
    return d.select(
        F.col("source").alias("shard"), F.col("doc_id").alias("member"), F.col("n_chars").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("phash"), F.col("lang").alias("mode"),
        (F.col("n_chars") < 20).alias("corrupt"), (F.col("n_chars") % 640).cast("int").alias("width"), (F.col("n_chars") % 480).cast("int").alias("height"), S.shard_group(index).alias("shard_group"), index.alias("shard_index"),
    )


M = """WITH m AS (SELECT source AS shard, doc_id AS member, n_chars AS bytes, md5(text) AS phash, lang AS mode, n_chars < 20 AS corrupt, CAST(n_chars % 640 AS INTEGER) AS width, CAST(n_chars % 480 AS INTEGER) AS height,
  CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS shard_index, 'g' || lpad(CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) // 16 AS VARCHAR), 3, '0') AS shard_group FROM documents)"""
DEDUP = M + """, o AS (SELECT *, row_number() OVER (PARTITION BY shard_group, phash ORDER BY shard_index, member) AS rn, first_value(shard || '/' || member) OVER (PARTITION BY shard_group, phash ORDER BY shard_index, member) AS first_key FROM m),
d AS (SELECT *, shard || '/' || member AS key, CASE WHEN rn > 1 THEN first_key END AS dup_of FROM o)"""


def deduped(spark, sf) -> DataFrame:
    m = manifest(spark, sf).withColumn("key", F.concat_ws("/", "shard", "member"))
    return lake.first_seen(m, "shard_group", "phash", "key", ["shard_index", "member"])


@query("manifest_counts", M + " SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (corrupt) AS corrupt, count(DISTINCT phash) AS digests FROM m")
def manifest_counts(spark, sf):
    return manifest(spark, sf).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("corrupt").alias("corrupt"), F.count_distinct("phash").alias("digests"))


@query("manifest_value_counts", M + " SELECT mode, count(*) AS n FROM m GROUP BY mode")
def manifest_value_counts(spark, sf):
    return lake.value_counts(manifest(spark, sf), "mode")


@query("shard_group_assign", M + " SELECT shard, min(shard_index) AS shard_index, min(shard_group) AS shard_group, substr(shard, 1, 4) AS prefix FROM m GROUP BY shard")
def shard_group_assign(spark, sf):
    m = manifest(spark, sf).groupBy("shard").agg(F.min("shard_index").alias("shard_index"), F.min("shard_group").alias("shard_group"))
    return m.withColumn("prefix", S.group_key(F.col("shard")))


@query("sample_keys", "SELECT doc_id, source || '/' || doc_id AS key, '.jpg' AS ext, 'lake' AS bucket, source || '/' || doc_id || '.JPG' AS object FROM documents")
def sample_keys(spark, sf):
    uri = F.concat(F.lit("s3://lake/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".JPG"))
    bucket, key = S.store_uri(uri)
    return table(spark, sf, "documents").select("doc_id", S.sample_key(F.concat(F.lit("a/"), "source", F.lit(".zip")), F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("key"), S.extension(uri).alias("ext"), bucket.alias("bucket"), key.alias("object")).where(S.has_extension(F.col("object")))


@query("digests", "SELECT doc_id, sha256(text) AS sha256, substr(md5(text), 1, 16) AS run_id FROM documents")
def digests(spark, sf):
    t = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.substring(F.md5(t), 1, 16).alias("run_id"))


@query("dup_clusters", M + " SELECT count(*) AS clusters, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant FROM (SELECT phash, count(*) AS n FROM m GROUP BY phash HAVING count(*) > 1)")
def dup_clusters(spark, sf):
    return lake.duplicate_clusters(manifest(spark, sf), "phash")


@query("dq_summary", M + """, a AS (SELECT count(*) AS n, count(*) FILTER (corrupt) AS corrupt, min(CASE WHEN least(width, height) > 0 THEN least(width, height) END) AS side_min, CAST(median(least(width, height)) AS DOUBLE) AS side_median, max(least(width, height)) AS side_max FROM m),
c AS (SELECT count(*) AS clusters, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant FROM (SELECT phash, count(*) AS n FROM m GROUP BY phash HAVING count(*) > 1))
SELECT n, corrupt, side_min, side_median, side_max, clusters, redundant, n - 1000 AS delta, corrupt / n AS corrupt_share, CASE WHEN corrupt / n < 0.001 AND abs(n - 1000) < 100 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM a CROSS JOIN c""")
def dq_summary(spark, sf):
    return lake.dq_summary(manifest(spark, sf), 1000)


@query("aspect_stats", M + " SELECT round(avg(aspect), 6) AS mean_aspect, count(aspect) AS n FROM (SELECT CASE WHEN least(width, height) > 0 THEN greatest(width, height) / CAST(least(width, height) AS DOUBLE) END AS aspect FROM m)")
def aspect_stats(spark, sf):
    return manifest(spark, sf).select(S.aspect(F.col("width"), F.col("height")).alias("a")).agg(F.round(F.avg("a"), 6).alias("mean_aspect"), F.count("a").alias("n"))


@query("first_seen_dedup", DEDUP + " SELECT key, dup_of FROM d")
def first_seen_dedup(spark, sf):
    return deduped(spark, sf).select("key", "dup_of")


@query("global_dedup", M + " SELECT phash, min(member) AS member FROM m GROUP BY phash")
def global_dedup(spark, sf):
    return lake.global_dedup(manifest(spark, sf), "phash", "member").select("phash", "member")


@query("dup_of_lookup", DEDUP + " SELECT dup_of, count(*) AS copies FROM d WHERE dup_of IS NOT NULL GROUP BY dup_of")
def dup_of_lookup(spark, sf):
    return deduped(spark, sf).where("dup_of is not null").groupBy("dup_of").agg(F.count("*").alias("copies"))


PACKED = DEDUP + ", k AS (SELECT * FROM d WHERE dup_of IS NULL AND NOT corrupt), p AS (SELECT *, CAST((row_number() OVER (PARTITION BY shard_group ORDER BY shard_index, member) - 1) // 100 AS INTEGER) AS pack FROM k)"


def packed(spark, sf) -> DataFrame:
    kept = deduped(spark, sf).where("dup_of is null and not corrupt")
    return lake.pack_shards(kept, "shard_group", ["shard_index", "member"], 100).withColumnRenamed("shard", "pack")


@query("shard_packing", PACKED + " SELECT shard_group, pack, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY shard_group, pack")
def shard_packing(spark, sf):
    return packed(spark, sf).groupBy("shard_group", "pack").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


CURATED = PACKED + ", c AS (SELECT d.key, coalesce('wds-' || p.shard_group || '-' || p.pack, '') AS wds_shard, CASE WHEN d.corrupt THEN 'CORRUPT' ELSE coalesce(d.dup_of, '') END AS dup_of, d.bytes FROM d LEFT JOIN p ON p.key = d.key)"


def curated(spark, sf) -> DataFrame:
    d = deduped(spark, sf)
    p = packed(spark, sf).select("key", F.concat_ws("-", F.lit("wds"), "shard_group", F.col("pack").cast("string")).alias("wds_shard"))
    return d.join(p, "key", "left").select("key", F.coalesce("wds_shard", F.lit("")).alias("wds_shard"), F.when(F.col("corrupt"), "CORRUPT").otherwise(F.coalesce("dup_of", F.lit(""))).alias("dup_of"), "bytes")


@query("curated_rollup", CURATED + " SELECT count(*) FILTER (wds_shard <> '') AS kept, count(*) FILTER (dup_of <> '' AND dup_of <> 'CORRUPT') AS dup, count(*) FILTER (dup_of = 'CORRUPT') AS corrupt, CAST(coalesce(sum(bytes) FILTER (wds_shard <> ''), 0) AS BIGINT) AS bytes_kept, count(DISTINCT CASE WHEN wds_shard <> '' THEN wds_shard END) AS shards FROM c")
def curated_rollup(spark, sf):
    return lake.curated_rollup(curated(spark, sf))


@query("curated_status", CURATED + " SELECT CASE WHEN dup_of = 'CORRUPT' THEN 'corrupt' WHEN dup_of <> '' THEN 'dup' ELSE 'kept' END AS status, count(*) AS n FROM c GROUP BY 1")
def curated_status(spark, sf):
    return curated(spark, sf).groupBy(lake.curated_status().alias("status")).agg(F.count("*").alias("n"))


@query("stratified_cap", M + """, r AS (SELECT shard, member, row_number() OVER (PARTITION BY shard ORDER BY md5('0:' || member), member) AS k, (SELECT count(DISTINCT shard) FROM m) AS g FROM m)
SELECT shard, member FROM r WHERE k <= greatest(1, 90 // g) ORDER BY md5('0:' || member), member LIMIT 90""")
def stratified_cap(spark, sf):
    return lake.stratified_cap(manifest(spark, sf), "shard", "member", 90).select("shard", "member")


@query("shard_keep_fraction", DEDUP + ", a AS (SELECT shard, count(*) AS had, count(*) FILTER (dup_of IS NULL) AS has FROM d GROUP BY shard) SELECT shard, has, had FROM a WHERE has > 0 AND has >= CAST(0.95 AS DOUBLE) * had")
def shard_keep_fraction(spark, sf):
    d = deduped(spark, sf)
    return lake.keep_fraction(d.where("dup_of is null"), d, "shard", 0.95).select("shard", "has", "had")


@query("exact_dup_groups", M + " SELECT shard, phash, count(*) AS n FROM m GROUP BY shard, phash HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    return manifest(spark, sf).groupBy("shard", "phash").agg(F.count("*").alias("n")).where("n > 1")


@query("seen_hash_anti_join", M + " SELECT member FROM m WHERE member % 3 = 0 AND phash NOT IN (SELECT phash FROM m WHERE member % 3 <> 0)")
def seen_hash_anti_join(spark, sf):
    m = manifest(spark, sf)
    return lake.unseen(m.where("member % 3 = 0"), lake.seen_state(m.where("member % 3 = 1"), m.where("member % 3 = 2")), "phash").select("member")


@query("done_log_anti_join", M + " SELECT DISTINCT shard FROM m WHERE shard NOT IN (SELECT shard FROM m WHERE shard_index % 4 = 0)")
def done_log_anti_join(spark, sf):
    m = manifest(spark, sf)
    return lake.todo(m.select("shard").distinct(), m.where("shard_index % 4 = 0"), "shard")


@query("parts_union", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 1) GROUP BY lang")
def parts_union(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 2 = 1")).groupBy("lang").agg(F.count("*").alias("n"))


@query("hash_intersect", M + " SELECT phash FROM m WHERE shard_index < 10 INTERSECT SELECT phash FROM m WHERE shard_index >= 10")
def hash_intersect(spark, sf):
    m = manifest(spark, sf)
    return m.where("shard_index < 10").select("phash").intersect(m.where("shard_index >= 10").select("phash"))


@query("split_except", M + " SELECT mode, count(*) AS dropped FROM (SELECT mode, member FROM m EXCEPT SELECT mode, min(member) FROM m GROUP BY mode, phash) GROUP BY mode")
def split_except(spark, sf):
    m = manifest(spark, sf)
    kept = m.groupBy("mode", "phash").agg(F.min("member").alias("member")).select("mode", "member")
    return m.select("mode", "member").exceptAll(kept).groupBy("mode").agg(F.count("*").alias("dropped"))


@query("key_difference", "SELECT 'missing' AS side, lang AS key FROM (SELECT lang FROM documents EXCEPT SELECT lang FROM documents WHERE lang < 'e') UNION ALL SELECT 'unexpected', source FROM (SELECT source FROM documents WHERE source < 'src11' EXCEPT SELECT source FROM documents WHERE source > 'src1')")
def key_difference(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("lang").exceptAll(d.where("lang < 'e'").select("lang")).distinct().select(F.lit("missing").alias("side"), F.col("lang").alias("key"))
    b = d.where("source < 'src11'").select("source").subtract(d.where("source > 'src1'").select("source")).select(F.lit("unexpected").alias("side"), F.col("source").alias("key"))
    return a.unionByName(b)


@query("listing_size_mismatch", M + ", l AS (SELECT shard AS name, min(shard_index) AS i, CAST(sum(bytes) AS BIGINT) AS size FROM m GROUP BY shard) SELECT name, size + 1 AS local_size, size AS remote_size FROM l WHERE i % 2 = 0 AND name <> 'src3'")
def listing_size_mismatch(spark, sf):
    remote = manifest(spark, sf).groupBy(F.col("shard").alias("name")).agg(F.sum("bytes").alias("size"))
    odd = S.shard_index(F.col("name"), F.lit(0)) % 2 == 0
    local = remote.where(F.col("name") != "src3").withColumn("size", F.col("size") + F.when(odd, 1).otherwise(0))
    return size_mismatch(local, remote)


@query("copy_plan", M + ", l AS (SELECT shard AS name, min(shard_index) AS i, CAST(sum(bytes) AS BIGINT) AS size FROM m GROUP BY shard) SELECT name, coalesce(CASE WHEN i % 5 <> 4 THEN size END, -1) AS size FROM l WHERE (i % 5 <> 4 AND i % 3 = 1) OR i % 3 = 2")
def copy_plan(spark, sf):
    size = manifest(spark, sf).groupBy(F.col("shard").alias("name"), F.col("shard_index").alias("i")).agg(F.sum("bytes").alias("size"))
    spec = size.select("name", F.when(F.col("i") % 5 != 4, F.col("size")).alias("size"))
    listing = size.where("i % 3 <> 2").select("name", (F.col("size") + F.when(F.col("i") % 3 == 1, 1).otherwise(0)).alias("size"))
    return lake.to_copy(spec, listing).select("name", F.coalesce("size", F.lit(-1)).alias("size"))


@query("storage_rollup", "SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY ROLLUP (source, lang)")
def storage_rollup(spark, sf):
    return storage(table(spark, sf, "documents").withColumn("bytes", F.col("n_chars")), ["source", "lang"])


@query("file_kinds", "SELECT kind, count(*) AS n, round(CAST(sum(n_chars) AS DOUBLE) / 1073741824 * CAST(0.09 AS DOUBLE), 9) AS cost FROM (SELECT n_chars, CASE doc_id % 5 WHEN 0 THEN 'checkpoint' WHEN 1 THEN 'features' WHEN 2 THEN 'report' WHEN 3 THEN 'log' ELSE 'other' END AS kind FROM documents) GROUP BY kind")
def file_kinds(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".ckpt", ".NPZ", ".json", ".log", ".bin"))), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf, "documents").select("n_chars", S.file_kind(F.concat(F.lit("a/b"), suffix)).alias("kind"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.round(S.egress_cost(F.sum("n_chars")), 9).alias("cost"))


@query("redundancy_rollup", M + ", p AS (SELECT shard, phash, count(*) AS c FROM m GROUP BY shard, phash), r AS (SELECT shard, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS redundant FROM p GROUP BY shard) SELECT shard, n, redundant, round(redundant / n, 6) AS rate FROM r")
def redundancy_per_shard(spark, sf):
    return redundancy_rollup(manifest(spark, sf), "shard", "phash").select("shard", "n", "redundant", F.round("rate", 6).alias("rate"))


@query("histogram_sum", "SELECT CAST(b AS INTEGER) AS bin, count(*) FILTER (n_chars // 1000 = b) AS n FROM documents CROSS JOIN range(4) r(b) GROUP BY b")
def histogram_total(spark, sf):
    """Histograms per source, kept as arrays, then summed element by element."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.array(*[F.count_if(F.floor(F.col("n_chars") / 1000) == b) for b in range(4)]).alias("h"))
    return histogram_sum(d, "h")


@query("coded_modes", "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE -1 END AS TINYINT) AS code FROM documents")
def coded_modes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.coded(F.col("lang"), {"en": 0, "de": 1}).alias("code"))


@query("top_lengths", "SELECT n_chars, count(*) AS n FROM documents GROUP BY n_chars ORDER BY n DESC, n_chars LIMIT 12")
def top_lengths(spark, sf):
    return table(spark, sf, "documents").groupBy("n_chars").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_chars").limit(12)


@query("partition_repair", M + " SELECT shard_group, count(*) AS n FROM m GROUP BY shard_group")
def partition_repair(spark, sf):
    """Write the manifest partitioned, register it as an external table and repair its partitions; then drop both."""
    path = lake_files.write_manifest(manifest(spark, sf).drop("shard_index"))
    name = f"manifest_{uuid.uuid4().hex}"
    try:
        groups = lake_files.external_table(spark, path, name).groupBy("shard_group").agg(F.count("*").alias("n"))
        return materialize(groups, "shard-groups")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        lake_files.remove(spark, path)


@query("feature_cache", "SELECT doc_id, CAST(length(text) AS INTEGER) AS x FROM documents")
def feature_cache(spark, sf):
    """Read-through cache: the second call reads the files of the first."""
    d = table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("x"))
    key = {"tag": "chars", "size": 1, "of": lake_files.fingerprint(d, "doc_id", "x")}
    lake_files.cached(spark, lambda: d, **key)
    return lake_files.cached(spark, lambda: d, **key)
