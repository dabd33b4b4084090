"""Curation from end to end: archives of pictures to packed shards of resized, distinct ones, and the curated catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.lake import first_seen, pack_shards
from tarnlake.session import free, materialize
from tarnlake.sources import archives, image
from tarnlake.sources.lake import read_parts

CURATED = "wds_shard string, key string, src_shard string, src_member string, bytes bigint, width int, height int, phash string, dup_of string, shard_group string"


def curate(spark: SparkSession, source: str, out: str, size: int = 224, pack: int = 1000) -> DataFrame:
    """Read all archives below ``source``; write tars to ``out``/shards and the catalog to ``out``/curated; return the catalog.

    A member that can't be decoded whole is not kept (``dup_of`` is CORRUPT, or UNSUPPORTED for a format that isn't decoded);
    nor is one whose perceptual hash an earlier member of its shard group has (``dup_of`` is that one's key). The others are
    resized and packed, ``pack`` to a tar, in the order of archive and member. Tars and catalog are written anew.
    """
    key = F.concat_ws("/", "archive", "member")
    rows = archives.read_archives(spark, source).withColumn("shard", F.col("archive")).withColumn("key", key)
    read = materialize(archives.with_group(rows), "members")
    facts = image.with_facts(read).withColumn("corrupt", F.col("status") != "ok")
    digest = F.when(~F.col("corrupt"), F.col("phash"))
    seen = first_seen(facts.withColumn("digest", digest), "shard_group", "digest", "key", ["shard", "index"])
    seen = materialize(seen.drop("digest"), "seen")
    kept = pack_shards(seen.where("not corrupt and dup_of is null").select("key", "shard_group", "shard", "index"), "shard_group", ["shard", "index"], pack, "pack")
    kept = materialize(kept.select("key", F.format_string("wds-%s-%05d", "shard_group", "pack").alias("wds_shard")), "kept")

    small = image.with_resized(read.select("key", "payload").join(kept, "key"), size).where("payload is not null")
    member = F.concat(F.regexp_replace("key", r"[/\\\\]", "__"), F.lit(".png"))
    small = materialize(small.select("key", F.col("wds_shard").alias("tar"), member.alias("member"), "payload", F.octet_length("payload").cast("long").alias("size"), "width", "height"), "resized")
    archives.write_named_tars(small, f"{out}/shards")

    new = small.select("key", F.col("tar").alias("wds_shard"), "size", F.col("width").alias("w"), F.col("height").alias("h"))
    dup = F.when(F.col("status") == "unsupported", "UNSUPPORTED").when(F.col("corrupt"), "CORRUPT").otherwise(F.coalesce("dup_of", F.lit("")))
    curated = seen.join(new, "key", "left").select(
        F.coalesce("wds_shard", F.lit("")).alias("wds_shard"), "key", F.col("shard").alias("src_shard"), F.col("member").alias("src_member"),
        F.coalesce("size", "bytes").alias("bytes"), F.coalesce("w", "width").alias("width"), F.coalesce("h", "height").alias("height"),
        "phash", dup.alias("dup_of"), "shard_group",
    )
    curated.repartition("shard_group").write.mode("overwrite").partitionBy("shard_group").parquet(f"{out}/curated")
    free(read, seen, kept, small)
    return read_parts(spark, f"{out}/curated", CURATED)
