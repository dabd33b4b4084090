"""Lake tables on shared storage: schemas, partitioned writers, external tables, caches and small files."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.functions import scalars as S
from tarnlake.operators.splits import labelled
from tarnlake.session import file_system, new_path, shared_dir

MANIFEST = "shard string, member string, bytes bigint, sha256 string, ext string, width int, height int, mode string, phash string, corrupt boolean, shard_group string"
INGEST_LOG = "name string, id bigint, key string, bytes bigint, sha256 string, ts double"


def write_manifest(rows: DataFrame, path: str | None = None, codec: str = "snappy") -> str:
    """One folder a shard group; a group written again replaces only its own folder."""
    path = path or new_path(rows.sparkSession, "manifest")
    writer = rows.repartition("shard_group").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", codec).partitionBy("shard_group").parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def read_parts(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All parts under a path; an empty or missing one is an empty table of the schema."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def external_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """An external table over a partitioned folder, its partitions found by MSCK REPAIR."""
    name = name or f"manifest_{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (shard_group) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """sha256 of the rows, whatever their order and partitions: counts and sums of their hashes, digested."""
    h = rows.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))
    r = h.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor("a")).first()
    return hashlib.sha256(json.dumps([str(x) for x in r]).encode()).hexdigest()


def cached(spark: SparkSession, build: Callable[[], DataFrame], **key) -> DataFrame:
    """The table for a key (every parameter is part of it): read if it was written to the end, else built and written.

    Unlike other written tables it stays, for later sessions; ``remove`` its folder to forget it.
    """
    digest = hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark).rstrip('/')}/tarnlake/features/cache_key={digest}"
    fs, done = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, name, size) of the files below a path whose name ends with the suffix, whatever its case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return files.where(F.lower("path").endswith(suffix.lower())).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def tsv_members(spark: SparkSession, path: str) -> DataFrame:
    """(shard_idx, member) of a member list; only the first tab parts, so names may hold tabs."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.instr("value", "\t") > 0).select(cut[0].cast("int").alias("shard_idx"), cut[1].alias("member"))


def hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """(stem, hash) of a JSON object of hex hashes by file stem; the hash as a bigint of the same bits."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("stem", "hex"))
    return found.select("stem", S.hash_bits(F.col("hex")).alias("hash"))


def labelled_images(spark: SparkSession, folder: str, labels: DataFrame, key: str = "stem", column: str = "finding") -> DataFrame:
    """(path, size, stem, relative, finding): the pictures below a folder with the label that ``labels`` (key, column) has for
    their stem, else the finding that their path names; pictures with neither are left out. Contents aren't read."""
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    files = listing(spark, folder).where(S.has_extension(F.col("path")))
    relative = F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})")
    found = files.withColumn("relative", relative).withColumn(key, F.regexp_replace("name", r"\.[^.]*$", ""))
    return labelled(found, labels, key, column, S.path_labels(F.col("relative"))[2]).select("path", "size", key, "relative", column)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header; header blanks are trimmed, values too."""
    d = spark.read.option("header", True).schema(schema).csv(path) if schema else spark.read.option("header", True).csv(path)
    return d.select(*[(F.trim(F.col(f"`{f.name}`")) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`")).alias(f.name.strip()) for f in d.schema])


def column_starting(d: DataFrame, prefix: str) -> str:
    return next(c for c in d.columns if c.startswith(prefix))


def result_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Result JSON files, one document each, with their file name; unreadable files are left out."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType(fields.fields).add("_corrupt", "string")
    d = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = d.withColumn("source", F.col("_metadata.file_name"))
    return d.where(F.col("_corrupt").isNull()).drop("_corrupt")


def write_csv(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_atomically(path: str, value: dict) -> None:
    """A document on the driver: written aside, flushed, renamed."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "w") as f:
        json.dump(value, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report as a Markdown table; one of over ``most`` rows is no report, and an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows; write it as a table")
    head = rows.columns
    shown = lambda v: "–" if v is None or v != v else ("T" if v is True else "F" if v is False else f"{v:.4f}" if isinstance(v, float) else str(v))
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in found])
