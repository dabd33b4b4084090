"""Session factory and the shared-storage helpers that every multi-job operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: With it, the shuffle files of a write go as soon as the table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What an Arrow batch to a Python worker holds at most. Spark's own bound, 64 MB, is for each task: once in the JVM, outside
#: its heap and up to three times while it grows, and once more in the worker.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def get_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session to the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tarnlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or what the context's checkpoint folder was set to.

    Where neither is set, a local session (one machine, one JVM) gets a temporary folder; on a cluster that would be
    a folder that other machines don't see, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnlake-"))
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver's JVM ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/tarnlake/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here free their shuffle files when they end; Spark versions that can't, keep them for the collector."""
    try:
        before = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
    except PySparkException:
        before = None
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES at most; a lower bound stays. Results don't depend on it."""
    try:
        before = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCHES))
        spark.conf.set(BATCHES, str(min(before, BATCH_BYTES)))
    except PySparkException:
        pass  # Spark versions without this bound


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost executor costs no rework.

    The table goes with ``free`` after its last reader, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnlake_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` wrote. Nothing that reads them may run any more."""
    for t in tables:
        path = getattr(t, "_tarnlake_path", None)
        if path:
            fs, p = file_system(t.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
