"""Streaming jobs: drain a finite stream into a table once each, incremental ingest with logs, receipts of phases."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import file_system, new_path
from tarnlake.streaming.source import ArchiveBatches

RESUBMIT = 75


def drain(spark: SparkSession, options: dict, out: str, checkpoint: str, batches: int | None = None, timeout: float | None = None, stall: float = 300) -> list[dict]:
    """Consume the stream into ``out`` until it ends, or until ``batches`` triggers are committed; returns each trigger's rows and seconds.

    The sink writes each trigger to a folder of its number, so that a replay overwrites itself. A stream that hasn't
    ended in ``timeout`` seconds, if given, or that commits no trigger for ``stall`` seconds, is an error: what is there then isn't
    the whole table. How long a stream takes grows with its table, so there is no limit on the whole by default.
    """
    spark.dataSource.register(ArchiveBatches)
    reader = spark.readStream.format("archive_batches")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    done = [0]

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/trigger={number}")
        done[0] += 1

    q = reader.load().writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    ended, error = threading.Event(), []

    def wait() -> None:
        try:
            q.processAllAvailable()
        except Exception as e:  # noqa: BLE001  raised below, on the caller's thread
            error.append(e)
        ended.set()

    threading.Thread(target=wait, daemon=True).start()
    began = moved = time.time()
    seen = 0
    try:
        while not ended.wait(0.02) and not (batches is not None and done[0] >= batches):
            now = time.time()
            if done[0] > seen:
                seen, moved = done[0], now
            if timeout is not None and now > began + timeout:
                raise TimeoutError(f"the stream hasn't ended in {timeout:g} s")
            if now > moved + stall:
                raise TimeoutError(f"the stream has committed nothing for {stall:g} s")
        if error and not (batches is not None and done[0] >= batches):
            raise RuntimeError(str(error[0])) from error[0]
        return [_progress(p) for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def _progress(p: dict) -> dict:
    """A trigger's number, rows, seconds of work on them and seconds until there were any."""
    took = p["durationMs"]
    work = took.get("addBatch", 0) / 1000
    return {"trigger": p["batchId"], "rows": p["numInputRows"], "work_s": work, "wait_s": took.get("triggerExecution", 0) / 1000 - work}


def telemetry(rows: DataFrame) -> DataFrame:
    """(epoch, attempts, failures, bytes): what a stream's rows say of its reading; placeholders are failures."""
    failed = F.count_if(~F.col("status").isin("ok", "listed"))
    size = F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long")
    return rows.groupBy("epoch").agg(F.count("*").alias("attempts"), failed.alias("failures"), size.alias("bytes"))


def batch_stream_table(spark: SparkSession, options: dict, stops: tuple[int, ...] = ()) -> DataFrame:
    """The whole stream's rows; ``stops``: the query is stopped after so many triggers and started again."""
    base = new_path(spark, "stream").removeprefix("file://")
    for n in (*stops, None):
        drain(spark, options, f"{base}/out", f"{base}/checkpoint", n)
    return spark.read.parquet(f"{base}/out")


def write_stream_manifest(rows: DataFrame, archive: str, member: str) -> str:
    """A manifest of rows' archives and members in the shared folder: members as tables, one folder an archive, and a
    small list of archives with their counts, which is all that the driver reads. Returns the list's path."""
    spark = rows.sparkSession
    base = new_path(spark, "stream-manifest")
    named = rows.select(F.col(archive).cast("string").alias("archive"), F.col(member).cast("string").alias("member"))
    numbered = named.select("archive").distinct().select("archive", F.md5("archive").alias("part"))
    named.withColumn("part", F.md5("archive")).write.partitionBy("part").parquet(f"{base}/members")
    counts = named.groupBy("archive").agg(F.count("*").alias("n")).join(numbered, "archive").orderBy("archive").collect()  # one row an archive
    found = [{"id": r["archive"], "count": r["n"], "members_at": f"{base}/members/part={r['part']}"} for r in counts]
    fs, p = file_system(spark, f"{base}/manifest.json")
    stream = fs.create(p, True)
    try:
        stream.write(json.dumps({"archives": found}).encode())
    finally:
        stream.close()
    return f"{base}/manifest.json".removeprefix("file://").removeprefix("file:")


def ingest_new(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """Read files that no earlier call has read; good rows are appended, items with failures go to the failed log only,
    so that a later call can take them up. Returns the items done so far."""

    def sink(rows: DataFrame, number: int) -> None:
        out = transform(rows).persist()
        out.where("ok").drop("ok").write.mode("overwrite").parquet(f"{base}/data/trigger={number}")
        state = out.groupBy("item").agg(F.bool_and("ok").alias("ok"))
        state.where("ok").select("item").write.mode("overwrite").parquet(f"{base}/done/trigger={number}")
        state.where("not ok").select("item").write.mode("overwrite").parquet(f"{base}/failed/trigger={number}")
        out.unpersist()

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/done")


def run_phases(phases: list[tuple[str, Callable[[], int]]], receipts: str, most: int = 10) -> list[str]:
    """Run phases that have no receipt yet. A phase returns 0 (a receipt is written) or 75 (it has saved its state and is
    run again); anything else stops the chain. Returns the names that were run."""
    os.makedirs(receipts, exist_ok=True)
    ran = []
    for name, phase in phases:
        path = os.path.join(receipts, f"{name}.done")
        for _ in range(most):
            if os.path.exists(path):
                break
            code = phase()
            ran.append(name)
            if code == 0:
                with open(path + ".part", "w") as f:
                    f.write(str(time.time()))
                os.replace(path + ".part", path)
            elif code != RESUBMIT:
                raise RuntimeError(f"phase {name} ended with {code}")
    return ran
