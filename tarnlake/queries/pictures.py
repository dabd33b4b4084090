"""Queries on pictures that are made of ``part``: each part is one plain picture, as PNG, BMP or a format that isn't decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import table
from tarnlake.sources import image

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _bmp(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return head + rows.tobytes()


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, payload): gray value p_partkey % 256, 20 + p_size pixels wide and 30 high."""
    made = {0: image.encode, 1: _bmp, 2: lambda pixels: b"GIF89a" + bytes(8)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = [made[k % 3](np.full((30, 20 + n, 3), k % 256, np.uint8)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(payload, pa.binary())], names=["p_partkey", "payload"])

    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))
    return p.mapInArrow(run, "p_partkey long, payload binary")


@query("picture_facts", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'unsupported' ELSE 'ok' END AS status, CAST(CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 20 + p_size END AS INTEGER) AS width,
CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 256 AS DOUBLE) END AS mean, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 256 < 12 AS INTEGER) END AS dark,
CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 256 > 243 AS INTEGER) END AS bright FROM part""")
def picture_facts(spark, sf):
    f = image.with_facts(pictures(spark, sf))
    return f.select("p_partkey", "status", "width", F.round("mean", 4).alias("mean"), F.col("dark").cast("int").alias("dark"), F.col("bright").cast("int").alias("bright"))


@query("picture_sizes", """WITH s AS (SELECT p_partkey, 20 + p_size AS w, 30 AS h, CAST(24 AS DOUBLE) / least(20 + p_size, 30) AS s FROM part WHERE p_partkey % 3 < 2)
SELECT p_partkey, CAST(CASE WHEN s < 1 THEN greatest(24, round_even(w * s, 0)) ELSE w END AS INTEGER) AS width, CAST(CASE WHEN s < 1 THEN greatest(24, round_even(h * s, 0)) ELSE h END AS INTEGER) AS height FROM s""")
def picture_sizes(spark, sf):
    """Short sides brought down to 24, encoded anew and read again."""
    small = image.with_resized(pictures(spark, sf), 24).where("payload is not null")
    again = image.with_facts(small.select("p_partkey", "payload"))
    return again.where("status = 'ok'").select("p_partkey", "width", "height")


@query("mask_grids", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 256 > 127 THEN 196 ELSE 0 END AS BIGINT) AS cells, CAST(p_partkey % 256 > 127 AS INTEGER) AS share FROM part WHERE p_partkey % 3 < 2")
def mask_grids(spark, sf):
    g = image.with_mask_grid(pictures(spark, sf)).where("grid is not null")
    return g.select("p_partkey", F.aggregate("grid", F.lit(0).cast("long"), lambda a, x: a + x).alias("cells"), F.col("share").cast("int").alias("share"))
