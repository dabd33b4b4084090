"""Distance of each hash to its nearest other one, in blocks of hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def nearest_distance(rows: DataFrame, cap: int = 32, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, d): 0 if the hash repeats, else the least distance to another one, at most ``cap``.

    Distinct hashes are dealt into blocks; each pair of blocks is one task, which returns a number a hash.
    """
    h = rows.where("hash is not null").select("id", "hash")
    unique = h.groupBy("hash").agg(F.count("*").alias("m"))
    n = unique.count()
    blocks = max(1, -(-n // block_rows))
    cut = F.pmod(F.xxhash64("hash"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = unique.select("hash", cut.alias("p")).withColumn("q", every)
    right = unique.select(F.col("hash").alias("other"), cut.alias("q")).withColumn("p", every)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"hash": a.column("hash") if a.num_rows else pa.array([], pa.int64()), "d": pa.array(np.full(a.num_rows, cap, np.int64))})
        x, y = a.column("hash").to_numpy().view(np.uint64), b.column("other").to_numpy().view(np.uint64)
        d = np.full(len(x), cap, np.int64)
        for s in range(0, len(x), 256):
            if len(y):
                e = np.bitwise_count(x[s : s + 256, None] ^ y[None, :]).astype(np.int64)
                e[e == 0] = cap  # itself
                d[s : s + 256] = np.minimum(d[s : s + 256], e.min(1))
        return pa.table({"hash": pa.array(x.view(np.int64)), "d": pa.array(d)})

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, "hash long, d long").groupBy("hash").agg(F.min("d").alias("d"))
    named = unique.join(found, "hash").select("hash", F.when(F.col("m") > 1, 0).otherwise(F.col("d")).cast("int").alias("d"))
    return h.join(named, "hash").select("id", "d")
