"""Embedding near-dedup by randomised-rotation binary codes.

A vector is normalised and turned by random rotations; the signs of the result are its code, and the share of the
vector that a rotation's signs keep (their inner product) is stored as the correction factor. A code's inner
product with another vector, over the factor, is an unbiased estimate of their cosine with an error of about
sqrt(1 - f * f) / f / sqrt(d - 1). Pairs whose upper bound is under the threshold are done; the others' cosine is
computed exactly, in double precision.

Which pairs meet is decided by the same codes: vectors of a label with equal bits in one of several bands are in
one bucket. As many bands are used as give a pair at the threshold a miss probability under ``MISS``. A pair is counted in its
first common band only. Equal vectors are one vector with a count. Buckets are cut into tiles of at most
``2 * TILE`` vectors; a tile emits a row for each of its vectors (links, and one edge of a spanning forest), not pairs.

Vectors of null label, null or empty vectors, and those of zero norm or with null or non-finite components link
with nothing. Vectors of different lengths don't compare. Repeated rows link with each other. Rows of a null
id count for the others and get a null component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.components import connected_components
from tarnlake.session import free, materialize, table

THRESHOLD = 0.98
MISS = 2e-4
TILE = 256
#: Standard errors between an estimate and its bounds.
SIGMAS = 5.0
SEED = 20240501


@lru_cache(8)
def rotations(d: int, count: int) -> np.ndarray:
    """``count`` random rotations of d dimensions, stacked."""
    rng = np.random.default_rng([SEED, d])
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(count)]).T


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of norm 1; neither very small nor very large components are lost on the way."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def bands(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits a band and bands: longer bands for more rows, so that buckets don't grow with them."""
    bits = min(30, max(12, math.ceil(math.log2(max(2, rows)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def encode(x: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, first rotation's code (packed) and correction factor of unit vectors."""
    d = x.shape[1]
    turned = x @ rotations(d, -(-bits * count // d))
    signs = turned >= 0
    factor = np.abs(turned[:, :d]).sum(1) / math.sqrt(d)
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)
    keys = (signs[:, : bits * count].reshape(len(x), count, bits) @ weights).astype(np.int32)
    return keys, np.packbits(signs[:, :d], axis=1), factor


def _codes(bits: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            d = np.asarray(pa.compute.list_value_length(lists))
            keys, code, factor = [None] * b.num_rows, [None] * b.num_rows, np.zeros(b.num_rows)
            for size in np.unique(d):
                own = np.flatnonzero(d == size)
                x = np.asarray(lists.take(pa.array(own)).flatten(), np.float64).reshape(len(own), size)
                k, c, f = encode(units(x), bits, count)
                for i, j in enumerate(own):
                    keys[j], code[j] = k[i], c[i].tobytes()
                factor[own] = f
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int32())), pa.array(code, pa.binary()), pa.array(factor)], names=["rep", "keys", "code", "factor"])

    return run


def links_in(x: np.ndarray, code: np.ndarray, factor: np.ndarray, keys: np.ndarray, band: int, threshold: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) linked and met here first."""
    d = x.shape[1]
    unit = units(x)
    signs = np.unpackbits(code, axis=1)[:, :d].astype(np.float32) * 2 - 1
    turned = (unit @ rotations(d, 1)).astype(np.float32)
    estimate = (signs[a] @ turned[b].T) / (math.sqrt(d) * factor[a, None])
    error = np.sqrt(np.maximum(0, 1 - factor[a] ** 2)) / factor[a] / math.sqrt(max(1, d - 1))
    i, j = np.nonzero(estimate + SIGMAS * error[:, None] >= threshold)
    i, j = a[i], b[j]
    i, j = i[i != j], j[i != j]
    exact = np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold
    i, j = i[exact], j[exact]
    if band:
        new = ~(keys[i, :band] == keys[j, :band]).any(1)
        i, j = i[new], j[new]
    return i, j


def _tile(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("chunk", "ascending"), ("rep", "ascending")]).combine_chunks()
        n = t.num_rows
        rep, many = t.column("rep").to_numpy(), t.column("many").to_numpy()
        x = np.asarray(t.column("embedding").chunk(0).flatten(), np.float64).reshape(n, -1)
        keys = np.asarray(t.column("keys").chunk(0).flatten()).reshape(n, -1)
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(n, -1)
        chunk, p, q = t.column("chunk").to_numpy(), t.column("p")[0].as_py(), t.column("q")[0].as_py()
        a, b = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
        i, j = links_in(x, code, t.column("factor").to_numpy(), keys, t.column("band")[0].as_py(), threshold, a, b)
        links = np.bincount(i, many[j], minlength=n)
        if p != q:
            links += np.bincount(j, many[i], minlength=n)
        root = np.arange(n)
        while True:  # labels fall to the least of their links
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.table({"a": pa.array(rep), "b": pa.array(rep[root]), "links": pa.array(links.astype(np.int64))}).filter(pa.array((links > 0) | (root != np.arange(n))))

    return run


def _placed(distinct: DataFrame, coded: DataFrame) -> DataFrame:
    """Where each vector goes: its buckets of two and more, and there the tiles (p, q) of its chunk."""
    each = distinct.select("rep", "label", F.size("embedding").alias("d")).join(coded.select("rep", "keys"), "rep")
    each = each.select("rep", "label", "d", F.posexplode("keys").alias("band", "key"))
    bucket = ["label", "d", "band", "key"]
    size = each.groupBy(*bucket).agg(F.count("*").alias("c")).where("c > 1")
    placed = each.join(size, bucket).withColumn("chunks", F.ceil(F.col("c") / TILE).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return tiled.select("rep", *bucket, "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda e: e != 0), F.lit(False))
    distinct = v.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    distinct = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    bits, count = bands(distinct.count(), threshold)
    coded = distinct.select("rep", "embedding").mapInArrow(_codes(bits, count), "rep long, keys array<int>, code binary, factor double")
    coded = materialize(coded, "codes")
    payload = distinct.select("rep", "embedding", "many").join(coded, "rep")
    tiles = _placed(distinct, coded).join(payload, "rep").groupBy("label", "d", "band", "key", "p", "q")
    found = materialize(tiles.applyInArrow(_tile(threshold), "a long, b long, links long"), "links")
    free(coded)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    named = distinct.join(links, "rep", "left").join(component, "rep", "left")
    n = (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n")
    named = materialize(named.select(F.col("label").alias("l"), F.col("embedding").alias("e"), n, "least", F.coalesce("component", "rep").alias("c")), "named-vectors")
    least = materialize(named.groupBy("c").agg(F.min("least").alias("component")), "components")
    named_least = named.drop("least").join(least, "c")
    out = v.withColumn("key", F.when(usable, F.col("embedding"))).join(named_least, (F.col("label") == F.col("l")) & (F.col("key") == F.col("e")), "left")
    component_id = F.when(F.col("c").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    kept = F.coalesce(F.col("vec_id") == component_id, F.lit(False))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), kept.alias("kept"))
    out = materialize(out, "near-vectors")
    free(distinct, found, named, least)
    return out


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= CAST(0.98 AS DOUBLE)),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.c = l.a),
c AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a
"""

QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES: dict[str, str] = {"op4_embedding_dedup": ORACLE}
