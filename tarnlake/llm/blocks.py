"""Documents in blocks, and exchanges between blocks and hash buckets.

A block holds the whole texts of some documents, in the order of the scan, and is one row. Blocks are written once,
bucketed by their number: later rounds read a block where it lies and move only messages to it, never texts.

An operator that must know about equal hashes anywhere in the corpus sends each block's distinct hashes to buckets
(hash ranges), and each bucket answers the blocks. A value thus travels once a block however often it occurs there,
so a very frequent one costs a bucket an entry a block.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.kernel import release
from tarnlake.session import file_system, new_path, shuffles_removed

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 20_000
#: Blocks that one bucketed file holds, about, and so what a task of a later round reads; and the most such files.
BLOCKS_A_FILE = 4
MAX_FILES = 1 << 16
#: Blocks that share a bucket of hashes, about.
BLOCKS_A_BUCKET = 8
NO_ID = np.iinfo(np.int64).max
#: A document's number is its block's, times this, and its place there: unique, also where ids repeat or are null.
UID_STEP = 1 << 24


def dumps(*arrays) -> bytes:
    import zstandard

    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def loads(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.decompress(blob))  # noqa: S301  written by dumps in the same job


def planes(values: np.ndarray) -> np.ndarray:
    """Ascending integers as byte planes of their differences, which compress well."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, values.dtype.itemsize).T)


def unplanes(p: np.ndarray, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(p.T).view(dtype).ravel(), dtype=dtype) if p.size else np.zeros(0, dtype)


class Blocks:
    """A written table (block, docs), bucketed by block; ``buckets`` hash ranges suit its size."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
        self.spark = docs.sparkSession
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
        n = max(1, -(-size["b"] // block_bytes), -(-size["n"] // BLOCK_ROWS))
        self.buckets = max(1, 1 << max(0, (n // BLOCKS_A_BUCKET).bit_length()))
        self.files = min(MAX_FILES, max(1, -(-n // BLOCKS_A_FILE)))
        self.path, self.name = new_path(self.spark, "blocks"), f"tarnlake_blocks_{uuid.uuid4().hex}"
        built = d.mapInArrow(_build(block_bytes), "block long, docs binary").repartition(self.files, "block")
        with shuffles_removed(self.spark):
            built.write.bucketBy(self.files, "block").option("path", self.path).option("compression", "uncompressed").saveAsTable(self.name)
        self.frame = self.spark.table(self.name)

    def free(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fs, p = file_system(self.spark, self.path)
        fs.delete(p, True)


def _build(block_bytes: int):
    """Blocks of about ``block_bytes`` of text, or BLOCK_ROWS documents; a longer text is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, rows, size = TaskContext.get().partitionId() << 20, 0, [], 0, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            t = pa.table({"doc_id": pa.compute.fill_null(t.column("doc_id"), int(NO_ID)), "text": t.column("text")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), blob], names=["block", "docs"])

        for b in batches:
            at = 0
            for i, n in enumerate(pa.compute.binary_length(b.column("text")).fill_null(0).to_pylist()):
                if rows and (size + n > block_bytes or rows == BLOCK_ROWS):
                    held.append(b.slice(at, i - at))
                    yield block()
                    made, held, rows, size, at = made + 1, [], 0, 0, i
                rows, size = rows + 1, size + n
            held.append(b.slice(at))
        if rows:
            yield block()
        release()

    return run


def read_block(blob) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a block."""
    t = pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())).read_all().combine_chunks()
    text = t.column("text")
    return t.column("doc_id").to_numpy(), text.chunk(0) if text.num_chunks else pa.array([], pa.string())


def by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes."""
    bits = buckets.bit_length() - 1
    if not bits:
        return np.array([0, len(hashes)])
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def cut(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that ascending hashes fall in."""
    edges = by_bucket(hashes, buckets).tolist()
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            yield k, a, b


def per_block(blocks: Blocks, ask: Callable, schema: str, mail: DataFrame | None = None) -> DataFrame:
    """``ask(block, ids, texts, replies)`` yields record batches of ``schema`` for each block.

    ``mail`` has rows (block, bucket, blob); a block gets its own as {bucket: arrays}. Only these move.
    """
    if mail is None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, texts = read_block(b.column(1)[i])
                    yield from ask(b.column(0)[i].as_py(), ids, texts, {})
                    del ids, texts
                release()

        return blocks.frame.mapInArrow(scan, schema)

    def meet(own: pa.Table, got: pa.Table) -> pa.Table:
        replies = {k: loads(v) for k, v in zip(got.column("bucket").to_pylist(), got.column("blob").to_pylist(), strict=True)}
        ids, texts = read_block(own.column("docs")[0])
        out = pa.Table.from_batches(list(ask(own.column("block")[0].as_py(), ids, texts, replies)))
        del ids, texts, replies
        release()
        return out

    return blocks.frame.groupBy("block").cogroup(mail.groupBy("block")).applyInArrow(meet, schema)


MESSAGE = "bucket long, block long, blob binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    arrays = [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "blob"])


def per_bucket(sent: DataFrame, answer: Callable) -> DataFrame:
    """``answer([(block, arrays), ...])`` returns [(block, arrays), ...]; replies as (bucket, block, blob)."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        rows = sorted(zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True))
        got = [(k, loads(v)) for k, v in rows]
        out = pa.Table.from_batches([messages([(bucket, k, dumps(*arrays)) for k, arrays in answer(got)])])
        del got, rows
        release()
        return out

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)
