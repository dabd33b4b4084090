"""A finite, resumable, exactly-once stream of item batches from archives.

Each epoch visits all items once: archives in an order seeded by (seed, epoch), members by (seed, epoch, archive). Batches
are full, but a tail of one item joins the batch before it. The offset is the number of batches done since the
first epoch's start, with the manifest's fingerprint: a checkpoint of another manifest is refused. What a batch holds depends on
nothing but manifest, seed and number, so a restart replays only what the sink hadn't committed.

The manifest lists archives. An archive has its ``members``, or their ``count`` only and a Parquet folder with them
(``members_at``, column member) that workers can open: then the driver plans batches by the counts alone, and workers
read and order the members of the archives that their batch touches.

An item that can't be read becomes a placeholder with status ``unreadable``, so that no batch shrinks; one that isn't
an image by its first bytes keeps its bytes and has status ``undecodable``.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tarnlake.operators.lake import batch_count

SCHEMA = "epoch int, batch long, pos int, archive string, member string, payload binary, status string"
MAGIC = (b"\x89PNG", b"\xff\xd8\xff", b"BM", b"RIFF")


def fingerprint(archives: list[dict]) -> str:
    return hashlib.sha256(json.dumps(sorted(archives, key=lambda a: str(a["id"])), sort_keys=True).encode()).hexdigest()


def _key(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def epoch_archives(archives: list[dict], seed: int, epoch: int) -> list[dict]:
    """The archives in the epoch's order."""
    return sorted(archives, key=lambda a: (_key(seed, epoch, a["id"]), str(a["id"])))


def epoch_members(archive: dict, seed: int, epoch: int) -> pa.ChunkedArray:
    """An archive's members in the epoch's order, by digest; equal digests are of equal names. 16 bytes a member and the names, no Python objects."""
    found = pa.chunked_array([archive["members"]], pa.large_string()) if "members" in archive else _listed(archive["members_at"])
    begin = hashlib.md5(f"{seed}:{epoch}:{archive['id']}:".encode())

    def digest(member: str) -> bytes:
        h = begin.copy()
        h.update(member.encode())
        return h.digest()

    names = (m for k in range(0, len(found), 8192) for m in found.slice(k, 8192).to_pylist())
    keys = np.fromiter(map(digest, names), "S16", len(found))
    return found.take(pa.array(np.argsort(keys, kind="stable")))


def epoch_items(archives: list[dict], seed: int, epoch: int) -> list[tuple[str, str]]:
    """(archive, member) of all items in the epoch's order."""
    return [(str(a["id"]), m) for a in epoch_archives(archives, seed, epoch) for m in epoch_members(a, seed, epoch).to_pylist()]


def _listed(folder: str) -> pa.ChunkedArray:
    import pyarrow.parquet as pq

    return pq.read_table(folder.removeprefix("file://").removeprefix("file:"), columns=["member"]).column(0).cast(pa.large_string()).fill_null("None")


@lru_cache(2)
def _ordered(archive: str, seed: int, epoch: int) -> pa.ChunkedArray:
    """Kept for the batches of one archive that a worker reads one after the other; a batch touches the next one at its edge."""
    return epoch_members(json.loads(archive), seed, epoch)


def size_of(archive: dict) -> int:
    return len(archive["members"]) if "members" in archive else int(archive["count"])


def cut_of(k: int, n: int, size: int) -> tuple[int, int]:
    """Where batch k of n items begins and ends."""
    return k * size, n if k == batch_count(n, size) - 1 else (k + 1) * size


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    return [cut_of(k, n, size) for k in range(batch_count(n, size))]


class Batch(InputPartition):
    """Ranges (archive, begin, end) of archives' ordered members."""

    def __init__(self, epoch: int, batch: int, ranges: list[tuple[dict, int, int]]):
        self.epoch, self.batch, self.ranges = epoch, batch, ranges


class BatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        with open(options["manifest"]) as f:  # on the driver; one entry an archive
            found = json.load(f)
        self.archives, self.print = found["archives"], fingerprint(found["archives"])
        if found.get("fingerprint", self.print) != self.print:
            raise ValueError("the manifest doesn't have the fingerprint that it states")
        self.seed, self.size, self.epochs = int(options.get("seed", 0)), int(options["batchSize"]), int(options.get("epochs", 1))
        self.per_trigger, self.folder = int(options.get("batchesPerTrigger", 1)), options.get("folder", "")
        self.items = sum(map(size_of, self.archives))
        self.batches = batch_count(self.items, self.size)
        self.order: dict[int, tuple[list[dict], list[int]]] = {}
        self.at = 0

    def _offset(self, n: int) -> dict:
        return {"done": n, "epoch": n // self.batches, "batch": n % self.batches, "fingerprint": self.print}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.per_trigger, self.epochs * self.batches)
        return self._offset(self.at)

    def _ranges(self, epoch: int, begin: int, end: int) -> list[tuple[dict, int, int]]:
        if epoch not in self.order:
            archives = epoch_archives(self.archives, self.seed, epoch)
            self.order = {epoch: (archives, [0, *accumulate(map(size_of, archives))])}
        archives, edges = self.order[epoch]
        out, k = [], bisect_right(edges, begin) - 1
        while k < len(archives) and edges[k] < end:
            a, b = max(begin, edges[k]) - edges[k], min(end, edges[k + 1]) - edges[k]
            if b > a:
                out.append((archives[k], a, b))
            k += 1
        return out

    def partitions(self, start: dict, end: dict) -> list[Batch]:
        for o in (start, end):
            if o["fingerprint"] != self.print:
                raise ValueError("the checkpoint belongs to another manifest")
        self.at = max(self.at, end["done"])
        out = []
        for n in range(start["done"], end["done"]):
            epoch, k = divmod(n, self.batches)
            out.append(Batch(epoch, k, self._ranges(epoch, *cut_of(k, self.items, self.size))))
        return out

    def read(self, partition: Batch) -> Iterator[tuple]:
        pos = 0
        for a, begin, end in partition.ranges:
            archive = str(a["id"])
            opened = None  # one handle an archive and batch
            for member in _ordered(json.dumps(a, sort_keys=True), self.seed, partition.epoch).slice(begin, end - begin).to_pylist():
                payload, status = None, "listed"
                if self.folder:
                    try:
                        if opened is None:
                            opened = zipfile.ZipFile(f"{self.folder}/{archive}.zip")
                        payload = opened.read(member)
                        status = "ok" if payload.startswith(MAGIC) else "undecodable"
                    except (KeyError, OSError, zipfile.BadZipFile, zipfile.zlib.error):
                        payload, status = b"", "unreadable"
                yield partition.epoch, partition.batch, pos, archive, member, payload, status
                pos += 1
            if opened is not None:
                opened.close()

    def commit(self, end: dict) -> None:
        """Consumed batches need no clean-up: the checkpoint holds the cursor."""


class ArchiveBatches(DataSource):
    """``spark.readStream.format("archive_batches")`` with options manifest, batchSize, epochs, seed, folder."""

    @classmethod
    def name(cls) -> str:
        return "archive_batches"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BatchReader:
        return BatchReader(self.options)
