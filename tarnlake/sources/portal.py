"""A client for gated portals: short-lived signed addresses, ranged and resumable downloads, and remote zip listings.

Retries: network errors and 5xx with waits of 1, 2, 4 .. seconds until a deadline; 401 and 403 renew the address once; any other 4xx
fails at once. Signed addresses and credentials never appear in messages.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tarfile
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.lake import to_copy
from tarnlake.session import file_system
from tarnlake.sources.lake import INGEST_LOG, append_log


class PortalError(RuntimeError):
    pass


class PortalClient:
    def __init__(self, sign: Callable[[str], str], deadline_s: float = 3 * 3600, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, fetch: Callable | None = None):
        """``sign(file_id)`` gives a fresh address. ``fetch(url, headers)`` returns (status, headers, body)."""
        self.sign, self.deadline_s, self.wait, self.clock, self.fetch = sign, deadline_s, wait, clock, fetch or _fetch

    def get(self, file_id: str, start: int, end: int | None = None) -> tuple[int, dict, bytes]:
        begun, pause, renewed, url = self.clock(), 1.0, False, self.sign(file_id)
        headers = {"Range": f"bytes={start}-{'' if end is None else end - 1}"} if start or end is not None else {}
        while True:
            try:
                status, got, body = self.fetch(url, headers)
            except OSError:
                status, got, body = 0, {}, b""
            if status in (200, 206, 416):
                return status, {k.lower(): v for k, v in got.items()}, body
            if status in (401, 403) and not renewed:
                renewed, url = True, self.sign(file_id)
                continue
            if 400 <= status < 500:
                raise PortalError(f"file {file_id}: refused with status {status}")
            if self.clock() - begun + pause > self.deadline_s:
                raise PortalError(f"file {file_id}: no answer before the deadline")
            self.wait(pause)
            pause = min(60.0, pause * 2)

    def download(self, file_id: str, have: bytes, size: int | None) -> bytes:
        """The whole file, going on from what is there. A reply that ignores the range starts anew."""
        if size is not None and len(have) == size:
            return have
        if size is not None and len(have) > size:
            have = b""
        status, headers, body = self.get(file_id, len(have))
        if status == 416:
            status, headers, body = self.get(file_id, 0)
            have = b""
        if status == 206 and have:
            m = re.match(r"bytes (\d+)-(\d+)/(\d+|\*)", headers.get("content-range", ""))
            if not m or int(m[1]) != len(have):
                raise PortalError(f"file {file_id}: the reply is of another range")
            body = have + body
        if size is not None and len(body) > size:
            raise PortalError(f"file {file_id}: longer than declared")
        if size is not None and len(body) < size:
            return self.download(file_id, body, size) if len(body) > len(have) else self._short(file_id)
        return body

    def _short(self, file_id: str) -> bytes:
        raise PortalError(f"file {file_id}: the download doesn't go on")

    def download_to(self, file_id: str, path: str, size: int, chunk: int = 8 << 20) -> str:
        """The whole file at ``path``, in ranges of ``chunk`` bytes; returns its sha256.

        What is there of ``path``.part from an earlier try is gone on with. A reply that ignores the range starts anew;
        a range that isn't the one asked for, or a file of another size, is an error.
        """
        part = path + ".part"
        with open(part, "ab") as f:
            if f.tell() > size:
                f.truncate(0)
                f.seek(0)
            while (at := f.tell()) < size:
                status, headers, body = self.get(file_id, at, min(size, at + chunk))
                if status == 206:
                    m = re.match(r"bytes (\d+)-(\d+)/(\d+|\*)", headers.get("content-range", ""))
                    if m and int(m[1]) != at:
                        raise PortalError(f"file {file_id}: the reply is of another range")
                else:
                    f.truncate(0)
                    f.seek(0)
                    at = 0
                if at + len(body) > size or not body or status == 416:
                    raise PortalError(f"file {file_id}: the download isn't of the declared size")
                f.write(body)
            f.flush()
            os.fsync(f.fileno())
        digest = hashlib.sha256()
        with open(part, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        os.replace(part, path)
        return digest.hexdigest()

    def zip_names(self, file_id: str, size: int) -> list[str]:
        """Members of a remote zip by its central directory, without its data."""
        return zipfile.ZipFile(RangeFile(self, file_id, size)).namelist()


    def tar_members(self, file_id: str, size: int, chunk: int = 4 << 20) -> Iterator[tuple[str, int, bytes]]:
        """(name, size, payload) of a remote tar's files, in order, read in ranges of about ``chunk`` bytes."""
        with tarfile.open(fileobj=io.BufferedReader(RangeFile(self, file_id, size), chunk), mode="r:") as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, t.extractfile(m).read()


def read_remote_tars(spec: DataFrame, client: Callable[[], PortalClient]) -> DataFrame:
    """Members of the remote tars of ``spec`` (id, name, size): (archive, index, member, bytes, payload), one task a tar."""
    work = spec.select("name", F.col("id").cast("string").alias("id"), F.col("size").cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portal = client()
        for b in batches:
            for r in b.to_pylist():
                for i, (name, size, payload) in enumerate(portal.tar_members(r["id"], r["size"])):
                    arrays = [pa.array([r["name"]]), pa.array([i], pa.int32()), pa.array([name]), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["archive", "index", "member", "bytes", "payload"])

    return work.repartition(max(1, min(work.count(), 1000)), "name").mapInArrow(run, "archive string, index int, member string, bytes long, payload binary")


class RangeFile(io.RawIOBase):
    """A remote file as a seekable one; reads are ranges."""

    def __init__(self, client: PortalClient, file_id: str, size: int):
        self.client, self.file_id, self.size, self.at = client, file_id, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = {0: 0, 1: self.at, 2: self.size}[whence] + offset
        return self.at

    def readinto(self, b) -> int:
        got = self.read(len(b))
        b[: len(got)] = got
        return len(got)

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if end <= self.at:
            return b""
        status, _, body = self.client.get(self.file_id, self.at, end)
        if status == 200:
            body = body[self.at : end]
        self.at += len(body)
        return body


def _fetch(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


SOURCES = ("local_zip", "local_tar", "remote_tar", "portal_zip")


def resolve_source(configured: str, override: str | None = None, environment: str | None = None) -> str:
    """Override before environment before configuration; only the known names."""
    name = override or environment or configured
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; one of {', '.join(SOURCES)}")
    return name


def ingest(spec: DataFrame, listing: DataFrame, folder: str, log: str, client: Callable[[], PortalClient]) -> DataFrame:
    """Fetch the files of ``spec`` (id, name, size) that ``listing`` (name, size) doesn't have whole into ``folder``, one
    task a file, and append a row a file to the JSON log; returns the log.

    ``folder`` must be one that workers can write to. A task that is lost is run again and goes on with what is there.
    """
    spark = spec.sparkSession
    work = to_copy(spec, listing).select("name", F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portal = client()
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for r in b.to_pylist():
                digest = portal.download_to(str(r["id"]), os.path.join(folder, r["name"]), r["size"])
                row = {"name": r["name"], "id": r["id"], "key": r["name"], "bytes": r["size"], "sha256": digest, "ts": time.time()}
                yield pa.RecordBatch.from_pylist([row])

    files = work.count()
    if files:
        append_log(work.repartition(min(files, 1000), "name").mapInArrow(run, INGEST_LOG), log)
    return _read_log(spark, log)


def _read_log(spark, log: str) -> DataFrame:
    fs, p = file_system(spark, log)
    return spark.read.schema(INGEST_LOG).json(log) if fs.exists(p) else spark.createDataFrame([], INGEST_LOG)
