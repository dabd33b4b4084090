"""Archives of images as tables: zip and tar readers (one partition an archive), a rotating tar writer, a catalog.

``spark.read.format("archive")`` with option ``path`` (a folder or file that workers can open) gives one row a member: archive,
index, member, bytes, payload. A member that can't be read has a null payload. A 7z archive is refused: no codec for
it is at hand.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tarnlake.functions.scalars import EXTENSIONS
from tarnlake.sources import image

MEMBER = "archive string, index int, member string, bytes long, payload binary"
KINDS = (".zip", ".tar")


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _safe(name: str) -> bool:
    return not (name.startswith("/") or ".." in name.split("/"))


def members(path: str) -> Iterator[tuple[str, int, bytes | None]]:
    """(name, size, payload) of regular members with an image extension, in archive order; one open handle."""
    ok = lambda n: _safe(n) and n.lower().endswith(EXTENSIONS)
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            for m in z.infolist():
                if not m.is_dir() and ok(m.filename):
                    try:
                        yield m.filename, m.file_size, z.read(m)
                    except (zipfile.BadZipFile, zipfile.zlib.error, OSError):
                        yield m.filename, m.file_size, None
    else:
        with tarfile.open(path, "r:") as t:
            for m in t:
                if m.isfile() and ok(m.name):
                    f = t.extractfile(m)
                    yield m.name, m.size, f.read() if f else None


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs)
        if any(p.lower().endswith(".7z") for p in found):
            raise NotImplementedError("7z archives are not supported: no codec is available")
        self.found = [p for p in found if p.lower().endswith(KINDS)]

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.found] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if partition.path:
            for i, (name, size, payload) in enumerate(members(partition.path)):
                yield os.path.basename(partition.path), i, name, size, payload


class TarCommit(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class TarWriter(DataSourceWriter):
    """Tars of rows (member, payload), of at most ``pack`` members each and named by task; or of rows (tar, member,
    payload), which must come sorted by tar: then each goes to the tar of its name. Empty tars are never left."""

    def __init__(self, path: str, pack: int, named: bool):
        self.path, self.pack, self.named = path.removeprefix("file://"), pack, named

    def write(self, rows) -> TarCommit:
        from pyspark import TaskContext

        part, n, tar, name, files = TaskContext.get().partitionId(), 0, None, None, []
        os.makedirs(self.path, exist_ok=True)
        for r in rows:
            own = r["tar"] if self.named else f"part-{part:05d}-{n // self.pack:05d}"
            if own != name:
                if tar:
                    tar.close()
                name = own
                files.append(os.path.join(self.path, f"{name}.tar"))
                tar = tarfile.open(files[-1] + ".part", "w")
            info = tarfile.TarInfo(r["member"])
            info.size = len(r["payload"])
            tar.addfile(info, io.BytesIO(bytes(r["payload"])))
            n += 1
        if tar:
            tar.close()
        return TarCommit(files)

    def commit(self, messages) -> None:
        for m in messages:
            for f in m.files if m else ():
                os.replace(f + ".part", f)

    def abort(self, messages) -> None:
        for m in messages:
            for f in m.files if m else ():
                if os.path.exists(f + ".part"):
                    os.remove(f + ".part")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options["path"], int(self.options.get("pack", 1000)), "tar" in schema.fieldNames())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", path).load()


def write_tars(rows: DataFrame, path: str, pack: int) -> None:
    """Tars of (member, payload) rows, at most ``pack`` members each, cut in every task."""
    _write(rows.select("member", "payload"), path, pack)


def write_named_tars(rows: DataFrame, path: str) -> None:
    """(tar, member, payload) rows to the tars that they name, members in order."""
    _write(rows.select("tar", "member", "payload").repartition("tar").sortWithinPartitions("tar", "member"), path)


def _write(rows: DataFrame, path: str, pack: int = 1000) -> None:
    rows.sparkSession.dataSource.register(ArchiveSource)
    rows.write.format("archive").option("path", path).option("pack", pack).mode("append").save()


CATALOG = ("shard", "member", "bytes", "sha256", "ext", "width", "height", "mode", "phash", "corrupt", "status")


def catalog(rows: DataFrame) -> DataFrame:
    """One manifest row a member: digest, true size, mode, perceptual hash, decode status.

    ``corrupt`` is true for pictures that can't be read or lack a part, and null for those of a format that isn't decoded.
    """
    named = rows.select(F.col("archive").alias("shard"), "member", "bytes", F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("sha256"), "payload")
    found = image.with_facts(named)
    ext = F.lower(F.regexp_extract("member", r"[^/](\.[^./]*)$", 1))
    corrupt = F.when(F.col("status") != "unsupported", F.col("status") != "ok")
    return found.withColumn("ext", ext).withColumn("corrupt", corrupt).select(*CATALOG)


def with_group(rows: DataFrame) -> DataFrame:
    from tarnlake.functions.scalars import shard_group, shard_index

    return rows.withColumn("shard_group", shard_group(shard_index(F.col("shard"), F.lit(0))))


def index_members(spark: SparkSession, folder: str, manifest: str, expected: int | None = None) -> str:
    """Append (archive, bytes, members) of archives that the manifest table doesn't have yet, and return its fingerprint.

    An interrupted run goes on where it stopped; an archive that grew or shrank since is refused, and so is a manifest of
    another number of archives than expected.
    """
    from tarnlake.operators.lake import todo
    from tarnlake.sources.lake import fingerprint, listing, read_parts

    schema = "archive string, bytes long, members array<string>"
    have = read_parts(spark, manifest, schema)
    found = listing(spark, folder).where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*KINDS)).select(F.col("name").alias("archive"), F.col("size").alias("bytes"), "path")
    odd = found.join(have.select("archive", F.col("bytes").alias("then")), "archive").where("bytes <> then")
    if not odd.isEmpty():
        raise ValueError("an archive changed since it was indexed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [[n for n, _, _ in members(p.removeprefix("file://").removeprefix("file:"))] for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.list_(pa.string()))], names=["archive", "bytes", "members"])

    todo(found, have, "archive").select("archive", "bytes", "path").mapInArrow(run, schema).write.mode("append").parquet(manifest)
    done = read_parts(spark, manifest, schema)
    n = done.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} archives are indexed, {expected} were expected")
    return fingerprint(done.withColumn("members", F.array_join("members", "\n")), "archive", "bytes", "members")
