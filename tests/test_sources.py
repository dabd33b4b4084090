import hashlib
import io
import json
import os
import time
import zipfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlake.sources import archives, image, lake
from tarnlake.sources.curate import curate
from tarnlake.sources.portal import PortalClient, PortalError, ingest, read_remote_tars, resolve_source
from tarnlake.streaming.jobs import RESUBMIT, drain, ingest_new, run_phases, telemetry, write_stream_manifest
from tarnlake.streaming.source import BatchReader, _ordered, cuts, epoch_items


def picture(seed, h=24, w=36):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "zips"
    d.mkdir()
    for a in range(3):
        with zipfile.ZipFile(d / f"a{a}.zip", "w") as z:
            for m in range(3):
                z.writestr(f"x/{m}.png", image.encode(picture(10 * a + m)))
            z.writestr("notes.txt", "no image")
            z.writestr("bad.JPG", b"\xff\xd8\xffnope")
    return d


def test_catalog_of_zips(spark, folder):
    rows = archives.read_archives(spark, str(folder))
    got = archives.with_group(archives.catalog(rows)).collect()
    assert len(got) == 12 and sum(r.corrupt for r in got) == 3
    good = [r for r in got if not r.corrupt]
    assert {(r.width, r.height, r.mode) for r in good} == {(36, 24, "RGB")}
    assert len({r.phash for r in good}) == 9 and {r.shard_group for r in got} == {"g000"}


def test_tars_round_trip_without_empty_shards(spark, folder, tmp_path):
    rows = archives.read_archives(spark, str(folder)).withColumn("member", F.concat_ws("/", F.regexp_replace("archive", ".zip", ""), "member")).coalesce(1)
    out = str(tmp_path / "tars")
    archives.write_tars(rows, out, 4)
    assert len(os.listdir(out)) == 3
    back = archives.read_archives(spark, out)
    pairs = lambda d: sorted((r.member, bytes(r.payload)) for r in d.collect())
    assert pairs(back) == pairs(rows)


def jvm_picture(spark, pixels, kind):
    """A file as Java's image writers make it."""
    jvm = spark.sparkContext._jvm
    h, w = pixels.shape[:2]
    im = jvm.java.awt.image.BufferedImage(w, h, 1 if pixels.shape[2] == 3 else 10)
    for y in range(h):
        for x in range(w):
            p = [int(v) for v in pixels[y, x]]
            im.setRGB(x, y, p[0] << 16 | p[1 % len(p)] << 8 | p[2 % len(p)])
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(im, kind, out)
    return bytes(out.toByteArray())


def smooth(h=37, w=51):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([4 * x % 256, 5 * y % 200 + 20, (x + y) * 2 % 256], 2).astype(np.uint8) // 2 + 60


@pytest.mark.parametrize("kind", ["jpg", "bmp", "png"])
def test_pictures_of_other_writers(spark, kind):
    p = smooth()
    data = jvm_picture(spark, p, kind)
    d = image.decode(data)
    assert (d.status, d.width, d.height, d.mode) == ("ok", 51, 37, "RGB")
    error = np.abs(d.pixels.astype(int) - p)
    assert error.max() == 0 if kind != "jpg" else error.mean() < 6
    half = image.decode(data[: len(data) // 2])
    assert half.status in ("truncated", "unreadable") and image.decode(data[:3]).status == "unreadable"
    jvm = spark.sparkContext._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))  # what Java reads is what we read
    java = np.array([[(v >> 16 & 255, v >> 8 & 255, v & 255) for v in (read.getRGB(x, y) for x in range(51))] for y in range(37)])
    assert np.abs(d.pixels.astype(int) - java).mean() < 2.5


def test_formats_that_are_not_decoded():
    for data in (b"GIF89a" + bytes(20), b"RIFF\0\0\0\0WEBPVP8 ", b"\xff\xd8\xff\xc2\0\x11\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\x01\x03\x11\x01"):
        assert image.decode(data).status == "unsupported"


def mixed(spark, folder):
    """An archive of JPEG, BMP and PNG, a copy, a broken file and one of another format."""
    p = smooth(300, 260)
    with zipfile.ZipFile(folder / "0007.zip", "w") as z:
        z.writestr("a.jpg", jvm_picture(spark, smooth(40, 50), "jpg"))
        z.writestr("b.bmp", jvm_picture(spark, picture(1), "bmp"))
        z.writestr("c.png", image.encode(p))
        z.writestr("d.png", image.encode(p))
        z.writestr("e.jpg", b"\xff\xd8\xffnope")
        z.writestr("f.jpeg", b"RIFF\0\0\0\0WEBPVP8 ")


def test_catalog_of_mixed_formats(spark, tmp_path):
    mixed(spark, tmp_path)
    got = {r.member: r for r in archives.catalog(archives.read_archives(spark, str(tmp_path))).collect()}
    assert {m: (r.status, r.corrupt) for m, r in got.items()} == {"a.jpg": ("ok", False), "b.bmp": ("ok", False), "c.png": ("ok", False), "d.png": ("ok", False), "e.jpg": ("unreadable", True), "f.jpeg": ("unsupported", None)}
    assert (got["a.jpg"].width, got["a.jpg"].height, got["a.jpg"].ext) == (50, 40, ".jpg") and got["c.png"].phash == got["d.png"].phash
    assert all(len(r.sha256) == 64 and (len(r.phash) == 16) == (r.status == "ok") for r in got.values())


def test_curate_from_archives_to_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    mixed(spark, tmp_path / "in")
    got = {r.src_member: r for r in curate(spark, str(tmp_path / "in"), str(tmp_path / "out"), size=64, pack=2).collect()}
    assert {m: (r.wds_shard, r.dup_of) for m, r in got.items()} == {
        "a.jpg": ("wds-g000-00000", ""), "b.bmp": ("wds-g000-00000", ""), "c.png": ("wds-g000-00001", ""),
        "d.png": ("", "0007.zip/c.png"), "e.jpg": ("", "CORRUPT"), "f.jpeg": ("", "UNSUPPORTED"),
    }
    assert (got["c.png"].width, got["c.png"].height, got["b.bmp"].width) == (64, 74, 36)
    back = archives.read_archives(spark, str(tmp_path / "out" / "shards")).collect()
    assert sorted((r.archive, r.member, r.bytes) for r in back) == [("wds-g000-00000.tar", "0007.zip__a.jpg.png", got["a.jpg"].bytes), ("wds-g000-00000.tar", "0007.zip__b.bmp.png", got["b.bmp"].bytes), ("wds-g000-00001.tar", "0007.zip__c.png.png", got["c.png"].bytes)]
    again = curate(spark, str(tmp_path / "in"), str(tmp_path / "out"), size=64, pack=2)
    assert again.count() == 6


def test_picture_columns(spark):
    rows = spark.createDataFrame([(1, image.encode(np.full((40, 30, 3), 250, np.uint8))), (2, b""), (3, None)], "id long, payload binary")
    f = {r.id: r for r in image.with_facts(rows).collect()}
    assert (f[1].mean, f[1].bright, f[1].dark) == (pytest.approx(250), 1.0, 0.0) and f[2].mean is None and f[3].status == "unreadable"
    assert [(r.id, r.width, r.height) for r in image.with_resized(rows, 15).orderBy("id").collect()] == [(1, 15, 20), (2, 0, 0), (3, 0, 0)]
    g = {r.id: r for r in image.with_mask_grid(rows).collect()}
    assert g[1].grid == [1] * 196 and g[1].share == 1.0 and g[2].grid is None


def test_index_goes_on(spark, folder, tmp_path):
    m = str(tmp_path / "manifest")
    first = archives.index_members(spark, str(folder), m, 3)
    assert archives.index_members(spark, str(folder), m) == first
    (folder / "a3.zip").write_bytes((folder / "a0.zip").read_bytes())
    assert archives.index_members(spark, str(folder), m, 4) != first
    rows = {r.archive: len(r.members) for r in spark.read.parquet(m).collect()}
    assert rows == {f"a{i}.zip": 4 for i in range(4)}
    (folder / "a3.zip").write_bytes(b"PK")
    with pytest.raises(ValueError, match="changed"):
        archives.index_members(spark, str(folder), m)


def test_7z_is_refused(spark, tmp_path):
    (tmp_path / "a.7z").write_bytes(b"7z")
    with pytest.raises(Exception, match="7z"):
        archives.read_archives(spark, str(tmp_path)).count()


def test_decode_and_hash():
    p = picture(1)
    d = image.decode(image.encode(p))
    assert d.status == "ok" and (d.pixels == p).all()
    assert image.decode(image.encode(p)[:-400]).status in ("truncated", "unreadable")
    assert image.decode(b"").status == "unreadable"
    near = np.clip(p.astype(int) + 2, 0, 255).astype(np.uint8)
    assert (int(image.phash(p), 16) ^ int(image.phash(near), 16)).bit_count() <= 6
    assert (image.upsample(np.ones((14, 14)), 224) == pytest.approx(1.0))
    assert image.mask_grid(np.full((28, 28), 255), 14).all()


class Clock:
    def __init__(self):
        self.t, self.waits = 0.0, []

    def wait(self, s):
        self.waits.append(s)
        self.t += s


def client(replies, deadline=100):
    clock, seen = Clock(), []

    def fetch(url, headers):
        seen.append((url, headers.get("Range")))
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    n = [0]

    def sign(i):
        n[0] += 1
        return f"https://secret/{i}?sig={n[0]}"

    return PortalClient(sign, deadline, clock.wait, lambda: clock.t, fetch), clock, seen


def test_resume_and_restart():
    c, _, seen = client([(206, {"Content-Range": "bytes 3-5/6"}, b"def")])
    assert c.download("f", b"abc", 6) == b"abcdef" and seen[0][1] == "bytes=3-"
    c, _, _ = client([(200, {}, b"abcdef")])
    assert c.download("f", b"abc", 6) == b"abcdef"
    c, _, _ = client([(206, {"Content-Range": "bytes 0-5/6"}, b"abcdef")])
    with pytest.raises(PortalError):
        c.download("f", b"abc", 6)
    c, _, _ = client([(200, {}, b"abcdefg")])
    with pytest.raises(PortalError, match="longer"):
        c.download("f", b"", 6)


def test_retry_policy():
    c, clock, _ = client([(500, {}, b""), OSError("net"), (503, {}, b""), (200, {}, b"ok")])
    assert c.download("f", b"", 2) == b"ok" and clock.waits == [1, 2, 4]
    c, _, seen = client([(403, {}, b""), (200, {}, b"ok")])
    assert c.download("f", b"", 2) == b"ok" and seen[0][0] != seen[1][0]
    for replies, deadline in (([(404, {}, b"")], 100), ([(403, {}, b"")] * 2, 100), ([(500, {}, b"")] * 9, 5)):
        c, _, _ = client(replies, deadline)
        with pytest.raises(PortalError) as e:
            c.download("f", b"", 2)
        assert "secret" not in str(e.value) and "sig" not in str(e.value)


def test_download_to_a_file_goes_on(tmp_path):
    data, path = bytes(range(256)) * 40, str(tmp_path / "f.zip")
    (tmp_path / "f.zip.part").write_bytes(data[:1000])
    c, _, seen = client([(206, {"Content-Range": f"bytes {a}-{min(a + 4096, len(data)) - 1}/{len(data)}"}, data[a : a + 4096]) for a in range(1000, len(data), 4096)])
    assert c.download_to("f", path, len(data), 4096) == hashlib.sha256(data).hexdigest()
    assert open(path, "rb").read() == data and [h for _, h in seen][0] == "bytes=1000-5095" and not os.path.exists(path + ".part")
    c, _, _ = client([(206, {"Content-Range": "bytes 7-16/20"}, b"0123456789")])
    with pytest.raises(PortalError, match="another range"):
        c.download_to("g", str(tmp_path / "g"), 20, 10)
    c, _, _ = client([(200, {}, b"0123456789")])
    with pytest.raises(PortalError, match="declared size"):
        c.download_to("h", str(tmp_path / "h"), 5)


def test_ingest_copies_what_is_missing_and_logs_it(spark, tmp_path):
    folder, log = str(tmp_path / "zips"), str(tmp_path / "log")
    spec = spark.createDataFrame([("a.zip", 1, 700), ("b.zip", 2, 900), ("c.zip", 3, 50)], "name string, id long, size long")

    def make():
        def fetch(url, headers):
            data = url.encode() * [0, 700, 900, 50][int(url)]
            a, b = map(int, headers["Range"].removeprefix("bytes=").split("-"))
            return 206, {"Content-Range": f"bytes {a}-{b}/{len(data)}"}, data[a : b + 1]

        return PortalClient(lambda i: i, fetch=fetch)

    have = spark.createDataFrame([("c.zip", 50), ("b.zip", 1)], "name string, size long")
    got = {r.name: r for r in ingest(spec, have, folder, log, make).collect()}
    assert sorted(got) == ["a.zip", "b.zip"] and got["a.zip"].sha256 == hashlib.sha256(b"1" * 700).hexdigest()
    assert os.path.getsize(f"{folder}/b.zip") == 900
    assert ingest(spec, spec.select("name", "size"), folder, log, make).count() == 2
    assert ingest(spec, spec.select("name", "size"), folder, str(tmp_path / "none"), make).count() == 0


def test_remote_zip_listing():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.png", b"x" * 5000)
        z.writestr("b.png", b"y")
    data = b.getvalue()

    def fetch(url, headers):
        a, e = headers["Range"].removeprefix("bytes=").split("-")
        return 206, {}, data[int(a) : int(e) + 1]

    c = PortalClient(lambda i: "u", fetch=fetch)
    assert c.zip_names("f", len(data)) == ["a.png", "b.png"]


def test_remote_tars(spark):
    spec = spark.createDataFrame([("a.tar", "1"), ("b.tar", "2")], "name string, id string")

    def make():
        import tarfile

        def data(i):
            b = io.BytesIO()
            with tarfile.open(fileobj=b, mode="w") as t:
                for k in range(3):
                    info = tarfile.TarInfo(f"{i}-{k}.png")
                    info.size = 700 * k
                    t.addfile(info, io.BytesIO(bytes([k]) * info.size))
            return b.getvalue()

        def fetch(url, headers):
            a, _, b = headers["Range"].removeprefix("bytes=").partition("-")
            return 206, {}, data(url)[int(a) : int(b) + 1]

        client = PortalClient(lambda i: i, fetch=fetch)
        client.length = lambda i: len(data(i))
        return client

    sized = spec.withColumn("size", F.lit(make().length("1")))
    got = sorted((r.archive, r["index"], r.member, r.bytes, len(r.payload)) for r in read_remote_tars(sized, make).collect())
    assert got == [(f"{n}.tar", k, f"{i}-{k}.png", 700 * k, 700 * k) for n, i in (("a", 1), ("b", 2)) for k in range(3)]


def test_hash_cache_and_labelled_images(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"a": "ffffffffffffffff", "b": "0000000000000001"}))
    assert sorted(map(tuple, lake.hash_cache(spark, str(tmp_path / "h.json")).collect())) == [("a", -1), ("b", 1)]
    for p in ("lower-gi-tract/c/polyp/a.jpg", "lower-gi-tract/c/polyp/b.PNG", "loose.png", "lower-gi-tract/c/polyp/notes.txt"):
        (tmp_path / "im" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "im" / p).write_bytes(b"x")
    labels = spark.createDataFrame([("a", "cecum")], "stem string, finding string")
    got = lake.labelled_images(spark, str(tmp_path / "im"), labels).collect()
    assert sorted((r.stem, r.relative, r.finding) for r in got) == [("a", "lower-gi-tract/c/polyp/a.jpg", "cecum"), ("b", "lower-gi-tract/c/polyp/b.PNG", "polyp")]


def test_source_mode():
    assert resolve_source("local_zip", None, "portal_zip") == "portal_zip"
    with pytest.raises(ValueError):
        resolve_source("ftp")


def test_small_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("0\ta.png\n1\tb\tc.png\n")
    assert sorted(map(tuple, lake.tsv_members(spark, str(tmp_path / "m.tsv")).collect())) == [(0, "a.png"), (1, "b\tc.png")]
    d = tmp_path / "r"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"tag": "x", "rows": [{"acc": 0.5}]}))
    (d / "b.json").write_text("{broken")
    assert [r.tag for r in lake.result_documents(spark, str(d), "tag string, rows array<struct<acc: double>>").collect()] == ["x"]
    (tmp_path / "c.csv").write_text(" id ,x\n a , b \n")
    assert lake.csv_table(spark, str(tmp_path / "c.csv")).first().asDict() == {"id": "a", "x": "b"}
    assert "| a |" in lake.markdown(spark.createDataFrame([("a", None)], "k string, v double"), "T")
    with pytest.raises(ValueError, match="over 3 rows"):
        lake.markdown(spark.range(4), "T", 3)
    assert lake.read_parts(spark, str(tmp_path / "none"), lake.MANIFEST).count() == 0


# --- streams ---------------------------------------------------------------------------------------------------------


def manifest(path, folder, extra=()):
    found = [{"id": f"a{a}", "members": [f"x/{m}.png" for m in range(3)] + list(extra)} for a in range(3)]
    path.write_text(json.dumps({"archives": found}))
    return {"manifest": str(path), "batchSize": 4, "epochs": 3, "seed": 5, "folder": str(folder)}


def test_stream_covers_every_item_once_an_epoch_and_resumes(spark, folder, tmp_path):
    o = manifest(tmp_path / "m.json", folder)
    for n in (2, 1, None):
        drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"), n)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("epoch", "batch", "pos").collect()
    assert len(rows) == 27 and {r.status for r in rows} == {"ok"}
    orders = [[(r.archive, r.member) for r in rows if r.epoch == e] for e in range(3)]
    assert all(len(set(x)) == 9 for x in orders) and orders[0] != orders[1]
    assert [sum(1 for r in rows if r.epoch == 0 and r.batch == b) for b in (0, 1)] == [4, 5]
    drain(spark, o, str(tmp_path / "once"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "once")).orderBy("epoch", "batch", "pos").drop("trigger").collect() == [r for r in spark.read.parquet(str(tmp_path / "out")).drop("trigger").orderBy("epoch", "batch", "pos").collect()]


def test_bad_members_become_placeholders(spark, folder, tmp_path):
    o = manifest(tmp_path / "m.json", folder, ("gone.png", "notes.txt")) | {"epochs": 1}
    drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    assert got == {"ok": 9, "unreadable": 3, "undecodable": 3}
    t = telemetry(rows).first()
    assert (t.attempts, t.failures) == (15, 6) and t.bytes > 9 * 60


def test_a_stream_that_does_not_end_is_an_error(spark, folder, tmp_path):
    o = manifest(tmp_path / "m.json", folder) | {"epochs": 1000}
    with pytest.raises(TimeoutError):
        drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"), timeout=1.5)


def test_a_long_stream_that_goes_on_is_no_error(spark, folder, tmp_path, monkeypatch):
    """Each trigger takes 200 s of this clock: more than 300 s in all, less than that without one."""
    o, began = manifest(tmp_path / "m.json", folder), time.time()
    monkeypatch.setattr("tarnlake.streaming.jobs.time", SimpleNamespace(time=lambda: began + 200 * len(list((tmp_path / "out").glob("trigger=*/_SUCCESS")))))
    assert sum(p["rows"] for p in drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"))) == 27
    monkeypatch.undo()
    with pytest.raises(TimeoutError, match="nothing for"):
        drain(spark, o, str(tmp_path / "other"), str(tmp_path / "cp2"), stall=-1)


def test_workers_keep_few_archives_in_order():
    o = [json.dumps({"id": i, "members": [f"m{m}" for m in range(1000)]}) for i in range(20)]
    for x in o:
        kept = _ordered(x, 1, 0)
    assert isinstance(kept, pa.ChunkedArray) and _ordered.cache_info().currsize <= 2


def test_members_of_a_manifest_in_tables(spark, tmp_path):
    """The driver's manifest has counts only; the order is that of the members listed in it."""
    rows = [(f"a{a}", f"m{m}") for a in range(3) for m in range(5 + a)]
    path = write_stream_manifest(spark.createDataFrame(rows, "archive string, member string"), "archive", "member")
    with open(path) as f:
        found = json.load(f)["archives"]
    assert [(a["id"], a["count"], "members" in a) for a in found] == [("a0", 5, False), ("a1", 6, False), ("a2", 7, False)]
    progress = drain(spark, {"manifest": path, "batchSize": 4, "epochs": 2, "seed": 5}, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sum(p["rows"] for p in progress) == 36 and all(p["wait_s"] >= 0 for p in progress)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("epoch", "batch", "pos").collect()
    listed = [{"id": f"a{a}", "members": [m for x, m in rows if x == f"a{a}"]} for a in range(3)]
    assert [(r.archive, r.member) for r in got] == epoch_items(listed, 5, 0) + epoch_items(listed, 5, 1)
    assert BatchReader({"manifest": path, "batchSize": 4}).batches == len(cuts(18, 4))


def test_another_manifest_is_refused(spark, folder, tmp_path):
    o = manifest(tmp_path / "m.json", folder)
    drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    manifest(tmp_path / "m.json", folder, ("gone.png",))
    with pytest.raises(Exception, match="another manifest"):
        drain(spark, o, str(tmp_path / "out"), str(tmp_path / "cp"))


def test_epoch_order_and_cuts():
    a = [{"id": i, "members": list("abc")} for i in range(3)]
    assert epoch_items(a, 1, 0) == epoch_items(a, 1, 0) != epoch_items(a, 1, 1)
    assert cuts(9, 4) == [(0, 4), (4, 9)]


def test_incremental_ingest(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "base")
    f = lambda d: d.select(F.col("id").alias("item"), (F.col("id") % 3 != 0).alias("ok"))
    spark.range(0, 6).coalesce(1).write.mode("append").parquet(src)
    assert ingest_new(spark, src, "id long", f, base).count() == 4
    spark.range(6, 9).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.item for r in ingest_new(spark, src, "id long", f, base).collect()) == [1, 2, 4, 5, 7, 8]


def test_receipts(tmp_path):
    codes, calls = [RESUBMIT, 0], []
    phase = lambda: (calls.append(1), codes.pop(0))[1]
    assert run_phases([("train", phase)], str(tmp_path)) == ["train", "train"]
    assert run_phases([("train", phase)], str(tmp_path)) == []
    with pytest.raises(RuntimeError):
        run_phases([("bad", lambda: 1)], str(tmp_path))
