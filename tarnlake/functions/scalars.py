"""Scalar rules of the lake as Column expressions: names, labels, geometry, digests, schedules, vectors."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image extensions that archives may hold.
EXTENSIONS = (".bmp", ".jpeg", ".jpg", ".png", ".webp")


def shard_index(name: Column, position: Column) -> Column:
    """The first run of digits in a shard's name, else its position in the listing (from 0)."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int"), position.cast("int"))


def shard_group(index: Column, width: int = 16) -> Column:
    return F.format_string("g%03d", F.floor(index / width).cast("int"))


def group_key(shard: Column) -> Column:
    return F.substring(shard, 1, 4)


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def sample_key(archive: Column, member: Column) -> Column:
    return F.concat_ws("/", stem(archive), stem(member))


def frame_number(path: Column) -> Column:
    """The digits between the last underscore and the extension, null where there are none."""
    return F.nullif(F.regexp_extract(path, r"_(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("int")


def video_name(path: Column) -> Column:
    """The first folder that is called like 001-002, null where there is none."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d{3}-\d{3})(?:/|$)", 1), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_extension(path: Column, allowed: tuple[str, ...] = EXTENSIONS) -> Column:
    return extension(path).isin(*allowed)


def store_uri(uri: Column) -> tuple[Column, Column]:
    """Bucket and key of an object store address; an error for anything else."""
    pattern = r"^s3://([^/]+)/?(.*)$"
    ok = uri.rlike(pattern)
    bad = F.raise_error(F.concat(F.lit("not an object store address: "), uri)).cast("string")
    return F.when(ok, F.regexp_extract(uri, pattern, 1)).otherwise(bad), F.when(ok, F.regexp_extract(uri, pattern, 2)).otherwise(bad)


def normal_label(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-"))


def task_label(task: str, tract: Column, category: Column, finding: Column) -> Column:
    if task == "finding":
        return finding
    if task == "category":
        return category
    if task == "tract":
        return F.when(tract.startswith("upper"), "upper").otherwise("lower")
    if task == "pathology":
        return F.when(category == "pathological-findings", "pathological").otherwise("other")
    raise ValueError(f"unknown task {task!r}")


def path_labels(relative: Column) -> tuple[Column, Column, Column]:
    """Tract, category and finding from a path of four parts or more, null otherwise."""
    parts = F.split(relative, "/")
    deep = F.size(parts) >= 4
    at = lambda i: F.when(deep, F.element_at(parts, i))
    return F.regexp_replace(at(1), "-tract$", ""), at(2), at(3)


def short_side(w: Column, h: Column) -> Column:
    return F.least(w, h)


def aspect(w: Column, h: Column) -> Column:
    """Long over short side, null where there is no short side."""
    return F.try_divide(F.greatest(w, h).cast("double"), F.least(w, h).cast("double"))


def histology_label(x: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    u = F.upper(F.trim(x))
    return F.when(u.isin(*positive), 1).when(u.isin(*negative), 0)


def largest_box_share(boxes: Column, w: Column, h: Column) -> Column:
    """Area of the largest box over the frame's, which counts as 1 at least."""
    area = F.transform(boxes, lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.coalesce(F.array_max(area), F.lit(0.0)) / F.greatest(F.lit(1), w * h)


def crop_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, margin: float, least: int = 8) -> Column:
    """The box grown by a margin of its sides, cut to whole pixels of the frame; null if a side is under ``least``."""
    bw, bh = x1 - x0, y1 - y0
    a, b = F.greatest(F.lit(0), (x0 - margin * bw).cast("int")), F.greatest(F.lit(0), (y0 - margin * bh).cast("int"))
    c, d = F.least(w.cast("int"), (x1 + margin * bw).cast("int")), F.least(h.cast("int"), (y1 + margin * bh).cast("int"))
    return F.when((c - a >= least) & (d - b >= least), F.struct(a.alias("cx0"), b.alias("cy0"), c.alias("cx1"), d.alias("cy1")))


def resized(side: Column, w: Column, h: Column, size: int) -> Column:
    """A side after shrinking the image so that its short side is ``size``; images are never enlarged."""
    s = F.lit(float(size)) / F.least(w, h)
    return F.when(s < 1, F.greatest(F.lit(size), F.bround(side * s).cast("int"))).otherwise(side.cast("int"))


def suspicion(task: Column, accuracy: Column, balanced: Column) -> Column:
    dagger = F.lower(task).contains("tract")
    odd = F.coalesce(accuracy > 0.98, F.lit(False)) | F.coalesce(balanced > accuracy + 0.02, F.lit(False))
    return F.when(dagger, "†").when(odd, "⚠").otherwise("")


def cell(x: Column) -> Column:
    """A number for a report: 4 decimals, a dash for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), "–").otherwise(F.format_string("%.4f", x))


def run_tag(*parts: Column) -> Column:
    return F.concat_ws("__", *[F.nullif(p, F.lit("")) for p in parts])


def file_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(".ckpt", ".pt", ".pth", ".safetensors"), "checkpoint").when(e.isin(".npz", ".npy", ".parquet"), "features").when(e.isin(".json", ".csv", ".md"), "report").when(e.isin(".log", ".out", ".err"), "log").otherwise("other")


def readable_bytes(n: Column) -> Column:
    """In the largest unit under 1024 of it, with one decimal from KB on; halves to even."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f TB", F.bround(n / float(1 << 40), 1))
    for k in range(len(units) - 2, -1, -1):
        shown = F.concat(n.cast("long").cast("string"), F.lit(" B")) if k == 0 else F.format_string(f"%.1f {units[k]}", F.bround(n / float(1 << 10 * k), 1))
        out = F.when(n < float(1 << 10 * (k + 1)), shown).otherwise(out)
    return out


def checkpoint_kind(name: Column) -> Column:
    """What a run's file is: its averaged weights, last or periodic checkpoint, end marker, or anything else."""
    periodic = name.startswith("ckpt-") & name.endswith(".ckpt")
    return F.when(name.isin("ema_backbone.pt", "last.ckpt", "DONE"), name).when(periodic, "periodic ckpt").otherwise("tb / other")


def cache_task(task: Column) -> Column:
    """The bucket of a feature cache by the task that its sidecar names."""
    return F.coalesce(F.concat(F.lit("cache/"), task), F.lit("cache (unattributed)"))


def egress_cost(nbytes: Column) -> Column:
    return nbytes / float(1 << 30) * 0.09


# --- hashes ---------------------------------------------------------------------------------------------------------


def hash_bits(text: Column) -> Column:
    """16 hex digits as the bigint of the same 64 bits."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: Column) -> Column:
    """The signs of 64 numbers as the bits of a bigint, the first number highest; null for any other length."""
    bits = F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.when(F.size(v) == 64, F.conv(bits, 2, -10).cast("bigint"))


def seeded_order(seed: str | int, *key: Column) -> Column:
    """What seeded shuffles sort by: the same on every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[k.cast("string") for k in key])).cast("binary"))


# --- vectors --------------------------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x / (F.sqrt(dot(v, v)) + 1e-12))


def scrub(v: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row; a lambda over an array would compute what it names anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def of(v: Column) -> Column:
        return once(array_sum(v) / F.nullif(F.size(v), F.lit(0)), lambda mean: of_mean(v, mean))

    def of_mean(v: Column, mean: Column) -> Column:
        var = array_sum(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.nullif(F.size(v), F.lit(0))
        return once(F.sqrt(var + eps), lambda scale: F.transform(v, lambda x: (x - mean) / scale))

    return once(v, of)


def mean_pool(tokens: Column) -> Column:
    """Mean of an array of equally long vectors."""
    n = F.size(tokens)
    total = F.reduce(F.slice(tokens, 2, n - 1), F.element_at(tokens, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def coded(x: Column, codes: dict[str, int], other: int = -1) -> Column:
    """The small code of a value, ``other`` for one that has none."""
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(other)).cast("tinyint")


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / array_sum(e))


def as_probabilities(x: Column, floor: float = 1e-7) -> Column:
    """Rows that are probabilities already (none below 0, sum 1) as they are but for the floor; others by softmax."""
    already = F.forall(x, lambda p: p >= 0) & (F.abs(array_sum(x) - 1) <= 1e-3 + 1e-5)
    return F.when(already, F.transform(x, lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(floor)))).otherwise(softmax(x))


# --- schedules ------------------------------------------------------------------------------------------------------


def warmup_cosine(step: Column, total: int, warmup: int, base: float, floor: float = 0.0) -> Column:
    rising = F.lit(base) * step / max(1, warmup)
    progress = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, rising).otherwise(F.lit(floor) + (base - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def linear_ramp(step: Column, over: int, first: float, last: float) -> Column:
    return F.when(step >= over, F.lit(last)).otherwise(F.lit(first) + (last - first) * step / float(max(1, over)))


def cosine_momentum(step: Column, total: int, base: float = 0.996) -> Column:
    return 1 - (1 - base) * (F.cos(F.lit(math.pi) * F.least(F.lit(1.0), step / float(total))) + 1) / 2
