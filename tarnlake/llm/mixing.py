"""Mixing sources to target weights, in DataFrame operations only.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share a budget of words; no target exceeds
twice its source's words, and what is over is shared again by weight: targets are min(2 * size, level * weight).

A source's words, its documents in a hashed order, are packed into blocks of ``BLOCK`` words. The mix is dealt in
output shards of ``SHARD_SLOTS`` slots. A shard's source counts are a multinomial draw: each slot draws its source by
the shares of the targets, from a hash of shard and slot. That the totals meet the targets too, a source that has had
its slots draws no more, and what others lack in the end goes to the last shard; so the last shards are corrected,
the others are as drawn. A source's slots are numbered over the shards; slot j reads block a * j + b modulo its
number of blocks, for a multiplier without common factor: a permutation for each pass over the source, of which there
are two at most. Slots and blocks are joined by source and block number.

All numbers come from hashes of source rank, shard and pass, so reruns agree. Null or empty texts have size 0 and
are taken 0 times; a source of size 0 has target 0; very long texts lie in many blocks. Rows of one id are documents
of their own. An empty table gives an empty result; other columns are ignored. Sources are ranked in one task and
their shares go with each shard's row, so there may be some ten thousand sources, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.session import materialize, table

BLOCK = 128
SHARD_SLOTS = 8192
#: Tasks that shards are dealt over, at most.
MAX_TASKS = 4096
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
#: Documents of a source whose offsets are summed in one task.
CHUNK_ROWS = 1024
#: Primes under 2**20. Of these, at most two divide a number under 2**42.
PRIMES = (1048573, 1048571, 1048559, 1048549, 1048517, 1048507)
WORD = r"[^\x20\x09-\x0D]+"


def unit(*cols: Column) -> Column:
    """A uniform number of [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """One row a source: (source, sid, source_size, target). The only unpartitioned windows run over sources."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("here", (F.col("budget") - F.col("capped")) / F.col("left"))
    s = s.withColumn("full", F.col("cap") <= F.col("here") * F.col("w"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.struct((-F.col("capped")).alias("o"), F.col("here").alias("v")))).over(every)["v"])
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return s.select("source", "sid", "source_size", target.alias("target"))


def wanted(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a source with words: its blocks n, its slots, and those of the sources before it."""
    n = F.ceil(F.col("source_size") / block)
    slots_ = F.round(F.col("target") * n / F.col("source_size")).cast("long")
    s = sources.where("source_size > 0").select("sid", n.alias("n"), slots_.alias("slots")).where("slots > 0")
    every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn("upto", F.sum("slots").over(every))


def draws(want: DataFrame, total: int, shard_slots: int) -> DataFrame:
    """(shard, sid, drawn): multinomial counts. Each of a shard's slots draws a source by the shares of the slots."""
    shards = -(-total // shard_slots)
    line = want.agg(F.sort_array(F.collect_list(F.struct("upto", "sid"))).alias("line"))  # one short entry a source
    each = line.select("line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    each = each.repartition(min(shards, MAX_TASKS), "shard")
    last = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots) - 1
    each = each.select("line", "shard", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slot"))
    point = F.floor(unit(F.lit("draw"), F.col("shard"), F.col("slot")) * total)
    passed = F.size(F.filter("line", lambda x: x["upto"] <= F.col("point")))
    drawn = each.withColumn("point", point).select("shard", F.get("line", passed)["sid"].alias("sid"))
    return drawn.groupBy("shard", "sid").agg(F.count("*").alias("drawn"))


def shard_counts(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(sid, shard, n, begin, end): which of its slots each source has in a shard."""
    want = materialize(wanted(sources, block), "mix-wanted")
    total = want.agg(F.max("upto")).first()[0] or 0
    if not total:
        return want.select("sid", F.col("n").alias("shard"), "n", F.col("slots").alias("begin"), F.col("slots").alias("end"))
    dealt = materialize(draws(want, total, shard_slots), "mix-draws").join(want, "sid")
    by = Window.partitionBy("sid").orderBy("shard")
    dealt = dealt.withColumn("upto", F.sum("drawn").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    begin, end = F.least(F.col("upto") - F.col("drawn"), F.col("slots")), F.least("upto", "slots")
    drawn = dealt.select("sid", "shard", "n", begin.alias("begin"), end.alias("end"))
    had = dealt.groupBy("sid").agg(F.sum("drawn").alias("had"))
    lack = want.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    last = F.lit((total - 1) // shard_slots).cast("long").alias("shard")
    return drawn.unionByName(lack.select("sid", last, "n", F.col("had").alias("begin"), F.col("slots").alias("end"))).where("end > begin")


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(sid, block, pass): which block each slot of the mix reads."""
    dealt = materialize(shard_counts(sources, block, shard_slots), "mix-shards")
    dealt = dealt.repartition(max(1, min(dealt.count(), MAX_TASKS)), "sid", "shard")  # few rows, each of many slots
    each = dealt.select("sid", "n", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("j"))
    each = each.select("sid", "n", F.floor(F.col("j") / F.col("n")).alias("pass"), (F.col("j") % F.col("n")).alias("i"))
    first = F.pmod(F.xxhash64(F.lit("multiplier"), "sid", "pass"), F.lit(len(PRIMES))).cast("int")
    primes = F.array(*[F.lit(p) for p in PRIMES])
    turned = [F.element_at(primes, ((first + k) % len(PRIMES) + 1).cast("int")).cast("long") for k in range(3)]
    factor = F.when(F.col("n") % turned[0] != 0, turned[0]).when(F.col("n") % turned[1] != 0, turned[1]).otherwise(turned[2])
    shift = F.pmod(F.xxhash64(F.lit("shift"), "sid", "pass"), F.col("n"))
    return each.select("sid", ((factor * F.col("i") + shift) % F.col("n")).alias("block"), "pass")


def placed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Documents with size, source and offset; and the sources with their targets."""
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    sources = materialize(targets(sizes, share), "mix-sources")
    chunks = max(1, sizes.count() // CHUNK_ROWS)
    s = sources.withColumnRenamed("source", "s")
    d = sizes.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    base = d.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    by = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("sid", "chunk", F.coalesce(F.sum("words").over(by), F.lit(0)).alias("base"))
    own = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(base, ["sid", "chunk"])
    return d.select("doc_id", "source", "sid", "size", "source_size", "target", (F.col("base") + F.col("own")).alias("at"), F.monotonically_increasing_id().alias("row")), sources


def taken_spans(docs: DataFrame, share: float = SHARE, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, **cols: str) -> DataFrame:
    """Documents by the blocks that hold them: from (first word) and n (words), and the pass, null where not taken."""
    d, sources = placed(docs, share=share, **cols)
    d = materialize(d, "mix-placed")
    end = F.col("at") + F.col("size")
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block)))
    parts = d.select("*", F.explode_outer(numbers).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    parts = parts.withColumn("from", begin - F.col("at")).withColumn("n", F.least(end, (F.col("block") + 1) * block) - begin)
    # The planner takes the slots for as few as the sources that they are made of; they grow with the words.
    return parts.join(slots(sources, block, shard_slots).hint("merge"), ["sid", "block"], "left")


def mix(docs: DataFrame, share: float = SHARE, **cols: str) -> DataFrame:
    parts = taken_spans(docs, share, **cols)
    taken = F.coalesce(F.sum(F.when(F.col("pass").isNotNull(), F.col("n"))), F.lit(0)).cast("long")
    return parts.groupBy("row", "doc_id", "size", "source_size", "target").agg(taken.alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that the mix takes words of, with the text it takes: a pass that takes all words takes the
    text as it is, else the words joined by blanks; a second pass follows in a new line. Rows of one id and size
    all get the words that the first of them is taken for."""
    spans = taken_spans(docs.select("doc_id", "source", "text"), share).where(F.col("pass").isNotNull())
    each = spans.groupBy("row", "doc_id", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "n"))).alias("cut"), F.sum("n").alias("words"))
    rows = each.groupBy("row", "doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("pass", "cut", (F.col("words") >= F.col("size")).alias("whole")))).alias("passes"))
    own = rows.groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.min_by("passes", "row").alias("__passes"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = docs.withColumn("__n", F.regexp_count("text", F.lit(WORD)).cast("long"))
    joined = counted.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")))
    joined = joined.withColumn("__words", words)  # after the join: words of texts never move
    text_of = lambda p: F.when(p.whole, F.col("text")).otherwise(F.array_join(F.flatten(F.transform(p.cut, lambda c: F.slice("__words", (c["from"] + 1).cast("int"), c.n.cast("int")))), " "))
    out = joined.withColumn("text", F.array_join(F.transform("__passes", text_of), "\n"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
