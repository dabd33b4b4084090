"""N-gram Jaccard join: grouped prefix join over 5-word shingles.

Documents with one shingle set are one class. A class' shingles are ordered by how many documents have them (a
count over the whole corpus, in steps of a quarter power of two, then by hash), rare ones first; two sets of
Jaccard similarity t share a shingle among the first n - ceil(t * n) + 1 of each. Classes of identical prefix and size
are one group. Groups meet in the token index; pairs must fit by size, by position and by a parity sketch (a lower
bound on their difference), are expanded to members, and are verified on whole sets.

Only links that join two components matter for the result, so links are not enumerated, and the index is read thrice.
First each group meets the hubs of its token and size class and of the next classes, and members meet their group's
least member: a token of m groups gives 3 * m pairs at most, not m * m. A hub is the group with the least share of
shingles that no other document has: in a group of edited copies, the text they were made from. Tokens whose classes
are still in different components meet their next HUBS hubs. Then only tokens whose classes are still in different
components are compared in full, in tiles of at most ``2 * TILE`` classes, a group each; a tile emits those pairs only
that lie in two components and pass all filters. Every link that is not yet implied is found there, without a limit.

Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. With fewer than five words the whole sequence is the one
shingle. Null or empty texts have no shingles and link with nothing; very long texts are taken whole. Repeated rows
link with each other. Rows of one id are documents of their own, as different as their texts. Rows of a null id link
like others; they name no component, which is null where all ids are. Ties of the order are broken by hash. An empty
table gives an empty result; other columns are ignored. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.blocks import MESSAGE, NO_ID, UID_STEP, Blocks, cut, dumps, messages, per_block, per_bucket, planes, unplanes
from tarnlake.llm.kernel import _run, mix, slices, words_of
from tarnlake.operators.components import connected_components
from tarnlake.session import free, materialize, table

WORDS = 5
PERCENT = 80
#: Bits of a shingle's hash by which document counts are kept; a clash only changes the order.
COUNT_BITS = 40
#: Bits of a set's parity sketch: how often shingles fall on a bit, odd or even.
SKETCH_BITS = 512
#: Hubs that a token's sets meet where the first one left them in different components.
HUBS = 8
#: Tokens of at most so many classes are joined with themselves; those of more are compared in tiles of this many.
FEW = 48
TILE = 256


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash), ordered by both, and the number of each text's. Taken in
    slices, as words need some fifty bytes a byte of text."""
    found, done = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        doc, h, n = _shingles(part.column(0), k)
        found.append((doc + done, h, n))
        done += len(n)
    doc, h, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return doc, h, n


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words_of(texts, lower=True)
    n_texts = len(w.first) - 1
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    g, valid = w.grams(k)
    doc, h = [w.doc[valid]], [g[valid]]
    size = np.diff(w.first)
    for short in range(1, k):
        own = np.flatnonzero(size == short)
        if len(own):
            doc.append(own)
            h.append(mix(_run(w.hash, short)[w.first[own]] + np.uint64(short)))
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=n_texts)


def _sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The parity sketch of each text's shingles; of some texts at a time, as a count takes 64 times its bit."""
    bit = (mix(h) % np.uint64(SKETCH_BITS)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((len(n), SKETCH_BITS // 64), np.int64)
    for a in range(0, len(n), 256):
        b = min(a + 256, len(n))
        own = slice(begin[a], begin[b])
        odd = np.bincount((doc[own] - a) * SKETCH_BITS + bit[own], minlength=(b - a) * SKETCH_BITS) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.int64)
    return out


def _send_counts(buckets: int):
    def ask(block, ids, texts, _):
        _, h, _ = shingles(texts)
        low = np.uint64(64 - COUNT_BITS)
        u, n = np.unique(h >> low, return_counts=True)
        yield messages([(k, block, dumps(planes(u[a:b]), n[a:b].astype(np.uint32))) for k, a, b in cut(u << low, buckets)])

    return ask


def _counts(got):
    """For each shingle that a block sent, its step of document count; 0 where it is in one document only."""
    sent = [unplanes(p) for _, (p, _) in got]
    every, n = np.concatenate(sent), np.concatenate([n for _, (_, n) in got])
    order = np.argsort(every, kind="stable")
    v = every[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    total = np.add.reduceat(n[order].astype(np.int64), start)
    keys = v[start]
    step = np.minimum(255, np.floor(4 * np.log2(total) + 1e-9)).astype(np.uint8)
    for (block, _), u in zip(got, sent, strict=True):
        own = step[np.searchsorted(keys, u)]
        if own.any():
            yield block, (own,)


_INFO = "doc_id long, uid long, n long, h1 long, h2 long, prefix array<long>, at array<int>, shared binary, sketch array<long>"


def _sets(buckets: int, percent: int):
    def ask(block, ids, texts, replies):
        doc, h, n = shingles(texts)
        low = np.uint64(64 - COUNT_BITS)
        u = np.unique(h >> low)
        step = np.zeros(len(u), np.uint8)
        for k, a, b in cut(u << low, buckets):
            if k in replies:
                step[a:b] = replies[k][0]
        s = step[np.searchsorted(u, h >> low)] if len(u) else np.zeros(0, np.uint8)
        begin = np.concatenate([[0], np.cumsum(n)])
        full = np.flatnonzero(n)
        h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if len(full):
            h1[full] = np.add.reduceat(mix(h), begin[full])
            h2[full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin[full])
        order = np.lexsort((h, s, doc))
        at = np.arange(len(h)) - begin[doc]
        length = n - (percent * n + 99) // 100 + 1
        chosen = np.zeros(len(h), bool)
        chosen[order] = (at < length[doc]) & (s[order] > 0)
        place = np.empty(len(h), np.int32)
        place[order] = at
        prefix, places, shared, sketch = ([None] * len(n) for _ in range(4))
        seen = set()
        odd = _sketches(doc, h, n)
        for d in np.flatnonzero(np.bincount(doc[chosen], minlength=len(n))) if len(h) else ():
            if (key := (n[d], h1[d], h2[d])) in seen:
                continue  # a copy in this block; the first has the least uid
            seen.add(key)
            a, b = begin[d], begin[d + 1]
            c = chosen[a:b]
            prefix[d], places[d] = h[a:b][c].view(np.int64), place[a:b][c]
            shared[d], sketch[d] = h[a:b][s[a:b] > 0].tobytes(), odd[d]
        cols = {
            "doc_id": pa.array(ids, mask=ids == NO_ID),
            "uid": pa.array(block * UID_STEP + np.arange(len(ids))),
            "n": pa.array(n.astype(np.int64)),
            "h1": pa.array(h1.view(np.int64)),
            "h2": pa.array(h2.view(np.int64)),
            "prefix": pa.array(prefix, pa.list_(pa.int64())),
            "at": pa.array(places, pa.list_(pa.int32())),
            "shared": pa.array(shared, pa.binary()),
            "sketch": pa.array(sketch, pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_pydict(cols)

    return ask


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for na, nb, x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (na + nb - same))
            yield t.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def _fits(percent: int):
    """Sizes fit, and so do places: what two sets can share from their first common shingle on is enough. The rows
    of later common shingles may fail; that of the first one doesn't for a pair that is similar enough. And the
    parity sketches fit: they differ in no more bits than the sets differ in shingles."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    by_place = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & by_place & (differ <= F.col("na") + F.col("nb") - 2 * need)


def _size_class(percent: int):
    """Sizes that fit are in one class or in neighbouring ones."""
    return F.floor(F.log("n") / math.log(100 / percent))


def _hub_pairs(tokens: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the token index (b ..) with the best hubs (a ..) of their token in their size class and the next ones;
    and the written hubs, to be freed."""
    order = Window.partitionBy("token", "size").orderBy("rare", "rep")
    best = tokens.withColumn("k", F.row_number().over(order)).where(F.col("k") <= hubs)  # each task cuts its own before rows move
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")
    names = {"rep": "a", "n": "na", "at": "pa", "sketch": "sa", "c": "ca"}
    best = materialize(best.select("token", near, *[F.col(k).alias(v) for k, v in names.items()]), f"hubs{hubs}")
    other = tokens.withColumnsRenamed({"rep": "b", "n": "nb", "at": "pb", "sketch": "sb", "c": "cb"})
    return other.join(best, ["token", "size"]), best


def _named(tokens: DataFrame, links: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """The token index with components (c), and the tokens that are in more than one."""
    found = connected_components(links).withColumnRenamed("node", "rep")
    named = tokens.join(found, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    named = materialize(named, f"named-tokens{step}")
    mixed = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("classes"))
    return named, materialize(mixed.where("lo <> hi").select("token", "classes"), f"mixed-tokens{step}")


_SIDES = ("rep", "n", "at", "c", "sketch")


def _tile(percent: int):
    """Pairs of a tile's chunks p and q that lie in two components and pass the filters of ``_fits``."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep, n, at, c, chunk = (t.column(k).to_numpy() for k in ("rep", "n", "at", "c", "chunk"))
        sketch = np.asarray(t.column("sketch").chunk(0).flatten()).reshape(len(rep), -1).view(np.uint64)
        a, b = (np.flatnonzero(chunk == t.column(k)[0].as_py()) for k in ("p", "q"))
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(a), 64):
            x = a[i : i + 64, None]
            need = -(-percent * (n[x] + n[b]) // (100 + percent))
            fits = (c[x] != c[b]) & (100 * np.minimum(n[x], n[b]) >= percent * np.maximum(n[x], n[b]))
            fits &= np.minimum(n[x] - at[x], n[b] - at[b]) >= need
            u, v = np.nonzero(fits)
            differ = np.bitwise_count(sketch[x[u, 0]] ^ sketch[b[v]]).sum(1)
            ok = differ <= (n[x] + n[b] - 2 * need)[u, v]
            r, s = rep[x[u[ok], 0]], rep[b[v[ok]]]
            found.append(np.stack([np.minimum(r, s), np.maximum(r, s)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    return run


def _left_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each token's classes in two components that pass the filters. Rows also have ``classes``, the token's."""
    few = tokens.where(F.col("classes") <= FEW)
    x = few.select("token", *[F.col(k).alias(v) for k, v in zip(_SIDES, ("a", "na", "pa", "ca", "sa"), strict=True)])
    y = few.select("token", *[F.col(k).alias(v) for k, v in zip(_SIDES, ("b", "nb", "pb", "cb", "sb"), strict=True)])
    small = x.join(y, "token").where("a < b and ca <> cb").where(_fits(percent)).select("a", "b")
    many = tokens.where(F.col("classes") > FEW).withColumn("chunks", F.ceil(F.col("classes") / TILE).cast("int"))
    many = many.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    p, q = F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q")
    tiles = many.select("token", *_SIDES, "chunk", p, q).groupBy("token", "p", "q").applyInArrow(_tile(percent), "a long, b long")
    return small.unionByName(tiles).distinct()


def _class_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(n, h1, h2, component_id): the least document id of each class' component."""
    label = connected_components(links).withColumnRenamed("node", "rep")
    joined = materialize(classes.join(label, "rep"), "joined-classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.select("rep", "component").join(least, "component").select("rep", "component_id", F.lit(True).alias("is_joined"))
    one = F.when(F.col("is_joined"), F.col("component_id")).otherwise(F.col("least"))
    out = materialize(classes.join(named, "rep", "left").select("n", "h1", "h2", one.alias("component_id")), "class-components")
    free(joined)
    return out


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    blocks = Blocks(docs, id_col, text_col)
    sent = per_block(blocks, _send_counts(blocks.buckets), MESSAGE)
    counts = materialize(per_bucket(sent, _counts), "shingle-counts", "uncompressed")
    info = materialize(per_block(blocks, _sets(blocks.buckets, percent), _INFO, counts), "shingle-sets")
    free(counts)
    blocks.free()
    key = ["n", "h1", "h2"]
    classes = info.where("n > 0").groupBy(*key).agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    own = info.where("prefix is not null").join(classes.select("rep"), F.col("uid") == F.col("rep"), "left_semi")
    rare = (F.col("n") - F.octet_length("shared") / 8) / F.col("n")
    prefix = (F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"))
    sets = own.select(F.col("uid").alias("rep"), "n", rare.alias("rare"), "prefix", "at", "shared", "sketch", *prefix)
    sets = materialize(sets, "sets")
    docs_of = materialize(info.select("doc_id", *key), "document-classes")
    free(info)
    groups = sets.groupBy("n", "p1", "p2").agg(F.min("rep").alias("leader"), F.count("*").alias("members"))
    groups = materialize(groups, "groups")
    member = sets.select("rep", "n", "p1", "p2").join(groups.where("members > 1"), ["n", "p1", "p2"])
    member = member.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    each = sets.select("rep", "n", "rare", "sketch", F.explode(F.arrays_zip("prefix", "at")).alias("t"))
    tokens = each.select("rep", "n", "rare", "sketch", F.col("t.prefix").alias("token"), F.col("t.at").alias("at"))
    tokens = materialize(tokens.withColumn("size", _size_class(percent)), "tokens")

    lead = tokens.join(groups.select(F.col("leader").alias("rep")), "rep", "left_semi").withColumn("c", F.col("rep"))
    star, hubs = _hub_pairs(lead, 1)
    tried = star.where("a <> b").where(_fits(percent)).select("a", "b").unionByName(member)
    tried = materialize(tried.distinct(), "star-pairs")
    free(hubs, groups)
    links = materialize(_verified(tried, sets, percent), "star-links")

    named, mixed = _named(tokens, links, 0)
    again, hubs = _hub_pairs(named.join(mixed.select("token"), "token"), HUBS)
    again = materialize(again.where("ca <> cb").where(_fits(percent)).select("a", "b").distinct(), "more-pairs")
    free(hubs, named, mixed)
    first, links = links, materialize(links.unionByName(_verified(again, sets, percent)), "more-links")
    free(first)

    named, mixed = _named(tokens, links, 1)
    free(tokens)
    done = tried.unionByName(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = _left_pairs(named.join(mixed, "token"), percent).join(done, ["a", "b"], "left_anti")
    left = materialize(left, "left-pairs")
    free(named, mixed, tried, again)
    first, links = links, materialize(links.unionByName(_verified(left, sets, percent)), "all-links")
    free(first, left, sets)

    component = _class_components(classes, links)
    free(links)
    out = docs_of.join(component, key, "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")), "jaccard")
    free(component, classes, docs_of)
    return out


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.c = l.a)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id, n.n
"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES: dict[str, str] = {"op8_jaccard_join": ORACLE}
