"""Substring dedup by seed and extend.

Seeds are winnowed anchors: word 8-grams whose hash is the least of some 13 consecutive ones, so that any 20 words
hold one, chosen by these words alone. Documents lie in blocks, and are joined on anchors in four rounds:

1. each block's anchors meet in hash buckets; those that occur more than once are seeds.
2. the 20-word windows around the seeds tell which blocks share what: for each of them, a block that holds a later
   copy is given a block that holds an earlier one. Blocks with the same window form a tree of ``FAN`` children each,
   so a passage that all blocks hold asks none of them for more than ``FAN`` copies.
3. the earlier block sends the words of the shared passage to the later one.
4. a block joins its own texts and these passages on anchors. A seed pair is extended both ways, word by word, to the
   maximal repeat; repeats of ``WINDOW`` words or more are cut from the later text. What is cut has been compared
   word for word: a clash of hashes can hide a repeat (64 bits), never invent one.

A word is removed if a window over it starts earlier elsewhere: in a smaller id, or in the same text before.

Nulls and empty texts have no words; texts of under 20 words lose nothing. A very long text is a block of its own and
treated whole. Documents of a null id come last. Repeated rows, and rows of one id, count as documents of their own,
in the order of the scan. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.blocks import MESSAGE, NO_ID, Blocks, cut, dumps, messages, per_block, per_bucket, planes, unplanes
from tarnlake.llm.kernel import Words, words_of
from tarnlake.session import free, materialize, table

WINDOW = 20
SEED = 8
#: Blocks that one block sends a passage to, at most.
FAN = 8


def slide(a: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The pick of each w consecutive entries; len(a) - w + 1 long."""
    if len(a) < w:
        return a[:0]
    m, size = a, 1
    while size * 2 <= w:
        m, size = pick(m[:-size], m[size:]), size * 2
    return m if size == w else pick(m[: len(a) - w + 1], m[w - size : w - size + len(a) - w + 1])


def anchors(w: Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in words of the slice) and hashes of the anchors."""
    n, width = len(w.hash), window - seed + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = w.grams(seed)[0]
    inside = (np.arange(n) + window <= w.first[w.doc + 1])[: n - width + 1]
    least = np.where(inside, slide(g, width), 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)])
    at = np.flatnonzero((slide(padded, width, np.maximum) == g) & (g > 0))
    return at, g[at]


def windows_near(w: Words, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that hold one of the seeds (positions)."""
    near = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(near, np.maximum(seeds - (WINDOW - SEED), 0), 1)
    np.add.at(near, seeds + 1, -1)
    g, valid = w.grams(WINDOW)
    at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & valid)
    return at, g[at]


def has(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


# --- 1: anchors ------------------------------------------------------------------------------------------------------


def _send_anchors(buckets: int):
    def ask(block, ids, texts, _):
        _, h = anchors(words_of(texts))
        u, n = np.unique(h, return_counts=True)
        yield messages([(k, block, dumps(planes(u[a:b]), n[a:b] > 1)) for k, a, b in cut(u, buckets)])

    return ask


def _repeated(got):
    """Of each block's anchors, those that occur again there or in another block."""
    sent = [(block, unplanes(p), twice) for block, (p, twice) in got]
    every = np.sort(np.concatenate([u for _, u, _ in sent]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    for block, u, twice in sent:
        if (own := twice | has(again, u)).any():
            yield block, (planes(u[own]),)


# --- 2: who has what earlier -----------------------------------------------------------------------------------------


def _packed(*columns: np.ndarray) -> tuple:
    return tuple(planes(np.ascontiguousarray(c)) for c in columns)


def _send_windows(buckets: int):
    def ask(block, ids, texts, replies):
        if not replies:
            yield messages([])
            return
        w = words_of(texts)
        at, h = anchors(w)
        start, g = windows_near(w, at[has(np.sort(np.concatenate([unplanes(r[0]) for r in replies.values()])), h)])
        own = np.arange(len(ids))
        before = np.empty(len(ids), np.int64)
        before[np.lexsort((own, ids))] = own  # the documents in order: ids, then places
        order = np.lexsort((start, before[w.doc[start]], g))
        start, g = start[order], g[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
        start, g = start[new], g[new]  # a block's first of each window
        home = (g >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(g), np.int64)
        order = np.lexsort((start, home))  # by place, so that ids and places compress
        start, g, home = start[order], g[order], home[order]
        edges = np.searchsorted(home, np.arange(buckets + 1)).tolist()
        doc = w.doc[start]
        place = (start - w.first[doc]).astype(np.uint32)
        rows = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                rows.append((k, block, dumps(g[a:b], *_packed(ids[doc[a:b]].view(np.uint64), doc[a:b].astype(np.uint32), place[a:b]))))
        yield messages(rows)

    return ask


def _earlier(got):
    """For each block's window that isn't the first: to the block of an earlier one, who wants what it has where."""
    sent = [(g, unplanes(i).view(np.int64), unplanes(d, np.uint32), unplanes(p, np.uint32)) for _, (g, i, d, p) in got]
    g, ids, doc, place = (np.concatenate([x[j] for x in sent]) for j in range(4))
    owner = np.repeat(np.arange(len(got)), [len(x[0]) for x in sent])
    order = np.lexsort((place, doc, owner, ids, g))
    first = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
    group = np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    rank = np.arange(len(order)) - group
    late = np.flatnonzero(rank)
    source = order[group[late] + (rank[late] - 1) // FAN]
    wants = owner[order[late]]
    by = np.lexsort((place[source], doc[source], wants, owner[source]))
    source, wants = source[by], wants[by]
    blocks = np.array([block for block, _ in got], np.int64)
    edges = np.searchsorted(owner[source], np.arange(len(got) + 1)).tolist()
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            yield int(blocks[k]), _packed(blocks[wants[a:b]].view(np.uint64), doc[source[a:b]], place[source[a:b]])


# --- 3: passages -----------------------------------------------------------------------------------------------------


def _send_passages(block, ids, texts, replies):
    """To each block that wants some of this one's windows, the passages that they make up."""
    rows = []
    if replies:
        parts = [(unplanes(a).view(np.int64), unplanes(b, np.uint32), unplanes(c, np.uint32)) for a, b, c in replies.values()]
        wants, doc, place = (np.concatenate([x[j] for x in parts]) for j in range(3))
        order = np.lexsort((place, doc, wants))
        wants, doc, place = wants[order], doc[order].astype(np.int64), place[order].astype(np.int64)
        follows = (wants[1:] == wants[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)
        begin = np.flatnonzero(np.concatenate([[True], ~follows]))
        last = np.concatenate([begin[1:], [len(place)]]) - 1
        words: dict[int, list[bytes]] = {}
        passages: dict[int, list] = {}
        for to, d, a, b in zip(wants[begin].tolist(), doc[begin].tolist(), place[begin].tolist(), place[last].tolist(), strict=True):
            if d not in words:
                words[d] = texts[d].as_buffer().to_pybytes().split()
            passages.setdefault(to, []).append((int(ids[d]), d, a, b" ".join(words[d][a : b + WINDOW])))
        rows = [(block, to, dumps(*zip(*found, strict=True))) for to, found in passages.items()]
    yield messages(rows)


# --- 4: extension ----------------------------------------------------------------------------------------------------


def extend(own: list[bytes], i: int, other: list[bytes], j: int, n: int) -> list[tuple[int, int]]:
    """Maximal repeats around the seed own[i : i + n], other[j : j + n] on its diagonal, as (begin, end) in own.

    The words are compared one by one, from the seed to the left and to the right as far as they agree. A seed that
    doesn't agree itself (its hashes clashed) falls into the parts that do.
    """
    if own[i : i + n] == other[j : j + n]:
        a, b = i, i + n
        while a > 0 and a - i + j > 0 and own[a - 1] == other[a - 1 - i + j]:
            a -= 1
        while b < len(own) and b - i + j < len(other) and own[b] == other[b - i + j]:
            b += 1
        return [(a, b)]
    out, a = [], i
    for b in range(i, i + n + 1):
        if b == i + n or own[b] != other[b - i + j]:
            if b > a:
                out.append((a, b))
            a = b + 1
    return out


def repeats(w: Words, n_own: int, ids: np.ndarray, part: np.ndarray, offset: np.ndarray, words: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(text, begin, end) of the maximal repeats of WINDOW words or more in the first ``n_own`` texts of something earlier.

    Each text is a part of a document from word ``offset`` on; ``ids``, then ``part``, then the place order them.
    """
    at, h = anchors(w)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    start, g = windows_near(w, at[twice])
    if not len(start):
        return []
    before = np.empty(len(ids), np.int64)
    by = np.lexsort((part, ids))
    step = np.concatenate([[0], (ids[by][1:] != ids[by][:-1]) | (part[by][1:] != part[by][:-1])])
    before[by] = np.cumsum(step)
    doc = w.doc[start]
    place = start - w.first[doc] + offset[doc]
    order = np.lexsort((place, before[doc], g))
    start, g, doc, place = start[order], g[order], doc[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    source = np.repeat(first, np.diff(np.concatenate([first, [len(g)]])))
    late = np.flatnonzero((doc < n_own) & ((before[doc] != before[doc[source]]) | (place != place[source])))
    a, b = start[late], start[source[late]]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    follows = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1) & (w.doc[a[1:]] == w.doc[a[:-1]]) & (w.doc[b[1:]] == w.doc[b[:-1]])
    begin = np.flatnonzero(np.concatenate([[True], ~follows]))[: len(a)]
    length = np.diff(np.concatenate([begin, [len(a)]])) + WINDOW - 1
    i, j = a[begin], b[begin]
    di, dj = w.doc[i], w.doc[j]
    out, done = [], (-1, 0)
    for d, x, e, y, n in zip(di.tolist(), (i - w.first[di]).tolist(), dj.tolist(), (j - w.first[dj]).tolist(), length.tolist(), strict=True):
        if done[0] == d and x + n <= done[1]:
            continue  # an earlier seed's extension went over this one
        for p, q in extend(words[d], x, words[e], y, n):
            if q - p >= WINDOW:
                out.append((d, p, q))
                done = (d, q)
    return out


def _cut(with_text: bool):
    def ask(block, ids, texts, replies):
        own = len(ids)
        found = [(block_, *row) for block_, arrays in sorted(replies.items()) for row in zip(*arrays, strict=True)]
        all_texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([f[4].decode() for f in found], pa.large_string())])
        w = words_of(all_texts)
        raw = w.data.tobytes()
        words = [raw[a:b].split() for a, b in zip(w.text[:-1].tolist(), w.text[1:].tolist(), strict=True)]
        every = np.concatenate([ids, np.array([f[1] for f in found], np.int64)])
        part = np.array([(block, d) for d in range(own)] + [(f[0], f[2]) for f in found], np.int64).reshape(-1, 2)
        part = np.unique(part, axis=0, return_inverse=True)[1].reshape(-1)
        offset = np.array([0] * own + [f[3] for f in found], np.int64)
        cover = np.zeros(w.first[own] + 1, np.int64)
        for d, a, b in repeats(w, own, every, part, offset, words):
            cover[w.first[d] + a] += 1
            cover[w.first[d] + b] -= 1
        removed = np.cumsum(cover)[:-1] > 0
        first = w.first[: own + 1]
        gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[first])
        sha, kept = [], []
        for d in range(own):
            left = words[d]
            if gone[d]:
                left = compress(left, (~removed[first[d] : first[d + 1]]).tolist())
            text = b" ".join(left)
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if with_text else None)
        cols = {
            "doc_id": pa.array(ids, mask=ids == NO_ID),
            "n_words": pa.array(np.diff(first).astype(np.int64)),
            "n_removed": pa.array(gone.astype(np.int64)),
            "kept_sha256": pa.array(sha, pa.string()),
        }
        if with_text:
            cols["text"] = pa.array(kept, pa.string())
        yield pa.RecordBatch.from_pydict(cols)

    return ask


def dedup_substrings(docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, removed words, a digest of the kept words, and these joined by one blank."""
    blocks = Blocks(docs, id_col, text_col)
    seeds = materialize(per_bucket(per_block(blocks, _send_anchors(blocks.buckets), MESSAGE), _repeated), "seeds", "uncompressed")
    wanted = materialize(per_bucket(per_block(blocks, _send_windows(blocks.buckets), MESSAGE, seeds), _earlier), "wanted", "uncompressed")
    free(seeds)
    passages = materialize(per_block(blocks, _send_passages, MESSAGE, wanted), "passages", "uncompressed")
    free(wanted)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    out = materialize(per_block(blocks, _cut(with_text), schema, passages), "substrings")
    free(passages)
    blocks.free()
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each_ AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed, count(*) AS n_words
  FROM each_ e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {"op5_substring_dedup": ORACLE}
