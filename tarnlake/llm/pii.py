"""PII: patterns, then information-theoretic sanitisation.

Emails, IP addresses, card and phone numbers are found by pattern; their values are the protected entities. All terms
of the documents that hold an entity are judged by how much they tell about it. Over the corpus, all counts are of
documents, copies included: n(e) with an entity, n(t, e) with an entity and a term, df(t) with the term, N all:

    PMI(t; e) = log2(n(t, e) * N / (df(t) * n(e)))    IC(e) = log2(N / n(e))    disclosure = PMI / IC

A disclosure of 1 says that the term appears with the entity alone. Terms met with an entity in ``SUPPORT``
documents or more are generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever they are in the
documents that hold it; documents that name a term without the entity keep it.

As n(t, e) is at most n(e), a term of df(t) > sqrt(N * n(e)) can't reach ``GENERALISE`` (of 0.5 or more). So terms are
counted first, the common ones are left out, and only the others are paired with entities. Only candidate terms are
counted: a bitmap of their hashes, of at most ``BITMAP_BITS`` bits, goes to the pass over all documents; what it lets
through by chance is dropped by the join on the hashes themselves.

Null texts count as empty and stay null where texts are returned. Repeated rows, and rows of one id or of a null id,
are documents of their own. Very long texts are taken whole. A term at exactly a threshold is over it. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.kernel import slices, words_of
from tarnlake.session import materialize, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
GENERALISE = 0.5
REMOVE = 0.9
BITMAP_BITS = 1 << 26

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit before a start is never free: the match before it would have taken it. So whole runs only.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_APART = np.zeros(256, bool)
_APART[[9, 10, 11, 12, 13, *(ord(c) for c in " !\"#$%&()*,.:;<=>?[]{|}~")]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them, from each @ on: linear also in long runs without one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCALS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _value(kind: int, s: str) -> int:
    plain = s.lower() if kind < 2 else _digits(s)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


_FOUND = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
    "entities array<long>, terms array<long>, starts array<int>, ends array<int>"
)


def _free_words(texts: pa.Array, spans: list[list[tuple[int, int, int]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the hashes, starts and ends of its words outside the spans."""
    w = words_of(texts, lower=True, apart=_APART)
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    out = []
    for d, own in enumerate(spans):
        a, b = w.first[d], w.first[d + 1]
        base = points[w.text[d]]
        start, end = points[w.start[a:b]] - base, points[w.end[a:b]] - base
        free = np.ones(b - a, bool)
        for s, _, e in own:
            free[np.searchsorted(end, s, "right") : np.searchsorted(start, e, "left")] = False
        out.append((w.hash[a:b][free].view(np.int64), start[free], end[free]))
    return out


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind.to_pandas_dtype()), kind))


def find(docs: DataFrame) -> DataFrame:
    """Base spans, counts and entities of each whole text, and all terms of the texts with entities, of (doc_id, text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in slices(batches):
            strings = [t or "" for t in b.column(1).to_pylist()]
            spans = [base_spans(t) for t in strings]
            texts = [shown(s) for s in spans]
            own = [i for i, s in enumerate(spans) if s]
            entities = [np.array(sorted({_value(k, t[x:y]) for x, k, y in s}), np.int64) for s, t in zip(spans, strings, strict=True)]
            words = [(none, none, none)] * len(spans)
            if own:
                free = _free_words(b.column(1).take(pa.array(own, pa.int64())), [spans[i] for i in own])
                for i, x in zip(own, free, strict=True):
                    words[i] = x
            columns = {"doc_id": b.column(0), "row": b.column(2)}
            for k, name in enumerate(KINDS[:4]):
                columns[f"n_{name}"] = pa.array([sum(1 for x in s if x[1] == k) for s in spans], pa.int64())
            columns["base"] = pa.array(texts, pa.string())
            columns["base_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            columns["entities"] = _lists(entities, pa.int64())
            for k, (name, kind) in enumerate((("terms", pa.int64()), ("starts", pa.int32()), ("ends", pa.int32()))):
                columns[name] = _lists([x[k] for x in words], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text", "row").mapInArrow(run, _FOUND)


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, df): in how many documents each of ``terms`` (column t, distinct) is."""
    n = terms.count()
    bits = min(BITMAP_BITS, 1 << max(10, (16 * n).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    at = F.expr(f"shiftrightunsigned(t, {shift})")
    bitmap = np.zeros(bits // 8, np.uint8)
    rows = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 AS INT))")).alias("v"))
    for r in rows.toLocalIterator():  # at most BITMAP_BITS / 8 rows
        bitmap[r["byte"]] = r["v"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # at most BITMAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_map = shared.value
        for b in slices(batches):
            w = words_of(b.column(0), lower=True, apart=_APART)
            place = w.hash >> np.uint64(shift)
            hit = np.flatnonzero((b_map[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            h, doc = w.hash[hit], w.doc[hit]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
            t, c = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=["t", "c"])

    part = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("df"))
    return terms.join(part, "t")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, t, disclosure): the terms from GENERALISE on of each row, with the most that they tell of an entity in it."""
    total = float(found.count())
    held = found.where(F.size("entities") > 0)
    each = held.select("row", F.explode("entities").alias("e"))
    entities = materialize(each.groupBy("e").agg(F.count("*").alias("ne")).where(F.col("ne") >= SUPPORT), "entities")
    recurring = each.join(entities, "e").groupBy("row").agg(F.collect_list(F.struct("e", "ne")).alias("es"))
    held = materialize(held.join(recurring, "row").select("row", "es", F.array_distinct("terms").alias("ts")), "held")
    terms = held.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("t")
    counts = materialize(document_counts(docs, materialize(terms, "terms"), text_col), "term-counts")
    most = total * float(entities.agg(F.max("ne")).first()[0] or 0)
    can = lambda product: F.col("df") * F.col("df") <= product * (1 + 1e-9)
    hot = counts.where(~can(F.lit(most))).select("t")  # at most (mean distinct terms a document) * sqrt(N / the most n(e)) rows
    met = held.select("row", "es", F.explode("ts").alias("t")).join(F.broadcast(hot), "t", "left_anti").join(counts.where(can(F.lit(most))), "t")
    met = materialize(met.select("row", "t", "df", F.explode("es").alias("x")).select("row", "t", "df", "x.e", "x.ne").where(can(F.lit(total) * F.col("ne"))), "term-pairs")
    pairs = met.groupBy("t", "e", "df", "ne").agg(F.count("*").alias("nte")).where(F.col("nte") >= SUPPORT)
    ic = F.log2(F.lit(total) / F.col("ne"))
    pmi = F.log2(F.col("nte") * F.lit(total) / (F.col("df") * F.col("ne")))
    ratio = F.when(ic > 0, F.least(F.lit(1.0), pmi / ic)).otherwise(F.lit(0.0))
    pairs = pairs.withColumn("disclosure", ratio).where(F.col("disclosure") >= GENERALISE).select("t", "e", "disclosure")
    return met.join(pairs, ["t", "e"]).groupBy("row", "t").agg(F.max("disclosure").alias("disclosure"))


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, removed string"


def _judged(docs: DataFrame) -> DataFrame:
    """(row, and _SPANS) of (doc_id, text, row); rows must not change when they are read again."""
    found = materialize(find(docs), "pii")
    by_row = disclosing(docs, found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("t", "disclosure"))).alias("hits"))
    own = lambda c: F.when(F.col("hits").isNotNull(), F.col(c)).alias(c)
    rows = found.join(materialize(by_row, "disclosing"), "row", "left")
    counts = [f"n_{k}" for k in KINDS[:4]]
    rows = rows.select("row", "doc_id", *counts, "base_sha256", "base", *map(own, ("terms", "starts", "ends")), F.col("hits.t").alias("ts"), F.col("hits.disclosure").alias("ds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_, removed = b.column("base").to_pylist(), [""] * b.num_rows
            for i in np.flatnonzero(np.asarray(b.column("ts").is_valid())).tolist():
                t, start, end, ts, ds = (np.asarray(b.column(c)[i].values) for c in ("terms", "starts", "ends", "ts", "ds"))
                at = np.minimum(np.searchsorted(ts, t), len(ts) - 1)
                hit = np.flatnonzero(ts[at] == t)
                near = list(zip(start[hit].tolist(), end[hit].tolist(), ds[at[hit]].tolist(), strict=True))
                base = [(int(x), KINDS.index(k), int(y)) for k, x, y in (s.split(":") for s in filter(None, all_[i].split(",")))]
                all_[i] = shown(sorted(base + [(x, KINDS.index("term"), y) for x, y, _ in near]))
                removed[i] = ",".join(f"{x}:{y}" for x, y, share in near if share >= REMOVE)
            arrays = [*(b.column(k) for k in range(7)), pa.array(all_, pa.string()), pa.array(removed, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *(x.split()[0] for x in _SPANS.split(", "))])

    return rows.mapInArrow(run, "row long, " + _SPANS)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, base digest, all spans, and of the term spans those to remove."""
    return _judged(_numbered(docs, id_col, text_col)).drop("row")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of each row: entities as [KIND], disclosing terms as [TERM] or, from REMOVE on, left out."""
    texts = materialize(_numbered(docs, id_col, text_col), "texts")
    joined = texts.join(_judged(texts).select("row", "spans", "removed"), "row").select("doc_id", "text", "spans", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own, gone in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                parts, at, drop = [], 0, set(filter(None, gone.split(",")))
                for s in filter(None, own.split(",")):
                    kind, x, y = s.split(":")
                    if int(y) > at:
                        left_out = kind == "term" and f"{x}:{y}" in drop
                        parts += [text[at : max(at, int(x))], "" if left_out else f"[{kind.upper()}]"]
                        at = int(y)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id long, text string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
