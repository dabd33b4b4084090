"""Quality rules learned as an ordered decision list.

Statistics of every whole text come from one Arrow pass. Sequential covering learns the list from labelled rows:
a rule grows by the threshold condition of largest information gain on two thirds of them, is pruned on the
other third, and is kept while it is precise there; the rows that it covers are taken out, and the next rule is
grown. The list is emitted as one ordered conditional expression of Spark: the first rule that holds decides,
and a text that none covers is kept.

Fitted on at most ``MAX_FIT_ROWS`` labelled rows, half of each label, by the order of a hash of the id; rows whose
crc32(id as text) mod 5 is 0 are held out, for measuring (``held_out_figures``). Each row weighs as many labelled rows
as it stands for, so gain, pruning worth and precision are those of the labels' true share, whatever the input's size;
without both labels no rule is learned. Of conditions of one gain the first by ratio and threshold is taken. Null and
empty texts have zeros as statistics and fail the base rule. Very long texts are taken whole. Repeated rows get
repeated results; of labels of one id one is taken. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.kernel import fold, mix, slices, words_of
from tarnlake.session import materialize, table

MAX_FIT_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVER = 8
THRESHOLDS = 40
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct", "longest_word")
_SYMBOL, _UPPER, _DIGIT, _STOP, _LEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".!?,;:"]] = True
_LEAD[:] = True
_LEAD[0x80:0xC0] = False


def _sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    w = words_of(texts)
    n, d = len(w.first) - 1, w.data
    raw = d.tobytes()
    space = (d == 32) | ((d >= 9) & (d <= 13))
    n_words = np.diff(w.first)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(w.text[:-1].tolist(), w.text[1:].tolist(), strict=True)):
        own = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        dup[i], lines[i] = len(own) - len(set(own)), len(own)
    repeat, distinct, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(w.hash):
        grams, valid = w.grams(5)
        at = np.flatnonzero(valid)
        key = grams[at] ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
        repeat = _sum(np.cumsum(cover)[:-1] > 0, w.first)
        order = np.lexsort((w.hash, w.doc))
        h, doc = w.hash[order], w.doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        distinct = np.bincount(doc[new], minlength=n)
        np.maximum.at(longest, w.doc, w.end - w.start)
    return dict(zip(COUNTS, (n_words, _sum(_LEAD[d] & ~space, w.text), _sum(_SYMBOL[d], w.text), dup, repeat, lines, _sum(_UPPER[d], w.text), _sum(_DIGIT[d], w.text), _sum(_STOP[d], w.text), distinct, longest), strict=True))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What conditions are on: a name and its value from the counts.
RATIOS = {
    "words": ("n_words", None),
    "symbols_by_chars": ("n_symbols", "word_chars"),
    "dup_by_lines": ("n_dup_lines", "n_lines"),
    "repeated_by_words": ("n_repeat_words", "n_words"),
    "upper_by_chars": ("n_upper", "word_chars"),
    "digits_by_chars": ("n_digits", "word_chars"),
    "stops_by_words": ("n_stops", "n_words"),
    "distinct_by_words": ("n_distinct", "n_words"),
    "chars_by_words": ("word_chars", "n_words"),
    "words_by_lines": ("n_words", "n_lines"),
    "longest_word": ("longest_word", None),
}


def ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass
class Rule:
    conditions: list[tuple[int, bool, float]]  # ratio, whether at least, threshold
    precision: float
    cover: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, least, t in self.conditions:
            out &= (x[:, j] >= t) if least else (x[:, j] <= t)
        return out

    def column(self) -> Column:
        names, out = list(RATIOS), F.lit(True)
        for j, least, t in self.conditions:
            out = out & ((ratio(names[j]) >= F.lit(float(t))) if least else (ratio(names[j]) <= F.lit(float(t))))
        return out


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FOIL's information gain."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[int, bool, float]]:
    on, found = np.ones(len(x), bool), []
    while len(found) < MAX_CONDITIONS:
        wp, wa = np.where(y, w, 0.0)[on], w[on]
        p0, n0 = wp.sum(), w[on & ~y].sum()
        if not p0 or not n0:
            break
        best = (1e-6, None)
        for j in range(x.shape[1]):
            v = x[on, j]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS))):
                for least in (True, False):
                    c = v >= t if least else v <= t
                    p = float(wp @ c)
                    g = float(_gain(p0, n0, np.array(p), np.array(float(wa @ c) - p)))
                    if g > best[0] + 1e-12:
                        best = (g, (j, least, float(t)))
        if best[1] is None:
            break
        j, least, t = best[1]
        found.append(best[1])
        on &= (x[:, j] >= t) if least else (x[:, j] <= t)
    return found


def merged(conditions: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    """Of conditions on the same side of a ratio only the tightest."""
    out: dict[tuple[int, bool], float] = {}
    for j, least, t in conditions:
        old = out.get((j, least), t)
        out[j, least] = max(old, t) if least else min(old, t)
    return [(j, least, t) for (j, least), t in out.items()]


def _precision(y: np.ndarray, w: np.ndarray, c: np.ndarray) -> float:
    return float(w[y & c].sum() / w[c].sum())


def learn(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> list[Rule]:
    """Ordered rules for y (true: of low quality); rows are taken in the order given, w is how many each stands for."""
    w = np.ones(len(y)) if w is None else w
    rules: list[Rule] = []
    fold = np.arange(len(y)) % 3 == 2
    on = np.ones(len(y), bool)
    while len(rules) < MAX_RULES:
        grow, prune = on & ~fold, on & fold
        if y[grow].sum() < MIN_COVER or (~y[grow]).sum() == 0:
            break
        conditions = _grow(x[grow], y[grow], w[grow])
        if not conditions:
            break

        def worth(k: int) -> float:
            c = Rule(conditions[:k], 0, 0).holds(x[prune])
            p, n = w[prune][y[prune] & c].sum(), w[prune][~y[prune] & c].sum()
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(1, len(conditions) + 1), key=lambda k: (round(worth(k), 9), -k))
        rule = Rule(merged(conditions[:k]), 0, 0)
        c = rule.holds(x[on])
        rule.precision, rule.cover = _precision(y[on], w[on], c) if c.any() else 0.0, int(c.sum())
        held = rule.holds(x[prune])
        if rule.cover < MIN_COVER or rule.precision < MIN_PRECISION or (held.any() and _precision(y[prune], w[prune], held) < MIN_PRECISION):
            break
        rules.append(rule)
        on &= ~rule.holds(x)
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """True where a text is kept: the first rule that holds rejects it."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> list[Rule]:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(fold(F.col("doc_id")) != 0).dropDuplicates(["doc_id"]).withColumn("r", F.xxhash64("doc_id"))
    half = MAX_FIT_ROWS // 2
    counts = {n["y"]: n["count"] for n in known.groupBy("y").count().collect()}  # one row a label
    picked = known.where("y = 0").orderBy("r", "doc_id").limit(half).unionByName(known.where("y = 1").orderBy("r", "doc_id").limit(half))
    named = [ratio(n).alias(f"x{i}") for i, n in enumerate(RATIOS)]
    rows = stats.join(F.broadcast(picked), "doc_id").select("doc_id", "r", "y", *named).dropDuplicates(["doc_id"])
    rows = rows.toPandas().sort_values(["r", "doc_id"])  # at most MAX_FIT_ROWS rows
    y = rows["y"].to_numpy() == 0
    if y.all() or not y.any():
        return []
    w = rows["y"].map({k: n / min(n, half) for k, n in counts.items()}).to_numpy(float)
    return learn(rows[[f"x{i}" for i in range(len(RATIOS))]].to_numpy(float), y, w)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = materialize(text_statistics(docs), "quality-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = decision_list(fit_rules(stats, labels))
    return stats.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & kept).alias("kept"))


def held_out_figures(result: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Of held-out labelled rows that the base rule passes: how many of low quality go, and how many good ones stay."""
    known = labels.where("quality in (0, 1)").where(fold(F.col("doc_id")) == 0).dropDuplicates(["doc_id"])
    rows = result.where("not base_failed").join(known.select("doc_id", "quality"), "doc_id")
    by = {r.quality: (r.n, r.kept) for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    low, good = by.get(0, (0, 0)), by.get(1, (0, 0))
    return {"low": low[0], "low_rejected": low[0] - low[1], "good": good[0], "good_kept": good[1]}


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
