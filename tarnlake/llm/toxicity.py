"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately: one on windows of ordinary labelled texts, one on windows of toxic
ones. A window of text is compressed with either; its gain is how much shorter the toxic dictionary makes it. A text's
largest gains are calibrated to a score by logistic regression on the labelled training rows.

Of a toxic text only a few words are toxic, and only the text is labelled. So the toxic windows are found in rounds: the
first toxic dictionary is trained on windows of toxic texts (``SPAN`` words, every word begins one). A word's windows
are those around it, each pair of neighbours once, so copies of a text add nothing; where they gain more in the mean
than nearly all ordinary words' windows do, and than its own in ordinary texts, the word's windows train the next, smaller
dictionary. Texts are cut in halves for this: a window is judged by the dictionary of the other half, so what one text
alone has gains nothing. A dictionary of windows is trained on as many around each word, so that frequent words don't
crowd out those of a language with few toxic texts.
The last toxic dictionary is trained on the words that these windows are around, as often as they occur, and texts are
scored by windows of one word: on longer ones ordinary neighbours outweigh a toxic word (figures in the README). For this
both sides are compressed by optimal parsing: a fast level passes over matches, which of one word are most of its gain.

Words are lower-cased and parted at white space and punctuation; each byte is written as ``WIDTH`` ones, so that a match
of a short word outweighs a frame.

Fitted on at most ``MAX_FIT_ROWS`` labelled rows, half of each label, by the order of a hash of the id; rows whose
crc32(id as text) mod 5 is 0 are held out. Fitting and scoring take whole texts, also very long ones. Without both labels
in the sample, or with too little text for a dictionary, every score is 0. A null text counts as empty and has no gains.
Repeated rows get the same score. A null id isn't held out. Labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.kernel import FOLDS, Words, fold, release, slices, words_of
from tarnlake.session import table

#: Bound of the sample that the dictionaries and the calibration are fitted on.
MAX_FIT_ROWS = 4000
#: Words of a training window; the least windows around a word that judge it; how many standard errors its mean loses.
SPAN = 3
SUPPORT = 14
SURE = 2.0
#: The share of ordinary words that gain less than a toxic one must, and the least gain of a toxic word.
ORDINARY_SHARE = 0.99
LEAST_GAIN = 2.0
#: Bytes of the ordinary dictionary, of the toxic one in each round of windows, and of the last one, of words.
ORDINARY_BYTES = 200_000
TOXIC_BYTES = (200_000, 40_000)
WORD_BYTES = 8_000
#: Windows that a dictionary is trained on, at most, evenly spread.
TRAINED_ON = 40_000
#: zstandard's level for the windows that find toxic words, and for the words that score a text.
LEVEL = 3
WORD_LEVEL = 16
#: Gains of a text that are features.
TOP = 3
#: A gain that stands for one that a text doesn't have.
NONE = -20.0
WIDTH = 3
CACHE_WORDS = 200_000
_APART = np.zeros(256, bool)
_APART[[9, 10, 11, 12, 13, *(ord(c) for c in " .,!?;:*$%&#|\"'()")]] = True
_OTHERS = [bytes((i * a + b) % 256 for i in range(256)) for a, b in ((7, 131), (11, 57))]


def widen(b: bytes) -> bytes:
    out = bytearray(WIDTH * len(b))
    out[0::WIDTH] = b
    for k, other in enumerate(_OTHERS, 1):
        out[k::WIDTH] = b.translate(other)
    return bytes(out)


def window(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def train(windows: list[bytes], size: int):
    """A zstandard dictionary of at most ``size`` bytes, or None where there is too little to train on."""
    import zstandard as zs

    step = -(-len(windows) // TRAINED_ON)
    try:
        return zs.train_dictionary(size, [widen(w) for w in windows[:: max(1, step)]])
    except (zs.ZstdError, ValueError):
        return None


class Lengths:
    """Compressed lengths of windows with a dictionary (the bytes of a trained one, or of none)."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        import zstandard as zs

        p = zs.ZstdCompressionParameters.from_level(level, source_size=64, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
        self.compress = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary), compression_params=p).compress

    def of(self, windows: list[bytes]) -> np.ndarray:
        f = self.compress
        return np.array([len(f(widen(w))) for w in windows], np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method, the classes as frequent as they are."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w, penalty = np.zeros(z.shape[1]), np.diag([0.0, *[1e-1] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[1:] / dev
    return np.concatenate([[w[0] - float(mean @ scaled)], scaled])


def _tokens(text: str | None, known: dict[bytes, bytes]) -> list[bytes]:
    """The words of a text; ``known`` holds one object for equal words of all texts."""
    w = words_of(pa.array([text], pa.string()), lower=True, apart=_APART)
    raw = w.data.tobytes()
    found = (raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
    return [known.setdefault(x, x) for x in found]


class Windows:
    """The distinct windows of some texts: each text's, in order, and the first text of each."""

    def __init__(self, texts: list[list[bytes]], span: int):
        numbers: dict[bytes, int] = {}
        self.of_text, first = [], []
        for k, words in enumerate(texts):
            own = dict.fromkeys(window(words[i : i + span]) for i in range(max(1, len(words) - span + 1))) if words else {}
            self.of_text.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64))
            first += [k] * (len(numbers) - len(first))
        self.windows, self.half = list(numbers), np.array(first, np.int64) % 2

    def __len__(self) -> int:
        return len(self.windows)

    def pick(self, on: np.ndarray) -> list[bytes]:
        return [self.windows[i] for i in np.flatnonzero(on).tolist()]


def _cross_gains(w: Windows, base: np.ndarray, halves: list) -> np.ndarray:
    """Each window's gain by the dictionary of the other half."""
    out = np.zeros(len(w))
    for h in (0, 1):
        own = w.half == h
        out[own] = base[own] - halves[1 - h].of(w.pick(own))
    return out


def _halves(of_half, size: int, level: int = LEVEL) -> list | None:
    """Lengths by the dictionaries of either half's windows."""
    found = [train(of_half(h), size) for h in (0, 1)]
    return None if None in found else [Lengths(d.as_bytes(), level) for d in found]


def _middles(w: Windows, places: dict[bytes, int]) -> np.ndarray:
    """The word that each window is around, numbered; words that are new get the next number."""
    middle = []
    for x in w.windows:
        words = x.split()
        middle.append(places.setdefault(words[len(words) // 2], len(places)))
    return np.array(middle, np.int64)


def _evenly(middle: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Of the windows that are ``on`` as many around each word, evenly spread, about TRAINED_ON in all; none around words of
    under SUPPORT windows, which can't be found to be toxic. Without other words every window."""
    often = on & (np.bincount(middle) >= SUPPORT)[middle] if len(middle) else on
    if not often.any():
        return on
    at = np.flatnonzero(often)
    at = at[np.argsort(middle[at], kind="stable")]
    word, n = middle[at], np.bincount(middle[at])
    each = max(1, TRAINED_ON // np.count_nonzero(n))
    rank = np.arange(len(at)) - np.searchsorted(word, word)
    picked = np.zeros(len(on), bool)
    picked[at[(n[word] <= each) | (rank * each // n[word] != (rank - 1) * each // n[word])]] = True
    return picked


def _means(middle: np.ndarray, gains: np.ndarray, words: int) -> np.ndarray:
    """Each word's mean gain over the windows around it, less SURE standard errors; -inf for words of under SUPPORT windows."""
    n = np.bincount(middle, minlength=words)
    total = np.bincount(middle, gains, minlength=words)
    few = np.sqrt(np.maximum(n, 1))
    return np.where(n >= SUPPORT, total / np.maximum(n, 1) - SURE * gains.std() / few, -np.inf)


def _toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], by_ordinary: Lengths) -> list[list[bytes]] | None:
    """For either half the toxic words, once for each window around them: those whose windows gain more in the mean than
    nearly all ordinary words' do, and by as much more than their own in ordinary texts."""
    t, o = Windows(toxic, SPAN), Windows(ordinary, SPAN)
    t_base, o_base = by_ordinary.of(t.windows), by_ordinary.of(o.windows)
    places: dict[bytes, int] = {}
    t_middle, o_middle = _middles(t, places), _middles(o, places)
    on = np.ones(len(t), bool)
    for size in TOXIC_BYTES:
        halves = _halves(lambda h, on=on: t.pick(_evenly(t_middle, on & (t.half == h))), size)
        if halves is None:
            return None
        usual = _means(o_middle, _cross_gains(o, o_base, halves), len(places))
        beside = np.maximum(usual, 0)
        usual = usual[usual > -np.inf]
        least = max(LEAST_GAIN, float(np.quantile(usual, ORDINARY_SHARE))) if len(usual) else LEAST_GAIN
        on = (_means(t_middle, _cross_gains(t, t_base, halves), len(places)) - beside >= least)[t_middle]
    words = [window([x]) for x in places]
    return [[words[k] for k in t_middle[on & (t.half == h)].tolist()] for h in (0, 1)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # intercept, the TOP largest gains of different words, log of 1 + words

    def lengths(self) -> tuple[Lengths, Lengths]:
        return Lengths(self.ordinary, WORD_LEVEL), Lengths(self.toxic, WORD_LEVEL)


def features(gains: np.ndarray, words: int) -> list[float]:
    """Of a text's distinct words' gains the largest, and log of 1 + words."""
    best = np.sort(gains)[::-1][:TOP]
    return [*best.tolist(), *[NONE] * (TOP - len(best)), math.log1p(words)]


def fit(rows: list[tuple[str | None, int]], share: float | None = None) -> Model | None:
    """Dictionaries and calibration from (text, label) rows; ``share`` is that of label 1 among all labelled rows, where
    the sample has another one."""
    known: dict[bytes, bytes] = {}
    texts = [(_tokens(t, known), int(y)) for t, y in rows if y in (0, 1)]
    toxic, ordinary = ([w for w, y in texts if y == side] for side in (1, 0))
    del known, texts
    if not toxic or not ordinary:
        return None
    o = Windows(ordinary, SPAN)
    base = train(o.pick(_evenly(_middles(o, {}), np.ones(len(o), bool))), ORDINARY_BYTES)
    del o
    if base is None:
        return None
    release()
    cores = _toxic_words(toxic, ordinary, Lengths(base.as_bytes()))
    if cores is None:
        return None
    release()
    halves = _halves(lambda h: cores[h], WORD_BYTES, WORD_LEVEL)
    last = train(cores[0] + cores[1], WORD_BYTES)
    if halves is None or last is None:
        return None
    by_ordinary = Lengths(base.as_bytes(), WORD_LEVEL)
    t, o = Windows(toxic, 1), Windows(ordinary, 1)
    t_base, o_base = by_ordinary.of(t.windows), by_ordinary.of(o.windows)
    by_half = [t_base - halves[1 - h].of(t.windows) for h in (0, 1)]  # a text is judged by the other half's dictionary
    o_gains = [o_base - halves[h].of(o.windows) for h in (0, 1)]
    x = [features(by_half[k % 2][own], len(w)) for k, (own, w) in enumerate(zip(t.of_text, toxic, strict=True))]
    x += [features(o_gains[k % 2][own], len(w)) for k, (own, w) in enumerate(zip(o.of_text, ordinary, strict=True))]
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(ordinary))])
    weights = _logistic(np.array(x), y)
    if share:
        weights[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    release()
    return Model(base.as_bytes(), last.as_bytes(), tuple(float(v) for v in weights))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on labelled rows outside the held-out fold: at most MAX_FIT_ROWS / 2 of each label."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(fold(F.col("doc_id")) != 0).dropDuplicates(["doc_id"]).withColumn("r", F.xxhash64("doc_id"))
    side = lambda y: known.where(F.col("y") == y).orderBy("r", "doc_id").limit(MAX_FIT_ROWS // 2)
    picked = side(1).unionByName(side(0))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").dropDuplicates(["doc_id"]).collect()  # at most MAX_FIT_ROWS rows
    rows.sort(key=lambda r: r.doc_id)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return fit([(r.text, r.y) for r in rows], n[1] / (n[0] + n[1]) if n.get(0) and n.get(1) else None)


class Scorer:
    """Scores of texts; the gains of words that were met before are remembered."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.by_ordinary, self.by_toxic = model.lengths()
        self.known, self.gain = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order: a dict of them takes ten times the memory

    def _gains(self, w: Words) -> np.ndarray:
        """Gain of each word of the slice; equal words are compressed once."""
        hashes, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        met = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        met[inside] = self.known[at[inside]] == hashes[inside]
        gains = np.zeros(len(hashes), np.int32)
        gains[met] = self.gain[at[met]]
        new = np.flatnonzero(~met)
        raw = w.data.tobytes()
        ordinary, toxic = self.by_ordinary.compress, self.by_toxic.compress
        spans = zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)
        for k, (a, b) in zip(new.tolist(), spans, strict=True):
            x = widen(window([raw[a:b]]))
            gains[k] = len(ordinary(x)) - len(toxic(x))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.gain = hashes[new], gains[new]
        else:
            self.known, self.gain = np.insert(self.known, at[new], hashes[new]), np.insert(self.gain, at[new], gains[new])
        return gains.astype(np.float64)[back]

    def logits(self, texts: pa.Array) -> np.ndarray:
        w = words_of(texts, lower=True, apart=_APART)
        n = len(w.first) - 1
        x = np.full((n, TOP + 1), NONE)
        x[:, TOP] = np.log1p(np.diff(w.first))
        if len(w.hash):
            gains = self._gains(w)
            order = np.lexsort((w.hash, -gains, w.doc))
            doc, h, g = w.doc[order], w.hash[order], gains[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])  # different words of a text
            doc, g = doc[new], g[new]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            best = rank < TOP
            x[doc[best], rank[best]] = g[best]
        return self.weights[0] + x @ self.weights[1:]


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score", by: str = "doc_id") -> DataFrame:
    """(by, out): the score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in slices(batches, text_col):
            s = 1 / (1 + np.exp(-np.clip(scorer.logits(b.column(1)), -30, 30))) if scorer else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[by, out])
        del scorer
        release()

    return docs.select(F.col(by).cast("long").alias(by), F.col(text_col)).mapInArrow(run, f"{by} long, {out} double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted to be toxic; no row moves."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in slices(batches, text_col):
            yield b.filter(pa.array(scorer.logits(b.column(at)) < 0)) if scorer else b
        del scorer
        release()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit_sample(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}


def fold_of(doc_id: int) -> int:
    """The fold of an id, as plain Python has it."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
