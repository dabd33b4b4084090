"""Best-fit packing with certified bin counts.

Documents become token pieces; pieces are dealt over partitions and each partition runs best-fit decreasing.
Dual-feasible functions give a lower bound on each partition's bin count. A partition whose count meets its
bound is certified; its well-filled sequences stay. The items of its underfilled sequences, and those of
partitions with a gap, are exchanged: dealt anew over fewer partitions, which run best-fit decreasing again.

Null or empty texts become a document of the end token alone. Repeated rows, and rows of one id or of a null id, are
packed once each. Very long texts are taken whole and cut into pieces of the capacity. Pieces of one length are packed in
the order of their number. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import materialize, table

CAPACITY = 4096
END_ID = 1
#: Pieces in a partition of the first round.
PART_ROWS = 4096
#: A sequence filled to this share stays where it was packed.
GOOD_FILL = 0.998
MAX_ROUNDS = 8
#: Words whose ids a worker remembers.
CACHE_WORDS = 250_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "uid long, part long, bin int, offset long, keep boolean, bound int, bins int"


@lru_cache(1)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(path))


#: How the tokenizer of ``word_bpe_49k.json`` normalises and splits texts, as its file states it.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


class WordEncoder(dict):
    """Ids of texts as little-endian bytes, word by word where the tokenizer allows it.

    One that works as BY_WORDS says drops white space, lower-cases, and never joins over white space, so a text's ids are
    its words' ids in a row. A worker remembers the words it has met. A word of plain Latin letters is one
    pre-token, which goes to the BPE model itself; punctuation after letters or digits is a pre-token of its
    own, so the two parts are looked up apart; all else goes through the whole tokenizer. So does every text with
    a tokenizer that works in another way.
    """

    TRAIL = b".,!?;:*$%&#|"

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        states = json.loads(tokenizer.to_str())
        special = {t["content"] for t in states["added_tokens"]}
        self.by_words = all(states[k] == v for k, v in BY_WORDS.items()) and all(t.startswith("<|") for t in special)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stay
        other = [b for b in range(256) if b not in kept]
        self.letters = dict(zip(kept, kept, strict=True)) | {b: 256 + i for i, b in enumerate(other)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(self.TRAIL)
        if core and core != word and (48 <= core[-1] <= 57 or 97 <= core[-1] <= 122):
            found = self[core] + self[word[len(core) :]]
        else:
            text = word.decode()
            if text.isalpha() and (text.isascii() or max(text) < "\u0180" and "\u0130" not in text):
                found = array("I", [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                found = self.whole(text)
        self[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        out = []
        for t in texts:
            raw = t.encode()
            out.append(self.whole(t) if not self.by_words or b"<|" in raw else b"".join(map(self.__getitem__, raw.lower().split())))
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token pieces; only documents over the capacity are cut."""
    from tarnlake.llm.kernel import release, slices

    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in slices(batches):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for d, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    for name, v in zip(out, (d, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        out[name].append(v)
            longs = (pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *longs], names=list(out))
        encoder.clear()  # workers are kept, and serve other operators next
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the volume bound and a family of dual-feasible functions.

    For a threshold t <= capacity / 2 the function maps items over capacity - t to the capacity, items under t
    to 0, and leaves the rest; a second family, for whole k, rounds item * (k + 1) / capacity down to k-ths.
    Each maps a packing of the items to one of their images, so the images' volume bounds the bin count.
    """
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    total = np.concatenate([[0], np.cumsum(s)])
    t = np.unique(np.minimum(s, capacity - s))
    t = np.concatenate([[0], t[(t > 0) & (t <= capacity // 2)]])
    big, low = np.searchsorted(s, capacity - t, "right"), np.searchsorted(s, t, "left")
    images = total[np.maximum(big, low)] - total[low] + (len(s) - big) * capacity
    best = int(-(-images.max() // capacity))
    for k in range(2, 12):
        x = s * (k + 1)
        whole = x % capacity == 0
        best = max(best, -(-int(np.where(whole, s * k, (x // capacity) * capacity).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. Ties: earlier item first, last opened bin first."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    bins, offsets, fill = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r free
    for i, size in zip(order.tolist(), np.asarray(sizes)[order].tolist(), strict=True):
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_ ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if free > size:
            room[free - size].append(b)
            open_ |= 1 << (free - size)
    return bins, offsets, np.array(fill, np.int64)


def _pack_part(capacity: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("uid", "ascending")])
        sizes = t.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        keep = fill >= GOOD_FILL * capacity
        if len(fill) > bound:  # a gap: also the bins next to the underfilled ones go into the exchange
            near = np.argsort(fill, kind="stable")[: 4 * (len(fill) - bound)]
            keep[near] &= fill[near] == capacity
        keep |= last
        n = len(sizes)
        return pa.table({"uid": t.column("uid"), "part": t.column("part"), "bin": pa.array(bins), "offset": pa.array(offsets), "keep": pa.array(keep[bins]), "bound": pa.array(np.full(n, bound, np.int32)), "bins": pa.array(np.full(n, len(fill), np.int32))})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and place, and the round, bound and bin count of its partition."""
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest, left, rounds = cut.select("uid", "length"), cut.count(), []
    for r in range(MAX_ROUNDS):
        parts = max(1, -(-left // part_rows))
        last = r == MAX_ROUNDS - 1 or (r > 0 and parts == 1)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)))
        placed = materialize(dealt.groupBy("part").applyInArrow(_pack_part(capacity, last), _PLACED), f"packed{r}")
        rounds.append(placed.where("keep").withColumn("round", F.lit(r)))
        if last:
            break
        rest = placed.where("not keep").select("uid").join(cut.select("uid", "length"), "uid")
        left = placed.where("not keep").count()
        if not left:
            break
    placed = rounds[0]
    for other in rounds[1:]:
        placed = placed.unionByName(other)
    sequence = F.col("round").cast("long") * F.lit(1 << 57) + F.col("part") * F.lit(1 << 20) + F.col("bin")
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", F.col("round"), F.col("bound").alias("part_bound"), F.col("bins").alias("part_bins"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
