"""A quality classifier: a factorisation machine.

A document is a sparse vector of hashed words (damped counts, unit length), statistics of its structure, and the metadata
``n_chars``. Score: bias + linear part + the interactions of all pairs of features through vectors of low rank, in time
linear in the features, as half of (the square of the sum less the sum of squares) in each of the rank's dimensions.
The machine is trained here, on a bounded sample of the labelled documents that are not held out; scoring reads every
text once and sends out a model of fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

#: Labelled documents that are learnt from at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 6_000
WORD_BITS = 15
RANK = 8
EPOCHS = 12
STATISTICS = ["chars", "words", "word_length", "blanks", "capitals", "digits", "symbols", "exclaims", "marks", "beyond_ascii", "lines", "distinct", "repeated_pairs", "stated_chars"]

_CAPITAL, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_CAPITAL[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MARK[[ord(c) for c in ".,;:?'\"()-"]] = 1


def _per_text(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[data])))
    return total[off[1:]] - total[off[:-1]]


def features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, word slots, word values, statistics) of a run of texts; a text without words has none, and zeros."""
    hashes, first = W.word_hashes(data, off, W.NON_BLANK)
    texts, n_words = len(off) - 1, np.diff(first)
    text = np.repeat(np.arange(texts), n_words)
    slot = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(text << WORD_BITS | slot, return_counts=True)
    row, slot = key >> WORD_BITS, key & (1 << WORD_BITS) - 1
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, texts))
    value = (value / norm[row]).astype(np.float32)
    edge = np.searchsorted(row, np.arange(texts + 1))
    chars = np.maximum(1, np.diff(off))
    some = np.maximum(1, n_words)
    pair_text, pair = W.shingles(hashes, first, 2)
    pairs = np.bincount(pair_text, minlength=texts)
    kinds = np.unique(pair + W.mix64(pair_text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    different = np.bincount(pair_text[kinds], minlength=texts)

    def ratio(table: np.ndarray, per: np.ndarray) -> np.ndarray:
        return _per_text(table, data, off) / per

    blank, exclaim, line, beyond = (~W.NON_BLANK).astype(np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    exclaim[33], line[10], beyond[128:] = 1, 1, 1
    stats = [
        np.log1p(chars), np.log1p(n_words), np.minimum(30, chars / some), ratio(blank, chars), ratio(_CAPITAL, chars), ratio(_DIGIT, chars),
        np.minimum(3, ratio(_SYMBOL, some)), np.minimum(3, ratio(exclaim, some)), np.minimum(3, ratio(_MARK, some)), ratio(beyond, chars),
        np.minimum(3, ratio(line, some)), np.diff(edge) / some, 1 - different / np.maximum(1, pairs), np.log1p(np.where(n_chars < 0, chars, n_chars)),
    ]
    return edge, slot, value, np.stack(stats, 1).astype(np.float32)


@dataclass
class Machine:
    """Weights of the bias, of words and statistics (linear), and of both again as vectors of the rank."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def empty(cls) -> Machine:
        n = (1 << WORD_BITS) + len(STATISTICS)
        rng = np.random.default_rng(7)
        return cls(0.0, np.zeros(n, np.float32), rng.normal(0, 0.01, (n, RANK)).astype(np.float32), np.zeros(len(STATISTICS), np.float32), np.ones(len(STATISTICS), np.float32))

    def raw(self, edge: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score before the logistic function, sums of vectors, scaled statistics)."""
        x = np.clip((stats - self.mean) / self.spread, -4, 4)
        words = 1 << WORD_BITS

        def summed(per_entry: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros((1, *per_entry.shape[1:])), np.cumsum(per_entry, 0, dtype=np.float64)))
            return total[edge[1:]] - total[edge[:-1]]

        parts = self.vectors[slot] * value[:, None]
        sums = summed(parts) + x @ self.vectors[words:]
        squares = summed((parts * parts).sum(1)) + (x * x) @ (self.vectors[words:] ** 2).sum(1)
        linear = summed(self.linear[slot] * value) + x @ self.linear[words:]
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, x

    def score(self, edge: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(edge, slot, value, stats)[0], -30, 30)))


def fit(edge: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Logistic loss by AdaGrad over small batches in a fixed order. With one class the machine says the share of label 1,
    held between 0.01 and 0.99, of every text; without any label 0.5."""
    m = Machine.empty()
    if not len(label):
        m.vectors[:] = 0
        return m
    m.mean, m.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    share = float(np.clip(label.mean(), 0.01, 0.99))
    m.bias = float(np.log(share / (1 - share)))
    if label.min() == label.max():
        m.vectors[:] = 0
        return m
    rng, words = np.random.default_rng(11), 1 << WORD_BITS
    g_bias, g_linear, g_vectors = 1e-8, np.full(len(m.linear), 1e-8), np.full(m.vectors.shape, 1e-8)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            n = edge[rows + 1] - edge[rows]
            cut = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(cut[-1]) + np.repeat(edge[rows] - cut[:-1], n)
            s, v = slot[at], value[at]
            raw, sums, x = m.raw(cut, s, v, stats[rows])
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(rows)
            own = np.repeat(np.arange(len(rows)), n)
            used, place = np.unique(s, return_inverse=True)
            d_linear = np.bincount(place, error[own] * v, len(used)) + decay * m.linear[used]
            part = (error[own] * v)[:, None] * (sums[own] - m.vectors[s] * v[:, None])
            d_vectors = np.stack([np.bincount(place, part[:, k], len(used)) for k in range(RANK)], 1) + decay * m.vectors[used]
            d_stat = x.T @ error
            d_stat_vectors = x.T @ (error[:, None] * sums) - ((x * x).T @ error)[:, None] * m.vectors[words:]
            for where, grad, weight, past in ((used, d_linear, m.linear, g_linear), (used, d_vectors, m.vectors, g_vectors), (np.s_[words:], d_stat, m.linear, g_linear), (np.s_[words:], d_stat_vectors, m.vectors, g_vectors)):
                past[where] += grad * grad
                weight[where] -= rate * 5 * grad / np.sqrt(past[where])
            g = error.sum()
            g_bias += g * g
            m.bias -= rate * 5 * g / np.sqrt(g_bias)
    return m


def _rows(doc_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            chars = np.array([-1 if c is None else c for c in batch.column(2).to_pylist()], np.int64)
            for a, b, part, cut in W.chunks(data, off):
                edge, slot, value, stats = features(part, cut, chars[a:b])
                rows = [(slot[i:j].astype(np.int32).tobytes(), value[i:j].tobytes(), x.tobytes()) for i, j, x in zip(edge[:-1], edge[1:], stats, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(3)[a:b], *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["label", "slots", "vals", "stats"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """A machine fitted on at most ``rows`` labelled documents for which ``learn``, a condition on the id, holds.

    Of contradicting labels of one document the lower counts; null ids and labels teach nothing. Where ids stand in
    several rows, at most twice as many texts as ``rows`` are learnt from, those with the smallest hashes.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(learn)
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # the bound of what is broadcast and gathered
    n_chars = F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    found = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), n_chars.alias("_chars"))
    found = found.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    got = found.select("_doc", "_text", "_chars", "_label", "_id").mapInArrow(_rows(doc_id), "label int, slots binary, vals binary, stats binary").orderBy(F.xxhash64("slots", "stats")).limit(2 * rows).collect()
    sizes = [len(r["slots"]) // 4 for r in got]
    edge = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    join = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in got), kind)
    return fit(edge, join("slots", np.int32).astype(np.int64), join("vals", np.float32), join("stats", np.float32).reshape(len(got), len(STATISTICS)), np.array([r["label"] for r in got], np.float64))


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, score) of every row: 0 to 1, higher where label 1 is likelier. Null and empty texts have zeros as features."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    n_chars = F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = pickle.loads(sent.value)
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            chars = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, part, cut in W.chunks(data, off):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(m.score(*features(part, cut, chars[a:b])))], [doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text), n_chars.alias("n_chars")).mapInArrow(run, f"{doc_id} {kind}, score double")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op8_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != 2)
    found = scored(docs, machine)
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
