"""Document quality: random-indexing vectors, pooled, and a two-layer network.

Every word of a text is taken twice: as itself and as its shape (runs of upper
case, lower case, digits, other letters and each punctuation byte; a word equal
to the word before it has a shape of its own).  A token's index vector is sparse
and random; its context vector is the sum of the index vectors of its
neighbours over the whole corpus, gathered in Spark into a table of fixed size.
A document is the mean of its tokens' vectors, own index and context together.

The network (tanh layer, logistic output) is fitted in numpy on at most
``fitting.SAMPLE_ROWS`` labelled documents; a fifth of them is held back to
choose the temperature that calibrates its probabilities.  The context
statistics cover all documents.

Defined results: a null or empty text is the zero vector and gets the score of
the biases; repeated rows are scored each; null labels are not learnt from;
labels of one kind only give every document that label's smoothed rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting
from tidemark.llm import text as tx

MODULUS = 3
DIM = 32
NONZERO = 2
REACH = 2
WORD_BITS, SHAPE_BITS = 13, 11
HIDDEN = 24
BLOCKS = 256

_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x30:0x3A] = ord("0")
_KIND[0x41:0x5B] = ord("A")
_KIND[0x61:0x7B] = ord("a")
_KIND[0x80:] = ord("a")
REPEAT = np.uint64(0x5BD1E995)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their shapes, and each row's first word."""
    starts, ends, first = tx.word_spans(buf, offs)
    words = tx.span_hash(buf, starts, ends)
    kind = _KIND[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.r_[0, np.cumsum(keep)]
    shapes = tx.span_hash(kind[keep], place[starts], place[ends])
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    return words, np.where(same, REPEAT, shapes), first


def index_vector(slots: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs [n, NONZERO] of the sparse random vectors of table slots."""
    h = tx.mix(slots.astype(np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64) + np.uint64(seed << 32))
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (tx.mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def context_sums(slots: np.ndarray, first: np.ndarray, bits: int, seed: int, out: np.ndarray) -> None:
    """Adds to out[2**bits, DIM] the index vectors of every token's neighbours in its row."""
    pos, sign = index_vector(np.arange(1 << bits), seed)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(1, REACH + 1):
        same = row[d:] == row[:-d]
        a, b = slots[:-d][same], slots[d:][same]
        # each pair of slots once, with its count
        pair, n = np.unique(a * (1 << bits) + b, return_counts=True)
        a, b = pair >> bits, pair & ((1 << bits) - 1)
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                out += np.bincount(x * DIM + pos[y, k], sign[y, k] * n, out.size).reshape(out.shape)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return fitting.sigmoid(self.logits(x) / self.temperature)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]


def unit_vectors(sums: np.ndarray, seed: int) -> np.ndarray:
    """Own index vector plus the context vector at unit length."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    out = sums / np.maximum(size, 1e-9)
    pos, sign = index_vector(np.arange(len(sums)), seed)
    for k in range(NONZERO):
        out[np.arange(len(sums)), pos[:, k]] += sign[:, k]
    return out.astype(np.float32)


def pooled(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each row."""
    w, s, first = tokens(buf, offs)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIM), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        for c, (h, table, bits) in enumerate(((w, words, WORD_BITS), (s, shapes, SHAPE_BITS))):
            sums = np.add.reduceat(table[_slots(h, bits)], first[:-1][some], axis=0)
            out[some, c * DIM : (c + 1) * DIM] = sums / n[some, None]
    return out


def contexts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of the word and shape slots, over all documents.

    A task sends blocks of its summed table; the tables have a fixed size, so
    what meets in one place is bounded by the number of tasks that feed a block.
    """
    total = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    width = total // BLOCKS

    def run(batches):
        w, s = np.zeros((1 << WORD_BITS, DIM)), np.zeros((1 << SHAPE_BITS, DIM))
        for batch in batches:
            for _, _, buf, offs in tx.chunks(batch.column(0)):
                a, b, first = tokens(buf, offs)
                context_sums(_slots(a, WORD_BITS), first, WORD_BITS, 1, w)
                context_sums(_slots(b, SHAPE_BITS), first, SHAPE_BITS, 2, s)
        both = np.concatenate([w, s]).astype(np.float32)
        rows = [both[k * width : (k + 1) * width] for k in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column(1):
                total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], ["block", "sums"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "block int, sums binary")
    got = {r.block: np.frombuffer(r.sums, np.float64) for r in parts.groupBy("block").applyInArrow(add, "block int, sums binary").collect()}
    table = np.concatenate([got[k].reshape(width, DIM) if k in got else np.zeros((width, DIM)) for k in range(BLOCKS)])
    return unit_vectors(table[: 1 << WORD_BITS], 1), unit_vectors(table[1 << WORD_BITS :], 2)


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 7) -> tuple:
    """(w1, b1, w2, b2, mean, scale, temperature)"""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
    back = np.arange(len(x)) % 5 == 0
    z, t = (x[~back] - mean) / scale, y[~back].astype(float)
    w1, b1 = rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    if len(t) and 0 < t.mean() < 1:
        size = min(len(t), 1024)

        def gradient(_):
            i = rng.integers(0, len(t), size)
            h = np.tanh(z[i] @ w1 + b1)
            e = (fitting.sigmoid(h @ w2 + b2[0]) - t[i]) / size
            d = e[:, None] * w2 * (1 - h * h)
            return [z[i].T @ d + 1e-4 * w1, d.sum(0), h.T @ e + 1e-4 * w2, np.array([e.sum()])]

        fitting.adam([w1, b1, w2, b2], gradient, steps, 0.01)
        logits = np.tanh((x[back] - mean) / scale @ w1 + b1) @ w2 + b2[0]
        heat = fitting.temperature(logits, y[back])
    else:
        w2[:] = 0
        rate = (y.sum() + 1) / (len(y) + 2)
        b2[0], heat = np.log(rate / (1 - rate)), 1.0
    return w1, b1, w2, b2, mean, scale, heat


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Context vectors of all documents, and a network on training rows of ``quality``."""
    words, shapes = contexts(docs)
    sample = fitting.labelled(docs, labels, ["quality"], MODULUS).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    got = _vectors(sample, words, shapes, "quality").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in got["vector"]]).astype(float) if len(got) else np.zeros((0, 2 * DIM))
    return Model(words, shapes, *fit_network(x, (got["quality"].to_numpy(int) > 0).astype(int)))


def _vectors(rows: DataFrame, words: np.ndarray, shapes: np.ndarray, extra: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [v.tobytes() for i, j, buf, offs in tx.chunks(batch.column(1)) for v in pooled(buf, offs, words, shapes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", extra, "vector"])

    return rows.mapInArrow(run, f"doc_id long, {extra} int, vector binary")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text.  The model's size is fixed; it travels with the tasks."""

    def run(batches):
        for batch in batches:
            parts = [model.score(pooled(buf, offs, model.words, model.shapes)) for _, _, buf, offs in tx.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more)."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", fitting.held_out(F.col("doc_id"), MODULUS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least the threshold.  One pass, no shuffle."""
    model = learn(docs, labels)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            parts = [model.score(pooled(buf, offs, model.words, model.shapes)) for _, _, buf, offs in tx.chunks(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
