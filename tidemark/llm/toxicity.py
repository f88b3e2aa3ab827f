"""Toxicity by a classifier chain.

Categories are predicted one after another; each category's linear model sees
the words of a document and the probabilities of the categories before it.  In
training those probabilities are out-of-fold predictions, so that a later model
meets them as unreliable as they will be on new documents.

The label table has one mark, ``toxic``.  The earlier categories of the chain
are derived from it: ``insult`` (marked, and holds a word that is far likelier
in marked training documents) and ``severe`` (marked, and holds such words at
least three times).  ``fit`` takes any other list of categories.  The words and
the derived categories of an out-of-fold model come from its own folds alone.

Models are fitted on at most ``fitting.SAMPLE_ROWS`` labelled documents and
``MAX_TERMS`` words.  Defined results: a null or empty text has no words and
gets the score of the intercepts; repeated rows are scored each; labels that
are missing or null are not learnt from; with no labels of both kinds nothing
is toxic and scores are the base rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting, scratch
from tidemark.llm import text as tx

CATEGORIES = ("insult", "severe", "toxic")
MODULUS = 3
MAX_TERMS = 2048
FOLDS = 5
#: A word is kept if it is in so many marked documents and so many times likelier there.
LEAST_MARKED, LEAST_RATIO, STRONG_RATIO = 3, 3.0, 12.0

_WORDS = np.full(256, 0x20, np.uint8)
for _i in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORDS[_i] = _i


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter-and-digit words, lower-cased, and the row of each."""
    clean = _WORDS[tx.lowered(buf)]
    starts, ends, first = tx.word_spans(clean, offs)
    # 0 stands for the document itself in the counts
    return np.maximum(tx.span_hash(clean, starts, ends), np.uint64(1)), np.repeat(np.arange(len(offs) - 1), np.diff(first))


@dataclass
class Chain:
    """terms: sorted hashes; weights[c]: of the terms, then of the earlier categories."""

    terms: np.ndarray
    weights: list[np.ndarray]
    biases: list[float]
    categories: tuple[str, ...]

    def predict(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Probabilities [n, categories] of documents with these (row, term) pairs."""
        out = np.zeros((n, len(self.categories)))
        size = len(self.terms)
        for c, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = np.bincount(rows, w[terms], n) + b if len(rows) else np.full(n, b)
            out[:, c] = fitting.sigmoid(z + out[:, :c] @ w[size : size + c])
        return out


def _fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, terms: int, extra: np.ndarray, y: np.ndarray, l2: float = 2e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary columns and dense extra ones."""
    w = np.zeros(terms + extra.shape[1])
    rate = np.clip(y.mean() if n else 0, 1e-3, 1 - 1e-3)
    b = np.array([np.log(rate / (1 - rate))])

    def gradient(_):
        z = b[0] + np.bincount(rows, w[cols], n) + extra @ w[terms:]
        e = (fitting.sigmoid(z) - y) / max(n, 1)
        return [np.r_[np.bincount(cols, e[rows], terms), extra.T @ e] + l2 * w / max(n, 1) * 10, np.array([e.sum()])]

    if n and 0 < y.mean() < 1:
        fitting.adam([w, b], gradient, steps, 0.1)
    return w, float(b[0])


def fit(view, fold: np.ndarray, n: int, categories: tuple[str, ...], terms: list[np.ndarray]) -> Chain:
    """view(k): (rows, columns, labels [n, categories] 0/1) without what fold k tells; view(FOLDS): of all.

    terms: the sorted hashes that the columns of each view stand for.
    """
    size = [len(t) for t in terms]
    seen = [view(k) for k in range(FOLDS + 1)]
    probs = np.zeros((n, 0))
    weights, biases = [], []
    for c in range(len(categories)):
        row, col, y = seen[FOLDS]
        w, b = _fit_linear(row, col, n, size[FOLDS], probs, y[:, c].astype(float))
        weights.append(w)
        biases.append(b)
        out = np.zeros(n)  # out-of-fold, for the models that follow
        for k in range(FOLDS if c + 1 < len(categories) else 0):
            row, col, y = seen[k]
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            place = np.full(n, -1)
            place[train] = np.arange(len(train))
            own = place[row] >= 0
            wk, bk = _fit_linear(place[row[own]], col[own], len(train), size[k], probs[train], y[train, c].astype(float))
            z = bk + np.bincount(row, wk[col], n)[test] + probs[test] @ wk[size[k] :]
            out[test] = fitting.sigmoid(z)
        probs = np.column_stack([probs, out])
    return Chain(terms[FOLDS], weights, biases, categories)


def sampled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, fold, words (distinct hashes, then their counts) of the labelled sample, a saved table."""
    sample = fitting.labelled(docs, labels, ["toxic"], MODULUS)

    def words(batches):
        for batch in batches:
            out = []
            for i, j, buf, offs in tx.chunks(batch.column(3)):
                h, row = word_hashes(buf, offs)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    some, n = np.unique(h[cut[k] : cut[k + 1]], return_counts=True)
                    out.append(np.concatenate([some, n.astype(np.uint64)]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "toxic", "fold", "words"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = sample.select("doc_id", (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"), fold, "text")
    return scratch.saved(rows.mapInArrow(words, "doc_id long, toxic int, fold int, words binary"))


#: Stands among the terms for the documents themselves, so that their number comes with the counts.
_DOCUMENT = np.uint64(0)


def _term_counts(words: DataFrame) -> DataFrame:
    """term, n0 .. : documents that hold the term, for each fold and label; summed in the tasks first."""

    def run(batches):
        terms, slots = [], []
        for batch in batches:
            slot = 2 * batch.column(1).to_numpy() + batch.column(0).to_numpy()
            for x, k in zip(batch.column(2), slot.tolist()):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                terms += [own[: len(own) // 2], np.array([_DOCUMENT])]
                slots.append(np.full(len(own) // 2 + 1, k))
        if terms:
            t, k = np.concatenate(terms), np.concatenate(slots)
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(t[start].astype(np.int64)), pa.array(k[start].astype(np.int32)), pa.array(np.diff(np.r_[start, len(t)]))], ["term", "slot", "n"])

    rows = words.select("toxic", "fold", "words").mapInArrow(run, "term long, slot int, n long")
    return rows.groupBy("term").agg(*(F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)))


def marked_terms(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold left out, then for none: (kept hashes, sorted; which of them are strong marks).

    A term is kept by its smoothed likelihood ratio in the documents of the
    other folds alone, so no held-back label reaches the choice.
    """
    at = np.int64(_DOCUMENT.astype(np.int64))
    documents = counts.where(F.col("term") == F.lit(int(at))).first()
    empty = np.zeros(0, np.uint64), np.zeros(0, bool)
    out = []
    for left_out in range(FOLDS + 1):
        own = [k for k in range(FOLDS) if k != left_out]
        yes, no = (sum(int(documents[f"n{2 * k + mark}"]) for k in own) if documents else 0 for mark in (1, 0))
        if not yes or not no:
            out.append(empty)
            continue
        a, b = (sum((F.col(f"n{2 * k + mark}") for k in own), F.lit(0)) for mark in (1, 0))
        ratio = (a / yes) / ((b + 0.5) / no)
        some = counts.where(F.col("term") != F.lit(int(at))).select("term", a.alias("a"), ratio.alias("ratio")).where((F.col("a") >= LEAST_MARKED) & (F.col("ratio") >= LEAST_RATIO))
        got = some.orderBy(F.desc(F.col("a") * F.log("ratio")), "term").limit(MAX_TERMS).toPandas()
        terms, n = got["term"].to_numpy(np.int64).astype(np.uint64), got["a"].to_numpy(float)
        order = np.argsort(terms)
        # strong: also in a fair share of all marked documents, not in the copies of one
        strong = (got["ratio"].to_numpy(float) >= STRONG_RATIO) & (n >= max(LEAST_MARKED, 0.05 * yes))
        out.append((terms[order], strong[order]))
    return out


def _hits(words: DataFrame, terms: np.ndarray):
    """doc_id, toxic, fold and, of each sampled document, the places in ``terms`` and their counts."""

    def run(batches):
        for batch in batches:
            places, times = [], []
            for x in batch.column(3):
                own, n = np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1)
                at = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
                hit = terms[at] == own if len(terms) else np.zeros(len(own), bool)
                places.append(at[hit].astype("<u2").tobytes())
                times.append(np.minimum(n[hit], 255).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "toxic", "fold", "places", "times"])

    return words.mapInArrow(run, "doc_id long, toxic int, fold int, places binary, times binary").toPandas().sort_values("doc_id", kind="stable")


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fits the default chain on the training rows of the ``toxic`` labels.

    Terms are counted and chosen in Spark; the driver gets the chosen terms and
    the pairs of sampled documents and chosen terms, never the words of texts.
    """
    words = sampled_words(docs, labels)
    counts = scratch.saved(_term_counts(words))
    chosen = marked_terms(counts)
    scratch.drop(counts)
    every = np.unique(np.concatenate([t for t, _ in chosen]))
    got = _hits(words, every)
    scratch.drop(words)
    sizes = [len(x) for x in got["times"]]
    row = np.repeat(np.arange(len(got)), sizes)
    col = np.frombuffer(b"".join(got["places"]), "<u2").astype(np.int64)
    times = np.frombuffer(b"".join(got["times"]), "u1").astype(np.int64)
    toxic, fold = got["toxic"].to_numpy(int) > 0, got["fold"].to_numpy(int)

    def view(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and category labels as the models that leave out fold k see them."""
        terms, strong = chosen[k]
        place = np.full(len(every), -1)
        place[np.searchsorted(every, terms)] = np.arange(len(terms))
        own = place[col]
        loud = np.zeros(len(every), bool)
        loud[np.searchsorted(every, terms[strong])] = True
        n = np.bincount(row, times * loud[col], len(got))
        return row[own >= 0], own[own >= 0], np.column_stack([toxic & (n >= 1), toxic & (n >= 3), toxic]).astype(int)

    return fit(view, fold, len(got), CATEGORIES, [t for t, _ in chosen])


def _probabilities(texts: pa.Array, chain: Chain, table: tx.HashTable):
    """Probabilities of the texts of a batch, a chunk at a time."""
    size = max(len(chain.terms), 1)
    for i, j, buf, offs in tx.chunks(texts):
        h, row = word_hashes(buf, offs)
        term = table.get(h) if len(h) else np.zeros(0, np.int32)
        hit = term >= 0
        pair = np.unique(row[hit] * np.int64(size) + term[hit])
        yield chain.predict(pair // size, pair % size, j - i)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a probability for each category, of every whole text."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        table = tx.HashTable(12)
        table.put(chain.terms, np.arange(len(chain.terms), dtype=np.int32))
        for batch in batches:
            probs = np.concatenate([np.zeros((0, len(names))), *_probabilities(batch.column(1), chain, table)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(probs[:, c]) for c in range(len(names)))], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{x} double" for x in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, a probability for each category, and predicted (0 or 1) of ``toxic``."""
    probs = score(docs, learn(docs, labels))
    last = F.col(f"p_{CATEGORIES[-1]}")
    return probs.withColumn("held_out", fitting.held_out(F.col("doc_id"), MODULUS)).withColumn("predicted", (last >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic.  One pass, no shuffle."""
    chain = learn(docs, labels)
    place = docs.columns.index(text_col)

    def run(batches):
        table = tx.HashTable(12)
        table.put(chain.terms, np.arange(len(chain.terms), dtype=np.int32))
        for batch in batches:
            probs = np.concatenate([np.zeros((0, len(chain.categories))), *_probabilities(batch.column(place), chain, table)])
            yield batch.filter(pa.array(probs[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
