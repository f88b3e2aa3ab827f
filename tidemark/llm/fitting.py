"""Helpers to fit small models on a bounded, documented sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def held_out(column: Column, modulus: int) -> Column:
    """Whether a row's crc32 of the id as text leaves remainder 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus == 1


def labelled(docs: DataFrame, labels: DataFrame, label_cols: list[str], modulus: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and labels of at most ``rows`` training documents.

    The rows taken are those of least hash, so every label has the same chance,
    and the same rows come each time.  The sample's size is proven, so it is
    broadcast and the documents are not shuffled.
    """
    own = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus))
    own = own.select("doc_id", *label_cols).dropna().dropDuplicates(["doc_id"])
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(params: list[np.ndarray], gradient, steps: int, rate: float = 0.02) -> None:
    """Minimises in place; ``gradient(step)`` returns an array for each parameter."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(t), m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives least log loss on held-back rows."""
    if len(labels) < 20 or labels.min() == labels.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(labels > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])
