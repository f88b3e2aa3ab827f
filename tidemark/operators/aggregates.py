"""Aggregations by key and by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope


def count(records: DataFrame) -> DataFrame:
    return records.groupBy("key").agg(F.count("*").alias("count"))


def reduce(records: DataFrame, **functions: Column) -> DataFrame:
    """Associative aggregates, which combine before the shuffle: ``reduce(df, total=F.sum(...))``."""
    return records.groupBy("key").agg(*(f.alias(n) for n, f in functions.items()))


def fold(records: DataFrame, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold in order of arrival, for steps that are not associative.

    It needs the values of a key together; use ``reduce`` for what is associative.
    """
    values = F.array_sort(F.collect_list(F.struct("offset", "partition", "value")))
    return records.groupBy("key").agg(F.aggregate(F.transform(values, lambda x: x["value"]), start, step).alias("value"))


def _timed(records: DataFrame, lateness: str) -> DataFrame:
    return records.withWatermark("timestamp", lateness) if records.isStreaming else records


def _ends(df: DataFrame, functions: dict) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "key", *functions)


def windowed(records: DataFrame, length: str, slide: str | None = None, lateness: str = "0 seconds", **functions: Column) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``, of event time by key."""
    w = F.window("timestamp", length, slide) if slide else F.window("timestamp", length)
    return _ends(_timed(records, lateness).groupBy(w.alias("window"), "key").agg(*(f.alias(n) for n, f in functions.items())), functions)


def sessions(records: DataFrame, gap: str, lateness: str = "0 seconds", **functions: Column) -> DataFrame:
    """Windows that end when a key is silent for ``gap``."""
    w = F.session_window("timestamp", gap)
    return _ends(_timed(records, lateness).groupBy(w.alias("window"), "key").agg(*(f.alias(n) for n, f in functions.items())), functions)


def store_time(records: DataFrame) -> DataFrame:
    return records.agg(F.max(envelope.event_time()).alias("store_time"))
