"""The fluent interface: a stream of records, batch or streaming, and what can follow."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import envelope
from tidemark.functions.serde import Serde
from tidemark.operators import aggregates, joins
from tidemark.operators.table import Table
from tidemark.sources import topics


async def _gathered(f, records: list[dict], at_once: int) -> list[dict]:
    gate = asyncio.Semaphore(at_once)

    async def one(record):
        async with gate:
            return await f(record)

    return await asyncio.gather(*(one(r) for r in records))


class Stream:
    """Wraps a DataFrame of records.  Callbacks take and return columns, so that
    Catalyst sees through them; ``map_pandas`` is for code that cannot be columns."""

    def __init__(self, df: DataFrame, app=None):
        self.df, self.app = df, app

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.app)

    # projections, filters, composition
    def map_value(self, f: Callable[[Column], Column]) -> Stream:
        return self._with(self.df.withColumn("value", f(F.col("value"))))

    def map_key_value(self, f: Callable[[Column, Column], tuple[Column, Column]]) -> Stream:
        """Partition and offset stay those of the source record."""
        key, value = f(F.col("key"), F.col("value"))
        return self._with(self.df.withColumns({"key": key, "value": value}))

    def map_headers(self, f: Callable[[Column], Column]) -> Stream:
        return self._with(self.df.withColumn("headers", f(F.col("headers"))))

    def decode_value(self, serde: Serde) -> Stream:
        """The value read from its wire form.  Parsing is a projection of its own, so it is done once a record."""
        parsed = self.df.withColumn("value", serde.parse(F.col("value")))
        return self._with(parsed.withColumn("value", serde.checked(F.col("value"))))

    def map_async(self, f: Callable[[dict], Awaitable[dict]], schema: str, at_once: int = 64) -> Stream:
        """``f`` is a coroutine from a record to a record of ``schema``; so many of a batch run side by side."""

        def run(frames):
            for frame in frames:
                yield pd.DataFrame(asyncio.run(_gathered(f, frame.to_dict("records"), at_once)), columns=names)

        names = T._parse_datatype_string(schema).names
        return self._with(self.df.mapInPandas(run, schema))

    def map_pandas(self, f, schema) -> Stream:
        """``f`` maps an iterator of pandas frames of records to frames of ``schema``."""
        return self._with(self.df.mapInPandas(f, schema))

    def parallel(self, partitions: int) -> Stream:
        """More tasks for the operators that follow."""
        return self._with(self.df.repartition(partitions))

    def filter(self, f: Callable[[Column, Column], Column]) -> Stream:
        """Keeps the records for which ``f(key, value)`` holds."""
        return self._with(self.df.where(f(F.col("key"), F.col("value"))))

    def and_then(self, pipeline: Callable[[Stream], Stream]) -> Stream:
        return pipeline(self)

    def extract_timestamp(self, f: Callable[[Column, Column], Column]) -> Stream:
        """Event time from the record itself."""
        time = f(F.col("key"), F.col("value")).cast("timestamp")
        return self._with(self.df.withColumns({"timestamp": time, "timestamp_type": F.lit("CreateTime")}))

    def dead_letters(self, good: Callable[[Column, Column], Column]) -> tuple[Stream, Stream]:
        """(records that are good, the others); an unknown answer is not good."""
        ok = F.coalesce(good(F.col("key"), F.col("value")), F.lit(False))
        return self._with(self.df.where(ok)), self._with(self.df.where(~ok))

    # tables and joins
    def into_table(self, name: str) -> Table:
        if self.app is not None:
            self.app.registry.table(name)
        return Table(self.df, name)

    def join(self, table: Table, combine: joins.Combiner = joins.pair) -> Stream:
        return self._with(joins.latest(self.df, table.df, combine))

    def left_join(self, table: Table, combine: joins.Combiner = joins.pair) -> Stream:
        return self._with(joins.latest(self.df, table.df, combine, "left"))

    def full_join(self, table: Table) -> DataFrame:
        return joins.full(self.df, table.df)

    def join_by(self, table: Table, key_of: Callable[[Column], Column], combine: joins.Combiner = joins.pair) -> Stream:
        return self._with(joins.by(self.df, table.df, key_of, combine))

    def join_as_of(self, table: Table, combine: joins.Combiner = joins.pair, span: str | None = None) -> Stream:
        return self._with(joins.as_of(self.df, table.records, combine, span=span))

    def join_interval(self, other: Stream, before: str, after: str, lateness: str = "0 seconds", combine: joins.Combiner = joins.pair) -> Stream:
        return self._with(joins.interval(self.df, other.df, before, after, lateness, combine))

    def process(self, f: Callable[..., Column], *tables: Table) -> Stream:
        """``f(value, state ..)`` with read-only views of one table or more; an absent state is null."""
        df, names = self.df, []
        for i, t in enumerate(tables):
            right = t.df.select(F.col("key").alias(f"_key{i}"), F.col("value").alias(f"_state{i}"))
            df = df.join(right, F.col("key") == F.col(f"_key{i}"), "left")
            names.append(F.col(f"_state{i}"))
        return self._with(df.withColumn("value", f(F.col("value"), *names)).select(*envelope.COLUMNS))

    # aggregations
    def count(self) -> DataFrame:
        return aggregates.count(self.df)

    def reduce(self, **functions: Column) -> DataFrame:
        return aggregates.reduce(self.df, **functions)

    def fold(self, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        return aggregates.fold(self.df, start, step)

    # sinks of batches; tidemark.streaming.sinks has those of streams
    def into_topic(self, store: topics.TopicStore, topic: str, key: Serde, value: Serde) -> None:
        store.append(topics.encoded(self.df, key, value), topic)

    def into_debug(self, key: Serde, value: Serde, rows: int | None = None) -> list[str] | None:
        """Logs every record as text where it is; with ``rows``, prints and returns that many of the first."""
        lines = topics.lines(self.df, key, value)
        if rows is None:
            lines.foreachPartition(topics.log_lines)
            return None
        shown = [r.line for r in lines.take(rows)]
        print("\n".join(shown))
        return shown

    def into_noop(self) -> None:
        self.df.write.format("noop").mode("overwrite").save()
