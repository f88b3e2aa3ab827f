"""Streams from outside: any iterable of (key, value) as a Spark streaming source, and channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.functions import envelope
from tidemark.operators.stream import Stream
from tidemark.sources import topics


def import_records(spark: SparkSession, name: str, read: Callable[[int], list[tuple[str, str]]]) -> DataFrame:
    """Records of ``read(offset)``, which returns what follows that offset, as (key, value) text.

    A range that was read before must be given again after a restart.
    """

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"next": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            got = read(start["next"])
            rows = [(start["next"] + i, k, v) for i, (k, v) in enumerate(got)]
            return iter(rows), {"next": start["next"] + len(got)}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            got = read(start["next"])[: end["next"] - start["next"]]
            return iter([(start["next"] + i, k, v) for i, (k, v) in enumerate(got)])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "offset long, key string, value string"

        def simpleStreamReader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    rows = spark.readStream.format(name).load()
    return envelope.require_keys(envelope.to_envelope(rows, name, F.col("key"), F.col("value"), F.col("offset")))


class Import:
    """An import under way: filters and maps on the outside records, then ``integrate``."""

    def __init__(self, spark: SparkSession, name: str, read: Callable[[int], list[tuple[str, str]]]):
        self.stream = Stream(import_records(spark, name, read))

    def filter(self, f: Callable[[Column, Column], Column]) -> Import:
        self.stream = self.stream.filter(f)
        return self

    def map(self, f: Callable[[Column, Column], tuple[Column, Column]]) -> Import:
        self.stream = self.stream.map_key_value(f)
        return self

    def integrate(self) -> Stream:
        """The records as a stream like that of a topic."""
        return self.stream


class Channel:
    """A source that the program itself feeds: what is sent is a topic of its own."""

    def __init__(self, store: topics.TopicStore, name: str):
        self.store, self.name, self.next = store, name, 0
        if store.exists(name):
            last = store.read(name).agg(F.max("offset")).first()[0]
            self.next = 0 if last is None else last + 1

    def send(self, rows: list[tuple[str, str]]) -> None:
        df = self.store.spark.createDataFrame([(k, v, self.next + i) for i, (k, v) in enumerate(rows)], "k string, v string, o long")
        self.store.append(envelope.to_envelope(df, self.name, F.col("k"), F.col("v"), F.col("o"), F.current_timestamp(), timestamp_type="IngestionTime").coalesce(1), self.name)
        self.next += len(rows)

    def stream(self) -> Stream:
        return Stream(envelope.require_keys(self.store.read_stream(self.name)))
