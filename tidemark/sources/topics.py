"""Topics: append-only folders of records, read as a batch or a stream.

``TopicStore`` resolves a topic's name; another store with the same methods
(for a message broker, say) can take its place without a change elsewhere.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import envelope
from tidemark.functions.serde import Serde


class TopicNotFound(LookupError):
    pass


class TopicAlreadyRegistered(ValueError):
    pass


#: What a reader sees of writes that are not committed.
ISOLATION = ("read_committed", "read_uncommitted")


class TopicStore:
    """Topics as Parquet folders ``{root}/{name}``; keys and values are in wire form."""

    WIRE = envelope.schema(T.StringType(), T.StringType())

    def __init__(self, spark: SparkSession, root: str, isolation: str = "read_committed"):
        if isolation not in ISOLATION:
            raise ValueError(f"unknown isolation level {isolation!r}")
        self.spark, self.root, self.isolation = spark, root.rstrip("/"), isolation

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def exists(self, topic: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(topic))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _require(self, topic: str) -> None:
        if not self.exists(topic):
            raise TopicNotFound(topic)

    def read(self, topic: str) -> DataFrame:
        """What is committed; with read_uncommitted, also the files of batches that are not yet."""
        self._require(topic)
        reader = self.spark.read.schema(self.WIRE)
        if self.isolation == "read_uncommitted":
            # a pattern passes by the commit log of the folder
            return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{self.path(topic)}/*")
        return reader.parquet(self.path(topic)).select(*envelope.COLUMNS)

    def read_stream(self, topic: str, max_files: int | None = None) -> DataFrame:
        self._require(topic)
        reader = self.spark.readStream.schema(self.WIRE)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self.path(topic)).select(*envelope.COLUMNS)

    def append(self, records: DataFrame, topic: str) -> None:
        records.select(*envelope.COLUMNS).write.mode("append").parquet(self.path(topic))

    def replace_batch(self, records: DataFrame, topic: str, batch: int) -> None:
        """Appends a micro-batch in a folder of its own; the same batch again replaces it."""
        records.select(*envelope.COLUMNS).write.mode("overwrite").parquet(f"{self.path(topic)}/batch={batch}")

    def append_stream(self, records: DataFrame, topic: str, checkpoint: str):
        """A writer of exactly-once files; the caller sets the trigger and starts it."""
        return records.select(*envelope.COLUMNS).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", self.path(topic))


class Registry:
    """A topic is read once in an application, and a table's name is taken once."""

    def __init__(self):
        self.topics: set[str] = set()
        self.tables: set[str] = set()

    def topic(self, name: str) -> None:
        if name in self.topics:
            raise TopicAlreadyRegistered(name)
        self.topics.add(name)

    def table(self, name: str) -> None:
        if name in self.tables:
            raise TopicAlreadyRegistered(f"table {name}")
        self.tables.add(name)


def decoded(records: DataFrame, key: Serde, value: Serde) -> DataFrame:
    """Wire records as typed records.  A null key or value fails the query; parsing is done once a record."""
    kept = envelope.require_keys(records)
    parsed = kept.withColumns({"key": key.parse(F.col("key")), "value": value.parse(F.col("value"))})
    return parsed.withColumns({"key": key.checked(F.col("key")), "value": value.checked(F.col("value"))})


def lines(records: DataFrame, key: Serde, value: Serde) -> DataFrame:
    """``line``: key and value in wire form, as text."""
    return encoded(records, key, value).select(F.concat_ws(": ", F.col("key").cast("string"), F.col("value").cast("string")).alias("line"))


def log_lines(rows) -> None:
    """To the log of the executor that has the rows; a line each, none left out."""
    log = logging.getLogger("tidemark.debug")
    if not log.hasHandlers():
        log.addHandler(logging.StreamHandler())
    log.setLevel(logging.INFO)
    for r in rows:
        log.info(r.line)


def encoded(records: DataFrame, key: Serde, value: Serde) -> DataFrame:
    """Typed records as wire records; time and headers stay."""
    return records.withColumns({"key": key.encode(records["key"]), "value": value.encode(records["value"])})
