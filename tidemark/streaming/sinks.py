"""Sinks of streaming queries.  Each returns the started query."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.serde import Serde
from tidemark.sources import topics

#: The names of the delivery guarantees.
GUARANTEES = ("AtMostOnce", "AtLeastOnce", "ExactlyOnce")
INTERVAL = "250 milliseconds"


def _start(writer, once: bool, interval: str) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def _each(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool, interval: str, mode: str = "append") -> StreamingQuery:
    return _start(records.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint), once, interval)


def _first_time(records: DataFrame, checkpoint: str, batch_id: int) -> bool:
    """Marks a batch as begun; False if it was before."""
    spark = records.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/begun/{batch_id}")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(at))


def into_topic(records: DataFrame, store: topics.TopicStore, topic: str, key: Serde, value: Serde, checkpoint: str, once: bool = False, interval: str = INTERVAL, guarantee: str = "ExactlyOnce") -> StreamingQuery:
    """Appends to a topic; the checkpoint makes a restart go on where it stopped.

    ExactlyOnce writes through the commit log of the topic's folder.  With
    AtLeastOnce a batch that failed half-way is written again as a whole; with
    AtMostOnce a batch that was begun is never begun again.
    """
    if guarantee not in GUARANTEES:
        raise ValueError(f"unknown delivery guarantee {guarantee!r}")
    wire = topics.encoded(records, key, value)
    if guarantee == "ExactlyOnce":
        return _start(store.append_stream(wire, topic, checkpoint), once, interval)

    def write(batch: DataFrame, batch_id: int) -> None:
        if guarantee == "AtLeastOnce" or _first_time(batch, checkpoint, batch_id):
            store.append(batch, topic)

    return _each(wire, write, checkpoint, once, interval)


def into_debug(records: DataFrame, key: Serde, value: Serde, checkpoint: str, once: bool = False, interval: str = INTERVAL) -> StreamingQuery:
    """Logs every record as text, on the executors."""
    return _each(topics.lines(records, key, value), lambda batch, _: batch.foreachPartition(topics.log_lines), checkpoint, once, interval)


def into_noop(records: DataFrame, checkpoint: str, once: bool = False, interval: str = INTERVAL) -> StreamingQuery:
    return _start(records.writeStream.format("noop").option("checkpointLocation", checkpoint), once, interval)


def tee(records: DataFrame, writers: list[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = False, interval: str = INTERVAL, mode: str = "append") -> StreamingQuery:
    """Every batch to several writers; ``writer(batch, batch_id)`` must be idempotent by batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if len(writers) > 1:
            batch.persist()
        for w in writers:
            w(batch, batch_id)
        if len(writers) > 1:
            batch.unpersist()

    return _each(records, each, checkpoint, once, interval, mode)


def snapshot_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a repeated batch replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def topic_writer(store: topics.TopicStore, topic: str, key: Serde, value: Serde) -> Callable[[DataFrame, int], None]:
    """For ``tee``: the records of a batch in wire form, in a folder of their own."""
    return lambda batch, batch_id: store.replace_batch(topics.encoded(batch, key, value), topic, batch_id)


def into_topic_with(records: DataFrame, store: topics.TopicStore, topic: str, serdes: Callable[[int], tuple[Serde, Serde]], checkpoint: str, once: bool = False, interval: str = INTERVAL) -> StreamingQuery:
    """As ``into_topic``, with the serdes chosen anew for each batch: ``serdes(batch_id)`` gives key's and value's."""
    return _each(records, lambda batch, batch_id: topic_writer(store, topic, *serdes(batch_id))(batch, batch_id), checkpoint, once, interval)


def into_bench(records: DataFrame, store: topics.TopicStore, topic: str, key: Serde, value: Serde, progress: Callable[[int, int], None], checkpoint: str, once: bool = False, interval: str = INTERVAL) -> StreamingQuery:
    """A topic sink that reports: ``progress(partition, offset)`` with the last offset of each partition a batch wrote."""

    def report(batch: DataFrame, _: int) -> None:
        for r in batch.groupBy("partition").agg(F.max("offset").alias("offset")).collect():
            progress(r.partition, r.offset)

    return tee(records, [topic_writer(store, topic, key, value), report], checkpoint, once, interval)


class Bench:
    """Counts records on their way and gives records a second."""

    def __init__(self):
        self.started, self.rows, self.at = time.monotonic(), 0, {}

    def rate(self) -> float:
        return self.rows / max(time.monotonic() - self.started, 1e-9)

    def progress(self, partition: int, offset: int) -> None:
        """For ``into_bench``: the records up to an offset count as written."""
        self.at[partition] = max(offset, self.at.get(partition, -1))
        self.rows = sum(o + 1 for o in self.at.values())

    def into_noop(self, records: DataFrame) -> float:
        from pyspark.sql import Observation

        seen = Observation()
        records.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        self.rows += int(seen.get["rows"])
        return self.rate()
