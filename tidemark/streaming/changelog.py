"""Changelog topics: a table's upserts, kept so that the table can be rebuilt.

A changelog record keeps the key, the value, the offset and the partition
number of the source record.  A micro-batch is a folder of its own, so one that
is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.operators.table import Table
from tidemark.sources import topics


class StateAhead(RuntimeError):
    """A store has seen more than its changelog holds, so the two do not belong together."""


def name_of(application: str, table: str) -> str:
    return f"{application}-{table}-changelog"


def writer(store: topics.TopicStore, topic: str) -> Callable[[DataFrame, int], None]:
    """For ``sinks.tee``: appends upserts (key, partition, offset, value) to a changelog topic."""

    def write(batch: DataFrame, batch_id: int) -> None:
        records = batch
        if "headers" not in batch.columns:
            records = envelope.to_envelope(batch, topic, F.col("key"), F.col("value"), F.col("offset"), partition=F.col("partition"))
        store.replace_batch(records, topic, batch_id)

    return write


def ends(store: topics.TopicStore, topic: str) -> DataFrame:
    """partition, end: the offset after the last one, of each partition of a changelog."""
    if not store.exists(topic):
        return store.spark.createDataFrame([], "partition int, end long")
    return store.read(topic).groupBy("partition").agg((F.max("offset") + 1).alias("end"))


def behind(store: topics.TopicStore, topic: str, checkpoint: DataFrame) -> DataFrame:
    """partition, start, end: what a store with this checkpoint (partition, offset) has yet to read.

    A store that is ahead of the changelog raises StateAhead.
    """
    both = ends(store, topic).join(checkpoint.select("partition", F.col("offset").alias("start")), "partition", "full")
    both = both.select("partition", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))
    ahead = both.where("start > end").limit(1).collect()
    if ahead:
        raise StateAhead(f"partition {ahead[0].partition}: the store is at {ahead[0].start}, the changelog ends at {ahead[0].end}")
    return both


def rebuilt(store: topics.TopicStore, topic: str, checkpoint: DataFrame) -> bool:
    """Whether a store with this checkpoint has read the whole changelog."""
    return behind(store, topic, checkpoint).where("start < end").limit(1).count() == 0


def rebuild(store: topics.TopicStore, topic: str, name: str = "table", base: Table | None = None) -> Table:
    """The table of a changelog.  With ``base``, only what follows its checkpoint is read and put on it."""
    if base is None:
        return Table(store.read(topic), name)
    missing = behind(store, topic, base.checkpoint()).where("start < end")
    log = store.read(topic)
    return base.put_range(log.join(F.broadcast(missing), "partition").where("offset >= start").select(*envelope.COLUMNS))
