"""Tables: the latest value of each key, by order of the writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.operators import joins

#: Number of the write that brought a record into a table; later writes win, whatever their offsets.
PUT = "_put"


def latest(records: DataFrame) -> DataFrame:
    """One record a key: the one that was written last.  Combines before the shuffle.

    Each column is an aggregate of its own, so those that are not used are
    neither read nor shuffled.
    """
    order = F.struct(PUT, "offset", "partition") if PUT in records.columns else envelope.arrival()
    kept = [c for c in envelope.COLUMNS if c != "key"]
    out = records.groupBy("key").agg(*(F.max_by(c, order).alias(c) for c in kept))
    return out.select(*envelope.COLUMNS)


def changelog(records: DataFrame) -> DataFrame:
    """Every upsert with its version number within the key, in order of the writes."""
    order = ([PUT] if PUT in records.columns else []) + ["offset", "partition"]
    return records.withColumn("version", F.row_number().over(W.partitionBy("key").orderBy(*order)))


class Table:
    """Immutable snapshots of a keyed store; writes return a new table.

    ``records`` holds all that was written, with the number of its write where
    there was more than one.
    """

    def __init__(self, records: DataFrame, name: str = "table", puts: int = 0):
        self.name, self.records, self.puts = name, records, puts
        self.df = latest(records)

    def get(self, *keys) -> DataFrame:
        """The records of these keys; the filter reaches the source."""
        return Table(self.records.where(F.col("key").isin(*keys)), self.name).df

    def put(self, record: DataFrame) -> Table:
        """An upsert: it replaces what is there, also where that has a larger offset."""
        return self.put_range(record)

    def put_range(self, records: DataFrame) -> Table:
        """Upserts, all later than what is there; among themselves by their offsets."""
        own = self.records if PUT in self.records.columns else self.records.withColumn(PUT, F.lit(0))
        new = records.select(*envelope.COLUMNS, F.lit(self.puts + 1).alias(PUT))
        return Table(own.unionByName(new), self.name, self.puts + 1)

    def delete(self, keys: DataFrame) -> Table:
        """Without the keys of a one-column DataFrame."""
        gone = keys.select(F.col(keys.columns[0]).alias("_gone"))
        return Table(self.records.join(gone, F.col("key") == F.col("_gone"), "left_anti"), self.name, self.puts)

    def clear(self) -> Table:
        return Table(self.records.where(F.lit(False)), self.name, self.puts)

    def store_time(self) -> DataFrame:
        """The latest event time ever put, of each source partition and of all."""
        return self.records.groupBy("partition").agg(F.max(envelope.event_time()).alias("store_time"))

    def checkpoint(self) -> DataFrame:
        """The next offset to read, of each source partition."""
        return self.records.groupBy("partition").agg((F.max("offset") + 1).alias("offset"))

    def version_at(self, left: DataFrame, combine: joins.Combiner = joins.pair) -> DataFrame:
        """As-of look-up for each left record."""
        return joins.as_of(left, self.records, combine)

    def changelog(self) -> DataFrame:
        return changelog(self.records).drop(PUT)

    def view(self, condition: Column) -> DataFrame:
        """A read-only view of the current values."""
        return self.df.where(condition)
