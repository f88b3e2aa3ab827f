"""Reads of live state: what a streaming table holds, without touching the query.

A view reads the state that the query has committed, from its checkpoint, so
any session that sees the folder can have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming import processors


class StateView:
    """A read-only view of the state of a streaming table; every read sees the newest commit."""

    def __init__(self, spark: SparkSession, checkpoint: str, variable: str = processors.LATEST):
        self.spark, self.checkpoint, self.variable = spark, checkpoint, variable

    def all(self) -> DataFrame:
        """key, partition, offset, value and state_partition of all keys, over all state partitions."""
        rows = self.spark.read.format("statestore").option("stateVarName", self.variable).load(self.checkpoint)
        return rows.selectExpr("key.key as key", "value.partition as partition", "value.offset as offset", "value.value as value", "partition_id as state_partition")

    def partition(self, number: int) -> DataFrame:
        """The keys of one state partition."""
        return self.all().where(f"state_partition = {int(number)}")

    def partitions(self) -> list[int]:
        """The state partitions that hold keys."""
        return sorted(r[0] for r in self.all().select("state_partition").distinct().collect())

    def get(self, *keys: str) -> DataFrame:
        df = self.all()
        return df.where(df.key.isin(*keys))

    def table(self):
        """The view as a table that batches and streams can be joined with, as it is now."""
        from pyspark.sql import functions as F

        from tidemark.functions import envelope
        from tidemark.operators.table import Table

        rows = self.all()
        return Table(envelope.to_envelope(rows, "state", F.col("key"), F.col("value"), F.col("offset"), partition=F.col("partition")))
