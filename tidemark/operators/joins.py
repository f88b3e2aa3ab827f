"""Joins of a stream of records with a table.

The output record is the left one with its value replaced.  Both sides are
shuffled by key where they have to be, so a re-keyed stream joins as it should;
Spark picks the strategy and splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import envelope

Combiner = Callable[[Column, Column], Column]


def pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("_1"), right.alias("_2"))


def _right(table: DataFrame) -> DataFrame:
    return table.select(F.col("key").alias("_right_key"), F.col("value").alias("_right_value"))


def latest(left: DataFrame, table: DataFrame, combine: Combiner = pair, how: str = "inner") -> DataFrame:
    """Each left record with the table's value of its key; ``how`` is inner or left."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    joined = left.join(_right(table), F.col("key") == F.col("_right_key"), how)
    return joined.withColumn("value", combine(F.col("value"), F.col("_right_value"))).select(*left.columns)


def full(left: DataFrame, table: DataFrame) -> DataFrame:
    """(key, left, right) of both sides; the absent side is null."""
    sides = left.select(F.col("key").alias("_left_key"), F.col("value").alias("left"))
    joined = sides.join(_right(table), F.col("_left_key") == F.col("_right_key"), "full")
    return joined.select(F.coalesce("_left_key", "_right_key").alias("key"), "left", F.col("_right_value").alias("right"))


def by(left: DataFrame, table: DataFrame, key_of: Callable[[Column], Column], combine: Combiner = pair, how: str = "inner") -> DataFrame:
    """As ``latest``, with the table's key taken from the left value."""
    joined = left.join(_right(table), key_of(F.col("value")) == F.col("_right_key"), how)
    return joined.withColumn("value", combine(F.col("value"), F.col("_right_value"))).select(*left.columns)


def as_of(left: DataFrame, versions: DataFrame, combine: Combiner = pair, how: str = "inner", span: str | None = None) -> DataFrame:
    """Each left record with the key's version of the latest time not after its own.

    Versions of equal time follow arrival.  One shuffle by key of both sides
    together and a running value; no pairs are formed.  A key's records are
    sorted in one task unless ``span`` (an interval) cuts its time line: then
    each span is a task's work, and the last version before it is carried over.
    """
    order = [envelope.event_time(), F.col("_side"), F.col("offset"), F.col("partition")]
    both = versions.select(*envelope.COLUMNS[:7], F.lit(None).cast(left.schema["value"].dataType).alias("value"), F.struct("value").alias("_seen"), F.lit(0).alias("_side")).unionByName(
        left.select(*envelope.COLUMNS, F.lit(None).cast(versions.select(F.struct("value").alias("s")).schema["s"].dataType).alias("_seen"), F.lit(1).alias("_side"))
    )
    cut = ["key"]
    if span:
        cut = ["key", "_span"]
        both = both.withColumn("_span", F.window(envelope.event_time(), span)["start"])
        # a row for each key and span: what the next spans inherit
        newest = both.groupBy("key", "_span").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_seen")), F.when(F.col("_side") == 0, F.struct(*order))).alias("_seen"))
        before = W.partitionBy("key").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
        carried = newest.select(*cut, F.last("_seen", ignorenulls=True).over(before).alias("_carried"))
        carried = carried.where(F.col("_carried").isNotNull()).withColumnsRenamed({c: f"{c}_of" for c in cut})
    running = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_seen", F.last("_seen", ignorenulls=True).over(running)).where("_side = 1")
    if span:
        same = F.col("key").eqNullSafe(F.col("key_of")) & (F.col("_span") == F.col("_span_of"))
        both = both.join(carried, same, "left").withColumn("_seen", F.coalesce("_seen", "_carried"))
    if how == "inner":
        both = both.where(F.col("_seen").isNotNull())
    return both.withColumn("value", combine(F.col("value"), F.col("_seen.value"))).select(*envelope.COLUMNS)


def interval(left: DataFrame, right: DataFrame, before: str, after: str, lateness: str = "0 seconds", combine: Combiner = pair) -> DataFrame:
    """Stream with stream: equal keys, right time in [left time - before, left time + after].

    Batches meet by key and time bucket, two buckets for a left record, so a hot
    key is many groups and far pairs are never formed.  Streams need the bounds
    on time themselves, for Spark to drop state.
    """
    r = right.select(F.col("key").alias("_right_key"), F.col("value").alias("_right_value"), F.col("timestamp").alias("_right_time"))
    if left.isStreaming or right.isStreaming:
        left, r = left.withWatermark("timestamp", lateness), r.withWatermark("_right_time", lateness)
    near = (F.col("_right_time") >= F.col("timestamp") - F.expr(f"INTERVAL {before}")) & (F.col("_right_time") <= F.col("timestamp") + F.expr(f"INTERVAL {after}"))
    if left.isStreaming or right.isStreaming:
        joined = left.join(r, (F.col("key") == F.col("_right_key")) & near)
    else:
        # as wide as the whole interval, which so reaches into two buckets at most
        first, last = (F.unix_micros(F.col("timestamp") + F.expr(f"{sign} INTERVAL {length}")) for sign, length in (("-", before), ("", after)))
        ends = left.sparkSession.range(1).select(*(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {x}")).alias(n) for n, x in (("a", before), ("b", after)))).first()
        width = F.lit(max(int(ends.a + ends.b), 1))
        bucket = lambda t: F.floor(t / width)
        left = left.withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
        r = r.withColumn("_right_bucket", bucket(F.unix_micros("_right_time")))
        joined = left.join(r, (F.col("key") == F.col("_right_key")) & (F.col("_bucket") == F.col("_right_bucket")) & near)
    return joined.withColumn("value", combine(F.col("value"), F.col("_right_value"))).select(*envelope.COLUMNS)
