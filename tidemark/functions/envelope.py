"""The record that every operator works on: key and value with their origin.

``topic, partition, offset, timestamp, timestamp_type, headers, key, value``.
Order within a table is arrival order, (offset, partition), never time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("topic", "partition", "offset", "timestamp", "timestamp_type", "headers", "key", "value")
HEADERS = T.MapType(T.StringType(), T.ArrayType(T.BinaryType()))
#: The kinds of time a record can carry.
TIMESTAMP_TYPES = ("NotAvailable", "CreateTime", "IngestionTime", "ConsumptionTime")


def schema(key: T.DataType, value: T.DataType) -> T.StructType:
    kinds = (T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.StringType(), HEADERS, key, value)
    return T.StructType([T.StructField(n, k) for n, k in zip(COLUMNS, kinds)])


def to_envelope(df: DataFrame, topic: str, key: Column, value: Column, offset: Column, timestamp: Column | None = None, partition: Column | int = 0, timestamp_type: str = "CreateTime") -> DataFrame:
    """Rows as records; without a timestamp they are NotAvailable."""
    if timestamp_type not in TIMESTAMP_TYPES:
        raise ValueError(f"unknown timestamp type {timestamp_type!r}")
    part = F.lit(partition) if isinstance(partition, int) else partition
    return df.select(
        F.lit(topic).alias("topic"),
        part.cast("int").alias("partition"),
        offset.cast("long").alias("offset"),
        (F.lit(None) if timestamp is None else timestamp).cast("timestamp").alias("timestamp"),
        F.lit("NotAvailable" if timestamp is None else timestamp_type).alias("timestamp_type"),
        F.create_map().cast(HEADERS).alias("headers"),
        key.alias("key"),
        value.alias("value"),
    )


def event_time(column: Column | str = "timestamp") -> Column:
    """The time that comparisons use: a record without one counts as the epoch."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.timestamp_seconds(F.lit(0)))


def arrival() -> Column:
    """Sorts as the records of a table arrived."""
    return F.struct("offset", "partition")


def header_set(headers: Column, name: str, value: Column) -> Column:
    """Appends a value to a header, which may have several."""
    added = F.create_map(F.lit(name), F.array(value.cast("binary")))
    empty = F.array().cast("array<binary>")
    return F.map_zip_with(headers, added, lambda _, a, b: F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def header_remove(headers: Column, name: str) -> Column:
    """Drops all values of a header."""
    return F.map_filter(headers, lambda k, _: k != name)


def header_first(headers: Column, name: str) -> Column:
    return F.try_element_at(F.try_element_at(headers, F.lit(name)), F.lit(1))


def require_keys(df: DataFrame) -> DataFrame:
    """Fails the query on a null key or value, which the data model does not have."""
    for name in ("key", "value"):
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"record with a null {name}")).cast(df.schema[name].dataType)).otherwise(F.col(name)))
    return df
