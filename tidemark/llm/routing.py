"""Exchanges of numbers packed by partition, for operators that compare hashes.

A row of the exchange holds, for one task's batch and one target partition,
the arrays of all entries that go there.  That costs a few bytes an entry
instead of a Spark row for each.  Targets are ranges of the hash, so every
partition gets an even share; their number is spark.sql.shuffle.partitions,
which is to grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "part int, kind int, data binary"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The target of each hash by its upper half."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def exchange(rows: DataFrame, parts: int) -> DataFrame:
    """Rows to their partitions, those of least kind first."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("kind")


def small(values: np.ndarray, wide: bool) -> list[np.ndarray]:
    """Non-negative ints as one or two bytes each, with the larger ones apart."""
    kind = np.uint16 if wide else np.uint8
    top = np.iinfo(kind).max
    return [np.minimum(values, top).astype(kind), values[values >= top].astype(np.int64)]


def large(short: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = short.astype(np.int64)
    out[short == np.iinfo(short.dtype).max] = rest
    return out


_KINDS = [np.dtype(x) for x in ("u1", "<u2", "<u4", "<u8", "<i8", "<i4", "<f4")]


def dump(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays)] + [v for a in arrays for v in (_KINDS.index(a.dtype), len(a))], "<i8")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def load(data: bytes | memoryview) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2):
        dtype = _KINDS[kind]
        out.append(np.frombuffer(data, dtype, size, at))
        at += int(size) * dtype.itemsize
    return out


def dump_places(keys: np.ndarray, pos: np.ndarray, wide: bool) -> list[np.ndarray]:
    """(key, position) entries as runs of one key with rising positions."""
    if not len(keys):
        return [np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)]
    start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (pos[1:] < pos[:-1])])
    gap = pos.astype(np.int64).copy()
    gap[1:] -= pos[:-1]
    gap[start] = pos[start]
    return [keys[start].astype(np.int64), *small(np.diff(np.r_[start, len(keys)]), False), *small(gap, wide)]


def load_places(a: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    count = large(a[1], a[2])
    gap = large(a[3], a[4])
    total = np.cumsum(gap)
    start = np.cumsum(count) - count
    base = (total[start] - gap[start]) if len(start) else np.zeros(0, np.int64)
    return np.repeat(a[0], count), total - np.repeat(base, count)


def routed(part: np.ndarray, kind: int, columns: list[np.ndarray], pack) -> pa.RecordBatch:
    """One row for each target: pack(columns of its entries, in the order given) -> arrays."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    end = np.r_[start[1:], len(part)]
    data = [dump(pack([c[a:b] for c in columns])) for a, b in zip(start, end)]
    return pa.RecordBatch.from_arrays([pa.array(part[start], pa.int32()), pa.array(np.full(len(start), kind), pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])
