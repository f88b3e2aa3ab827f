"""Stateful processors: the streaming forms of tables, folds and the joins with tables.

Values are text (the wire form); times are event times.  Rows of a batch are
handled as whole frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state variable that holds a table's latest values; ``streaming.views`` reads it.
LATEST = "latest"


def _frame(rows) -> pd.DataFrame | None:
    parts = [r for r in rows if len(r)]
    return pd.concat(parts, ignore_index=True) if parts else None


class LatestValue(StatefulProcessor):
    """Upserts: emits a key's newest value of the batch if it is newer than the state's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(LATEST, "offset long, partition int, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _frame(rows)
        if pdf is None:
            return
        newest = pdf.loc[pdf.sort_values(["offset", "partition"], kind="stable").index[-1]]
        at = (int(newest["offset"]), int(newest["partition"]))
        if self.state.exists():
            seen = self.state.get()
            if at <= (seen[0], seen[1]):
                return
        self.state.update((*at, newest["value"]))
        yield pd.DataFrame({"key": [key[0]], "partition": [at[1]], "offset": [at[0]], "value": [newest["value"]]})

    def close(self) -> None:
        pass


def _rows(records: DataFrame) -> DataFrame:
    return records.selectExpr("cast(key as string) key", "offset", "partition", "cast(value as string) value")


def latest_stream(records: DataFrame) -> DataFrame:
    """The upserts of a table of text values, in update mode: key, partition, offset, value."""
    return _rows(records).groupBy("key").transformWithStateInPandas(LatestValue(), "key string, partition int, offset long, value string", "Update", "None")


class Fold(StatefulProcessor):
    """A fold in order of arrival within each batch; emits the key's new value."""

    def __init__(self, start: str, step: Callable[[str, str], str]):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _frame(rows)
        if pdf is None:
            return
        value = self.state.get()[0] if self.state.exists() else self.start
        for v in pdf.sort_values(["offset", "partition"], kind="stable")["value"]:
            value = self.step(value, v)
        self.state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "value": [value]})

    def close(self) -> None:
        pass


def fold_stream(records: DataFrame, start: str, step: Callable[[str, str], str]) -> DataFrame:
    """key, value: the running fold of text values, in update mode.  The state is one value a key."""
    return _rows(records).groupBy("key").transformWithStateInPandas(Fold(start, step), "key string, value string", "Update", "None")


def _both(left: DataFrame, table: DataFrame) -> DataFrame:
    """Records of both sides as rows (key, side, ts, offset, partition, value); side 0 is the table."""
    part = "cast(key as string) key", "coalesce(timestamp, timestamp_seconds(0)) ts", "offset", "partition", "cast(value as string) value"
    rows = [d.selectExpr(*part, f"{k} side") for k, d in ((0, table), (1, left))]
    return rows[0].unionByName(rows[1])


class LatestJoin(StatefulProcessor):
    """Left records with the newest table value at hand: a batch's table rows come before its left rows."""

    def __init__(self, how: str):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(LATEST, "offset long, partition int, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _frame(rows)
        if pdf is None:
            return
        own, left = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        seen = self.state.get() if self.state.exists() else None
        if len(own):
            newest = own.loc[own.sort_values(["offset", "partition"], kind="stable").index[-1]]
            at = (int(newest["offset"]), int(newest["partition"]))
            if seen is None or at > (seen[0], seen[1]):
                seen = (*at, newest["value"])
                self.state.update(seen)
        if len(left) and (seen is not None or self.how == "left"):
            out = left.sort_values(["offset", "partition"], kind="stable")
            yield pd.DataFrame({"key": key[0], "partition": out["partition"].to_numpy(np.int32), "offset": out["offset"].to_numpy(np.int64), "left": out["value"].to_numpy(), "right": seen[2] if seen else None})

    def close(self) -> None:
        pass


def latest_join_stream(left: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Stream with streaming table: key, partition, offset, left, right (text); ``how`` is inner or left."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    return _both(left, table).groupBy("key").transformWithStateInPandas(LatestJoin(how), "key string, partition int, offset long, left string, right string", "Append", "None")


class GatedJoin(StatefulProcessor):
    """Left records wait until the tables' time has passed theirs, then read the version as of it.

    Input rows have side 0 (table) or 1 (left).  Rows of both sides set a timer,
    so that versions that no waiting or future left record can need are dropped
    when time passes, also for keys that only the table has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", "ts long, offset long, value string")
        self.waiting = handle.getListState("waiting", "ts long, offset long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _frame(rows)
        if pdf is None:
            return iter(())
        ms = pd.to_datetime(pdf["ts"], utc=True).astype("datetime64[ms, UTC]").astype("int64").to_numpy()
        for side, state in ((0, self.versions), (1, self.waiting)):
            own = (pdf["side"] == side).to_numpy()
            if own.any():
                state.appendList([(int(t), int(o), v) for t, o, v in zip(ms[own], pdf["offset"][own], pdf["value"][own])])
        for t in np.unique(ms):
            self.handle.registerTimer(int(t) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        versions = sorted(self.versions.get()) if self.versions.exists() else []
        left = sorted(self.waiting.get()) if self.waiting.exists() else []
        times = np.array([v[0] for v in versions], np.int64)
        due, later = [x for x in left if x[0] < now], [x for x in left if x[0] >= now]
        at = np.searchsorted(times, [x[0] for x in due], "right") - 1
        out = [(key[0], o, v, versions[k][2]) for (_, o, v), k in zip(due, at.tolist()) if k >= 0]
        # the last version before now may still be asked for
        keep = versions[max(int(np.searchsorted(times, now, "left")) - 1, 0) :]
        if len(keep) < len(versions):
            self.versions.put(keep) if keep else self.versions.clear()
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        return iter([pd.DataFrame(out, columns=["key", "offset", "left", "right"])] if out else [])

    def close(self) -> None:
        pass


def gated_join_stream(both: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """``both`` has key, side, ts, offset, value (text).  The last left records come out when
    the watermark passes them; end a bounded run with a record of a later time."""
    timed = both.withWatermark("ts", lateness)
    return timed.groupBy("key").transformWithStateInPandas(GatedJoin(), "key string, offset long, left string, right string", "Append", "EventTime")


def gated_join(left: DataFrame, table: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """The gated join of two streams of records: key, offset, left, right (text)."""
    return gated_join_stream(_both(left, table).select("key", "side", "ts", "offset", "value"), lateness)
