"""Semantics of tables, joins, headers and folds on tiny inputs."""

import asyncio
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import envelope, serde
from tidemark.operators import aggregates, joins
from tidemark.operators.stream import Stream
from tidemark.operators.table import Table


def records(spark, rows, topic="t"):
    """rows: (key, value, offset, seconds or None)"""
    df = spark.createDataFrame([(k, v, o, None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc)) for k, v, o, s in rows], "k string, v string, o long, ts timestamp")
    return envelope.to_envelope(df, topic, F.col("k"), F.col("v"), F.col("o"), F.col("ts"))


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_last_offset_wins_not_last_time(spark):
    t = Table(records(spark, [("a", "new", 6, 50), ("a", "old", 5, 100)]))
    assert values(t.df, "key", "value", "offset") == [("a", "new", 6)]
    assert t.store_time().first().store_time == dt.datetime.fromtimestamp(100)


def test_inner_join_drops_unmatched_and_keeps_the_left_record(spark):
    left = records(spark, [("liam", "x", 1, 10), ("nobody", "y", 2, 10)], "left")
    table = Table(records(spark, [("liam", "grant", 9, 99), ("debbie", "grant", 8, 99)]))
    out = Stream(left).join(table, lambda a, b: F.concat(a, b)).df
    assert values(out, "topic", "key", "offset", "value") == [("left", "liam", 1, "xgrant")]


def test_left_and_full_join(spark):
    left = records(spark, [("a", "x", 1, 1), ("b", "y", 2, 1)])
    table = Table(records(spark, [("a", "A", 1, 1), ("c", "C", 2, 1)]))
    kept = Stream(left).left_join(table).df.select("key", F.col("value._2").alias("r"))
    assert sorted(kept.collect()) == sorted([("a", "A"), ("b", None)])
    both = Stream(left).full_join(table)
    assert {tuple(r) for r in both.collect()} == {("a", "x", "A"), ("b", "y", None), ("c", None, "C")}


def test_as_of_differs_from_latest(spark):
    table = records(spark, [("a", "v10", 1, 10), ("a", "v30", 2, 30)])
    left = records(spark, [("a", "l20", 1, 20), ("a", "l10", 2, 10), ("a", "l5", 3, 5)])
    latest = Stream(left).join(Table(table)).df
    assert {r.value._2 for r in latest.collect()} == {"v30"}
    as_of = joins.as_of(left, table).select(F.col("value._1").alias("l"), F.col("value._2").alias("r"))
    assert sorted(map(tuple, as_of.collect())) == [("l10", "v10"), ("l20", "v10")]


def test_record_without_time_counts_as_epoch(spark):
    table = records(spark, [("a", "v", 1, None)])
    left = records(spark, [("a", "l", 1, None)])
    assert joins.as_of(left, table).count() == 1


def test_rekeyed_stream_joins(spark):
    left = records(spark, [("other", "a", 1, 1)])
    out = Stream(left).map_key_value(lambda k, v: (v, v)).join(Table(records(spark, [("a", "A", 1, 1)])))
    row = out.df.first()
    assert (row.key, row.partition, row.offset, row.value._2) == ("a", 0, 1, "A")


def test_headers_are_a_multimap(spark):
    h = F.col("headers")
    two = records(spark, [("a", "x", 1, 1)]).withColumn("headers", envelope.header_set(envelope.header_set(h, "n", F.lit("1")), "n", F.lit("2")))
    assert [bytes(b) for b in two.first().headers["n"]] == [b"1", b"2"]
    assert two.select(envelope.header_remove(h, "n").alias("h")).first().h == {}


def test_null_keys_fail(spark):
    with pytest.raises(Exception, match="null key"):
        envelope.require_keys(records(spark, [(None, "x", 1, 1)])).collect()


def test_writes_return_new_tables(spark):
    t = Table(records(spark, [("a", "1", 1, 1), ("b", "2", 2, 1)]))
    more = t.put_range(records(spark, [("a", "3", 3, 1)]))
    assert values(more.df, "key", "value") == [("a", "3"), ("b", "2")]
    assert values(more.delete(more.df.where("key = 'a'").select("key")).df, "key") == [("b",)]
    assert more.clear().df.count() == 0
    assert values(t.get("a"), "value") == [("1",)]
    assert [r.version for r in more.changelog().where("key = 'a'").orderBy("offset").collect()] == [1, 2]


def test_fold_follows_arrival(spark):
    df = records(spark, [("a", "z", 2, 1), ("a", "y", 1, 9), ("b", "x", 3, 1)])
    out = aggregates.fold(df, F.lit(""), lambda a, x: F.concat(a, x))
    assert values(out, "key", "value") == [("a", "yz"), ("b", "x")]


def test_process_with_absent_state(spark):
    s = Stream(records(spark, [("a", "x", 1, 1), ("b", "y", 2, 1)]))
    t = Table(records(spark, [("a", "A", 1, 1)]))
    out = s.process(lambda v, st: F.concat(v, F.coalesce(st, F.lit("-"))), t)
    assert values(out.df, "value") == [("xA",), ("y-",)]


def test_empty_inputs(spark):
    empty = records(spark, [])
    assert Stream(empty).join(Table(empty)).df.count() == 0
    assert aggregates.count(empty).count() == 0
    assert joins.as_of(empty, empty).count() == 0


def test_a_put_wins_whatever_its_offset(spark):
    t = Table(records(spark, [("a", "first", 9, 9)]))
    again = t.put(records(spark, [("a", "second", 3, 3)])).put(records(spark, [("b", "x", 1, 1)]))
    assert values(again.df, "key", "value") == [("a", "second"), ("b", "x")]
    assert values(again.put(records(spark, [("a", "third", 1, 1)])).get("a"), "value") == [("third",)]
    assert [r.value for r in again.changelog().where("key = 'a'").orderBy("version").collect()] == ["first", "second"]


def test_latest_reads_only_what_is_used(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    records(spark, [("a", "x", 1, 1)]).write.parquet(path)
    plan = Table(spark.read.parquet(path)).df.select("key", "value")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema")[1]
    assert "headers" not in schema and "timestamp" not in schema and "value" in schema


@pytest.mark.parametrize("span", ["7 seconds", "100 days"])
def test_spans_give_the_same_as_of_join(spark, span):
    rng = random.Random(4)
    rows = [(rng.choice("abc") if i % 9 else None, f"v{i}", i, rng.choice([None, *range(0, 60, 3)])) for i in range(150)]
    left, right = records(spark, rows[:80]), records(spark, rows[80:])
    for how in ("inner", "left"):
        one, other = (values(joins.as_of(left, right, how=how, span=s).select("key", F.col("value._1").alias("l"), F.coalesce("value._2", F.lit("")).alias("r")).where("key IS NOT NULL"), "key", "l", "r") for s in (None, span))
        assert one == other and one
    hot = {r for r in other}
    for key, value, _, time in rows[:80]:
        if key is None:
            continue
        seen = [(t or 0, o, v) for k, v, o, t in rows[80:] if k == key and (t or 0) <= (time or 0)]
        assert (key, value, max(seen)[2] if seen else "") in hot


def test_interval_join_by_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"v{i}", i, rng.randrange(500)) for i in range(160)]
    got = values(joins.interval(records(spark, rows[:80]), records(spark, rows[80:]), "30 seconds", "0 seconds").select(F.col("value._1").alias("l"), F.col("value._2").alias("r")), "l", "r")
    assert got == sorted((v, w) for k, v, _, t in rows[:80] for q, w, _, u in rows[80:] if k == q and t - 30 <= u <= t)


def test_async_map_keeps_order_and_runs_side_by_side(spark):
    async def slow(record):
        await asyncio.sleep(0.2)
        return {"offset": record["offset"], "n": record["value"] + "!"}

    df = records(spark, [("a", f"v{i}", i, 1) for i in range(40)]).select("offset", "value").coalesce(1)
    began = time.monotonic()
    assert values(Stream(df).map_async(slow, "offset long, n string", at_once=40).df, "offset", "n") == [(i, f"v{i}!") for i in range(40)]
    assert time.monotonic() - began < 6


def test_values_are_parsed_once(spark):
    s = serde.Json(T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())]), {"name": ("Name2",)})
    df = Stream(records(spark, [("a", '{"k": 1, "Name2": "x"}', 1, 1)])).decode_value(s).map_value(s.encode).df
    assert df.first().value == '{"k":1,"name":"x"}'
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    with pytest.raises(Exception, match="missing field k"):
        Stream(records(spark, [("a", "{}", 1, 1)])).decode_value(s).df.collect()


def test_native_bytes(spark):
    kind = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
    s = serde.NativeBytes(kind)
    rows = [({"a": [1.5, None]},), (None,), ({},)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("v", kind)]))
    assert [r.v for r in df.select(s.decode(s.encode(F.col("v"))).alias("v")).collect()] == [r[0] for r in rows]
