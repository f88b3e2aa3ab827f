"""The engine's operators as queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import envelope, serde
from tidemark.operators import aggregates, joins
from tidemark.operators.stream import Stream
from tidemark.operators.table import Table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, value: Column | None = None) -> Stream:
    """key = user, offset = event, time = ts; the value is a struct of the rest."""
    rows = _read(spark, sf_dir, "events")
    rest = F.struct("event_id", "event_type", "value", "props") if value is None else value
    return Stream(envelope.to_envelope(rows, "events", F.col("user_id"), rest, F.col("event_id"), F.col("ts").cast("timestamp")))


def orders(spark: SparkSession, sf_dir: str) -> Stream:
    rows = _read(spark, sf_dir, "orders")
    rest = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    return Stream(envelope.to_envelope(rows, "orders", F.col("o_custkey"), rest, F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")))


def customers(spark: SparkSession, sf_dir: str, segment: str | None = "BUILDING") -> Table:
    rows = _read(spark, sf_dir, "customer")
    if segment:
        rows = rows.where(F.col("c_mktsegment") == segment)
    return Table(envelope.to_envelope(rows, "customer", F.col("c_custkey"), F.struct("c_name", "c_nationkey", "c_mktsegment"), F.col("c_custkey")), "customer")


def _of_type(kind: str):
    return lambda k, v: v["event_type"] == kind


def _micros(column: Column) -> Column:
    return F.unix_micros(column).cast("long")


def _millis(column: Column) -> Column:
    return F.unix_millis(column).cast("long")


# sources and formats


@query("SELECT event_id AS \"offset\", user_id AS \"key\", epoch_us(ts) AS ts_us, value FROM events")
def topic_source(spark, sf_dir):
    return events(spark, sf_dir).df.select("offset", "key", _micros(F.col("timestamp")).alias("ts_us"), F.col("value.value").alias("value"))


@query("SELECT event_id, upper(event_type) AS label FROM events")
def serde_string(spark, sf_dir):
    s = serde.String()
    rows = _read(spark, sf_dir, "events")
    return rows.select("event_id", F.upper(s.decode(s.encode(F.col("event_type")).cast("binary"))).alias("label"))


@query("SELECT event_id, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS n FROM events")
def serde_i64_text(spark, sf_dir):
    s = serde.Int64Text()
    return _read(spark, sf_dir, "events").select("event_id", s.decode(s.encode(F.col("event_id")).cast("binary")).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def serde_json_decode(spark, sf_dir):
    s = serde.Json(T.StructType([T.StructField("k", T.LongType())]))
    return events(spark, sf_dir, F.col("props")).decode_value(s).df.select(F.col("offset").alias("event_id"), F.col("value.k").alias("k"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def serde_json_encode(spark, sf_dir):
    s = serde.Json(T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))
    return _read(spark, sf_dir, "nation").select("n_nationkey", s.encode(F.struct("n_nationkey", "n_name")).alias("json"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"key\" FROM events")
def serde_json_alias(spark, sf_dir):
    s = serde.Json(T.StructType([T.StructField("key", T.LongType())]), {"key": ("k", "K")})
    return _read(spark, sf_dir, "events").select("event_id", s.decode(F.col("props"))["key"].alias("key"))


@query("SELECT event_id, user_id, value FROM events")
def serde_native_bytes(spark, sf_dir):
    s = serde.NativeBytes(T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())]))
    back = _read(spark, sf_dir, "events").select("event_id", s.decode(s.encode(F.struct("user_id", "value"))).alias("v"))
    return back.select("event_id", "v.user_id", "v.value")


# projections, filters, composition


@query("SELECT event_id AS \"offset\", CAST(length(event_type) AS BIGINT) AS value FROM events")
def map_value(spark, sf_dir):
    return events(spark, sf_dir).map_value(lambda v: F.length(v["event_type"]).cast("long")).df.select("offset", "value")


@query("SELECT event_id AS \"offset\", event_type AS \"key\", value * 2 AS value, 0 AS \"partition\" FROM events")
def map_key_value(spark, sf_dir):
    return events(spark, sf_dir).map_key_value(lambda k, v: (v["event_type"], v["value"] * 2)).df.select("offset", "key", "value", "partition")


@query("SELECT event_id AS \"offset\", 'a' AS first, CAST(2 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_removed FROM events")
def map_headers(spark, sf_dir):
    set_twice = events(spark, sf_dir).map_headers(lambda h: envelope.header_set(envelope.header_set(h, "trace", F.lit("a")), "trace", F.lit("b")))
    h = F.col("headers")
    return set_twice.df.select("offset", envelope.header_first(h, "trace").cast("string").alias("first"), F.size(h["trace"]).cast("long").alias("n"), F.size(envelope.header_remove(h, "trace")).cast("long").alias("n_removed"))


@query("SELECT event_id AS \"offset\", event_type FROM events WHERE user_id = 8")
def filter_key(spark, sf_dir):
    return events(spark, sf_dir).filter(lambda k, v: k == 8).df.select("offset", F.col("value.event_type").alias("event_type"))


@query("SELECT event_id AS \"offset\", user_id AS \"key\" FROM events WHERE event_type = 'error'")
def filter_value(spark, sf_dir):
    return events(spark, sf_dir).filter(_of_type("error")).df.select("offset", "key")


@query("SELECT event_id AS \"offset\", value + 1 AS value FROM events WHERE event_type = 'click'")
def and_then(spark, sf_dir):
    clicks = lambda s: s.filter(_of_type("click")).map_value(lambda v: v["value"] + 1)
    return events(spark, sf_dir).and_then(clicks).df.select("offset", "value")


@query("SELECT o_orderkey AS \"offset\", epoch_us(o_orderdate) AS ts_us, 'CreateTime' AS timestamp_type FROM orders")
def timestamp_extract(spark, sf_dir):
    s = orders(spark, sf_dir).extract_timestamp(lambda k, v: v["o_orderdate"])
    return s.df.select("offset", _micros(F.col("timestamp")).alias("ts_us"), "timestamp_type")


@query("SELECT event_id AS \"offset\", props FROM events WHERE NOT (CAST(json_extract(props, '$.k') AS BIGINT) < 50)")
def dead_letter(spark, sf_dir):
    s = serde.Json(T.StructType([T.StructField("k", T.LongType())]), lenient=True)
    _, bad = events(spark, sf_dir).dead_letters(lambda k, v: s.decode(v["props"])["k"] < 50)
    return bad.df.select("offset", F.col("value.props").alias("props"))


@query("SELECT event_id AS \"offset\", CAST(length(event_type) AS BIGINT) AS n FROM events")
def parallel_map(spark, sf_dir):
    s = events(spark, sf_dir, F.col("event_type")).parallel(8).map_value(lambda v: F.length(v).cast("long"))
    return s.df.select("offset", F.col("value").alias("n"))


# tables and state


@query("SELECT user_id AS \"key\", max(event_id) AS \"offset\", arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def table_latest(spark, sf_dir):
    return events(spark, sf_dir, F.col("value")).into_table("latest").df.select("key", "offset", "value")


@query("SELECT user_id AS \"key\", event_id AS \"offset\", row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def table_changelog(spark, sf_dir):
    return events(spark, sf_dir).into_table("t").changelog().select("key", "offset", F.col("version").cast("long").alias("version"))


@query("SELECT user_id AS \"key\", arg_max(value, event_id) AS value FROM events WHERE user_id IN (3, 8) GROUP BY user_id")
def store_get(spark, sf_dir):
    return events(spark, sf_dir, F.col("value")).into_table("t").get(3, 8).select("key", "value")


@query("SELECT user_id AS \"key\", arg_max(value, event_id) AS value FROM events WHERE user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE value > 180) GROUP BY user_id")
def store_delete(spark, sf_dir):
    s = events(spark, sf_dir, F.col("value"))
    gone = events(spark, sf_dir).filter(lambda k, v: v["value"] > 180).df.select("key")
    return s.into_table("t").delete(gone).df.select("key", "value")


@query("SELECT user_id AS \"key\", arg_max(CASE WHEN event_type = 'purchase' THEN value + 1000 ELSE value END, CASE WHEN event_type = 'purchase' THEN event_id + 1000000000 ELSE event_id END) AS value FROM events GROUP BY user_id")
def store_put_range(spark, sf_dir):
    base = events(spark, sf_dir, F.col("value")).into_table("t")
    late = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["value"] + 1000).df
    return base.put_range(late).df.select("key", "value")


@query("SELECT user_id AS \"key\", CASE WHEN user_id = 8 THEN -1.0 ELSE arg_max(value, event_id) END AS value FROM events GROUP BY user_id")
def store_put(spark, sf_dir):
    """A put wins over all that is there, though its offset is the least."""
    base = events(spark, sf_dir, F.col("value")).into_table("t")
    one = events(spark, sf_dir, F.lit(-1.0)).filter(lambda k, v: k == 8).df.withColumn("offset", F.lit(-1).cast("long")).limit(1)
    return base.put(one).df.select("key", "value")


@query("SELECT CAST(0 AS BIGINT) AS n")
def store_clear(spark, sf_dir):
    return events(spark, sf_dir).into_table("t").clear().df.agg(F.count("*").alias("n"))


@query("SELECT 0 AS \"partition\", epoch_us(max(ts)) AS store_us FROM events")
def store_time(spark, sf_dir):
    return events(spark, sf_dir).into_table("t").store_time().select("partition", _micros(F.col("store_time")).alias("store_us"))


@query("SELECT 0 AS \"partition\", max(event_id) + 1 AS \"offset\" FROM events")
def store_checkpoint(spark, sf_dir):
    return events(spark, sf_dir).into_table("t").checkpoint()


@query("SELECT user_id AS \"key\", arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(value, event_id) > 50")
def store_view(spark, sf_dir):
    return events(spark, sf_dir, F.col("value")).into_table("t").view(F.col("value") > 50).select("key", "value")


# joins


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_latest(spark, sf_dir):
    s = orders(spark, sf_dir).join(customers(spark, sf_dir))
    return s.df.select(F.col("value._1.o_orderkey").alias("o_orderkey"), F.col("value._1.o_totalprice").alias("o_totalprice"), F.col("value._2.c_name").alias("c_name"))


@query("SELECT e.event_id AS \"offset\", e.user_id AS \"key\", e.value AS error_value, p.value AS purchase_value FROM events e JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON e.user_id = p.user_id WHERE e.event_type = 'error'")
def join_flagship(spark, sf_dir):
    """Error events with the user's latest purchase."""
    purchases = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["value"]).into_table("purchases")
    s = events(spark, sf_dir).filter(_of_type("error")).map_value(lambda v: v["value"]).join(purchases)
    return s.df.select("offset", "key", F.col("value._1").alias("error_value"), F.col("value._2").alias("purchase_value"))


@query("SELECT o_orderkey, '[{\"o_orderstatus\":\"' || o_orderstatus || '\"},{\"c_name\":\"' || c_name || '\"}]' AS json FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_tuple_json(spark, sf_dir):
    both = lambda l, r: serde.json_tuple(F.to_json(F.struct(l["o_orderstatus"].alias("o_orderstatus"))), F.to_json(F.struct(r["c_name"].alias("c_name"))))
    return orders(spark, sf_dir).join(customers(spark, sf_dir), both).df.select(F.col("offset").alias("o_orderkey"), F.col("value").alias("json"))


_AS_OF = "SELECT l.event_id AS \"offset\", l.user_id AS \"key\", l.value AS left_value, r.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"


@query(_AS_OF)
def join_gated(spark, sf_dir):
    """The event-time join: the version that a left record would wait for and see."""
    purchases = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["value"])
    left = events(spark, sf_dir).filter(_of_type("error")).map_value(lambda v: v["value"])
    return joins.as_of(left.df, purchases.df).select("offset", "key", F.col("value._1").alias("left_value"), F.col("value._2").alias("right_value"))


@query(_AS_OF)
def join_gated_spans(spark, sf_dir):
    """The same with each key's time line cut into spans, for hot keys."""
    purchases = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["value"])
    left = events(spark, sf_dir).filter(_of_type("error")).map_value(lambda v: v["value"])
    return joins.as_of(left.df, purchases.df, span="1 day").select("offset", "key", F.col("value._1").alias("left_value"), F.col("value._2").alias("right_value"))


@query(_AS_OF.replace("SELECT l.event_id AS \"offset\", l.user_id AS \"key\", l.value AS left_value, r.value AS right_value", "SELECT l.event_id AS \"offset\", r.event_id AS version_offset"))
def versioned_get(spark, sf_dir):
    purchases = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["event_id"]).into_table("p")
    left = events(spark, sf_dir).filter(_of_type("error")).map_value(lambda v: v["event_id"])
    return purchases.version_at(left.df).select("offset", F.col("value._2").alias("version_offset"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def left_join(spark, sf_dir):
    return orders(spark, sf_dir).left_join(customers(spark, sf_dir)).df.select(F.col("offset").alias("o_orderkey"), F.col("value._2.c_name").alias("c_name"))


@query("SELECT coalesce(o_custkey, c_custkey) AS \"key\", o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def full_join(spark, sf_dir):
    s = orders(spark, sf_dir).filter(lambda k, v: v["o_orderstatus"] == "F")
    return s.full_join(customers(spark, sf_dir)).select("key", F.col("left.o_orderkey").alias("o_orderkey"), F.col("right.c_name").alias("c_name"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_by(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    table = Table(envelope.to_envelope(nations, "nation", F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey")))
    left = Stream(customers(spark, sf_dir, None).records)
    return left.join_by(table, lambda v: v["c_nationkey"], lambda l, r: r).df.select(F.col("key").alias("c_custkey"), F.col("value").alias("n_name"))


@query("SELECT l.event_id AS left_id, r.event_id AS right_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts >= l.ts - INTERVAL 10 MINUTE AND r.ts <= l.ts + INTERVAL 10 MINUTE WHERE l.event_type = 'error' AND r.event_type = 'purchase'")
def interval_join(spark, sf_dir):
    left = events(spark, sf_dir).filter(_of_type("error")).map_value(lambda v: v["event_id"])
    right = events(spark, sf_dir).filter(_of_type("purchase")).map_value(lambda v: v["event_id"])
    return left.join_interval(right, "10 minutes", "10 minutes").df.select(F.col("value._1").alias("left_id"), F.col("value._2").alias("right_id"))


# aggregations, processes, windows


@query("SELECT user_id AS \"key\", count(*) AS count FROM events GROUP BY user_id")
def count(spark, sf_dir):
    return events(spark, sf_dir).count()


@query("SELECT user_id AS \"key\", max(value) AS most, min(event_id) AS first_id FROM events GROUP BY user_id")
def reduce(spark, sf_dir):
    return events(spark, sf_dir).reduce(most=F.max("value.value"), first_id=F.min("value.event_id"))


@query("SELECT user_id AS \"key\", string_agg(event_type, '>' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def fold(spark, sf_dir):
    step = lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(">"), x))
    return events(spark, sf_dir, F.col("event_type")).fold(F.lit(""), step)


@query("SELECT e.event_id AS \"offset\", e.value - p.value AS value FROM events e LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON e.user_id = p.user_id WHERE e.event_type = 'view'")
def process_one_state(spark, sf_dir):
    s = events(spark, sf_dir).filter(_of_type("view")).map_value(lambda v: v["value"])
    return s.process(lambda v, a: v - a, _latest_of(spark, sf_dir, "purchase")).df.select("offset", "value")


@query("SELECT e.event_id AS \"offset\", coalesce(p.value, 0) + coalesce(q.value, 0) AS value FROM events e LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON e.user_id = p.user_id LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id) q ON e.user_id = q.user_id WHERE e.event_type = 'view'")
def process_two_state(spark, sf_dir):
    s = events(spark, sf_dir).filter(_of_type("view")).map_value(lambda v: v["value"])
    both = lambda v, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return s.process(both, _latest_of(spark, sf_dir, "purchase"), _latest_of(spark, sf_dir, "error")).df.select("offset", "value")


def _latest_of(spark: SparkSession, sf_dir: str, kind: str) -> Table:
    return events(spark, sf_dir).filter(_of_type(kind)).map_value(lambda v: v["value"]).into_table(kind)


@query("SELECT user_id AS \"key\", epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    return aggregates.windowed(events(spark, sf_dir).df, "1 hour", n=F.count("*")).select("key", _millis(F.col("window_start")).alias("start_ms"), "n")


@query("SELECT user_id AS \"key\", start_ms, count(*) AS n FROM (SELECT user_id, epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts)) - 1800000 * s.i AS start_ms FROM events, (SELECT unnest([0, 1]) AS i) s) GROUP BY ALL")
def window_sliding(spark, sf_dir):
    return aggregates.windowed(events(spark, sf_dir).df, "1 hour", "30 minutes", n=F.count("*")).select("key", _millis(F.col("window_start")).alias("start_ms"), "n")


@query("SELECT user_id AS \"key\", epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session")
def window_session(spark, sf_dir):
    return aggregates.sessions(events(spark, sf_dir).df, "20 minutes", n=F.count("*")).select("key", _micros(F.col("window_start")).alias("start_us"), "n")


@query("SELECT event_id AS \"offset\", '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS wire FROM events")
def pass_through(spark, sf_dir):
    """Decode and encode, as the throughput benchmark does."""
    s = serde.Json(T.StructType([T.StructField("k", T.LongType())]))
    return events(spark, sf_dir, F.col("props")).decode_value(s).map_value(s.encode).df.select("offset", F.col("value").alias("wire"))
