"""Streams give what batches give, over several files and across a restart."""

import datetime as dt
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import envelope, serde
from tidemark.operators.stream import Stream
from tidemark.operators.table import Table
from tidemark.plans import errors
from tidemark.plans.app import App, Config
from tidemark.sources import topics
from tidemark.sources.imports import Channel, Import
from tidemark.sources.topics import TopicAlreadyRegistered, TopicNotFound, TopicStore
from tidemark.streaming import changelog, processors, sinks

import pytest

TEXT = serde.String()


def wire(spark, rows):
    df = spark.createDataFrame([(k, v, o, dt.datetime.fromtimestamp(s, dt.timezone.utc)) for k, v, o, s in rows], "k string, v string, o long, ts timestamp")
    return envelope.to_envelope(df, "t", F.col("k"), F.col("v"), F.col("o"), F.col("ts")).coalesce(1)


ROWS = [(f"k{i % 3}", f"v{i}", i, 10 * i) for i in range(12)]


@pytest.fixture
def store(spark, tmp_path):
    s = TopicStore(spark, f"file://{tmp_path}/topics")
    for part in range(4):
        s.append(wire(spark, ROWS[3 * part : 3 * part + 3]), "in")
    return s


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_topic_to_topic_and_restart(spark, store, tmp_path):
    def once():
        stream = Stream(store.read_stream("in", 2)).filter(lambda k, v: k != "k0").map_value(F.upper)
        finish(sinks.into_topic(stream.df, store, "out", TEXT, TEXT, f"file://{tmp_path}/cp", once=True))

    want = lambda n: sorted((v.upper(), o) for k, v, o, _ in ROWS[:n] + ROWS2 if k != "k0")
    ROWS2 = []
    once()
    got = lambda: sorted((r.value, r.offset) for r in store.read("out").collect())
    assert got() == want(12)
    ROWS2 = [("k1", "late", 12, 500)]
    store.append(wire(spark, ROWS2), "in")
    once()
    assert got() == want(12)


def test_stream_static_join(spark, store, tmp_path):
    table = Table(wire(spark, [("k1", "T", 1, 1)]))
    stream = Stream(store.read_stream("in", 1)).join(table, lambda a, b: F.concat(a, b))
    finish(sinks.into_topic(stream.df, store, "joined", TEXT, TEXT, f"file://{tmp_path}/cj", once=True))
    assert sorted(r.value for r in store.read("joined").collect()) == sorted(v + "T" for k, v, _, _ in ROWS if k == "k1")


def test_latest_stream_equals_batch(spark, store, tmp_path):
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.key] = (r.offset, r.value)

    q = processors.latest_stream(store.read_stream("in", 1)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/cl").trigger(availableNow=True).start()
    finish(q)
    assert seen == {r.key: (r.offset, r.value) for r in Table(store.read("in")).df.collect()}


def test_gated_join_waits_for_the_table(spark, tmp_path):
    t = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    path = f"file://{tmp_path}/both"
    files = [[("a", 1, t(20), 1, "left")], [("a", 0, t(10), 1, "v10")], [("a", 0, t(30), 2, "v30")], [("a", 1, t(40), 2, "left2")], [("z", 0, t(1000), 9, "end")], [("z", 0, t(1001), 10, "end")]]
    schema = "key string, side int, ts timestamp, offset long, value string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    both = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = processors.gated_join_stream(both, "200 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("gated").option("checkpointLocation", f"file://{tmp_path}/cg").trigger(availableNow=True).start()
    finish(q)
    assert sorted((r.offset, r.left, r.right) for r in spark.table("gated").collect()) == [(1, "left", "v10"), (2, "left2", "v30")]


def test_tee_and_bench(spark, store, tmp_path):
    finish(sinks.tee(store.read_stream("in"), [sinks.snapshot_writer(f"file://{tmp_path}/a"), sinks.snapshot_writer(f"file://{tmp_path}/b")], f"file://{tmp_path}/ct", once=True))
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == spark.read.parquet(f"file://{tmp_path}/b").count() == 12
    bench = sinks.Bench()
    assert bench.into_noop(store.read("in")) > 0 and bench.rows == 12


def test_app_rules(spark, store, tmp_path):
    config = Config().set("application.id", "app").set("state.dir", str(tmp_path)).set("group.id", "mine")
    app = App(spark, config, store)
    assert app.config.get("group.id") == "app" and app.config.checkpoint("q").endswith("/app/q")
    app.stream("in", TEXT, TEXT)
    with pytest.raises(TopicAlreadyRegistered):
        app.stream("in", TEXT, TEXT)
    with pytest.raises(TopicNotFound):
        app.stream("absent", TEXT, TEXT)
    with pytest.raises(ValueError, match="state.dir"):
        Config().set("application.id", "x").build()


def test_app_runs_queries(spark, store, tmp_path):
    config = Config().set("application.id", "run").set("state.dir", f"file://{tmp_path}/state")
    app = App(spark, config, store)
    stream = app.stream("in", TEXT, TEXT, streaming=True)
    app.add(lambda a: sinks.into_topic(stream.df, store, "copy", TEXT, TEXT, a.config.checkpoint("copy"), once=True))
    app.run(120)
    assert store.read("copy").count() == 12


def test_debug_sink(spark, store):
    lines = Stream(store.read("in")).filter(lambda k, v: v == "v3").into_debug(TEXT, TEXT, rows=5)
    assert lines == ["k0: v3"]


def drain(df, mode, tmp_path, name):
    """All rows that a stream puts out."""
    out = []
    finish(sinks.tee(df, [lambda batch, _: out.extend(map(tuple, batch.collect()))], f"file://{tmp_path}/{name}", once=True, mode=mode))
    return out


def test_streaming_table_join_view_changelog_and_restart(spark, store, tmp_path):
    config = Config().set("application.id", "tables").set("state.dir", f"file://{tmp_path}/state")

    def once():
        app = App(spark, config, store)
        handle = app.streaming_table("in", "last", TEXT, TEXT, once=True)
        app.run(120)
        return app, handle

    app, handle = once()
    want = {r.key: (r.offset, r.value) for r in Table(store.read("in")).df.collect()}
    view = {r.key: (r.offset, r.value) for r in handle.view.all().collect()}
    assert view == want and [r.value for r in handle.view.get("k1").collect()] == [want["k1"][1]]
    assert sum(handle.view.partition(p).count() for p in handle.view.partitions()) == 3
    assert handle.view.table().df.count() == 3
    # the changelog gives the table again; after a restart it has only what is new
    log = handle.changelog()
    first = changelog.rebuild(store, log)
    assert {r.key: (r.offset, r.value) for r in first.df.collect()} == want
    at = spark.createDataFrame([tuple(r) for r in first.checkpoint().collect()], "partition int, offset long")
    assert changelog.rebuilt(store, log, at)
    first = Table(store.read(log).where("offset < 12"))
    base = Table(store.read(log).where("offset < 5"))
    store.append(wire(spark, [("k1", "late", 12, 500), ("k9", "new", 13, 500)]), "in")
    _, handle = once()
    assert not changelog.rebuilt(store, log, at)
    again = changelog.rebuild(store, log, base=first)
    assert {r.key: r.value for r in again.df.collect()} == {k: v for k, (_, v) in want.items()} | {"k1": "late", "k9": "new"} == {r.key: r.value for r in handle.view.all().collect()}
    assert {r.key: r.value for r in changelog.rebuild(store, log, base=base).df.collect()} == {r.key: r.value for r in again.df.collect()}
    with pytest.raises(changelog.StateAhead):
        changelog.rebuilt(store, log, again.checkpoint().withColumn("offset", F.col("offset") + 1))
    # another stream joins the streaming table
    left = wire(spark, [("k1", "l1", 1, 1), ("nobody", "l2", 2, 1)])
    store.append(left, "left")
    for how, rows in (("inner", {("k1", "l1", "late")}), ("left", {("k1", "l1", "late"), ("nobody", "l2", None)})):
        got = drain(processors.latest_join_stream(store.read_stream("left"), store.read_stream("in"), how), "append", tmp_path, how)
        assert {(k, l, r) for k, _, _, l, r in got} == rows


def test_late_table_row_is_not_seen_by_earlier_left_rows(spark, store, tmp_path):
    store.append(wire(spark, [("k", "l1", 1, 1)]), "l")
    table = TopicStore(spark, f"file://{tmp_path}/other")
    table.append(wire(spark, [("x", "X", 1, 1)]), "t")
    join = lambda: processors.latest_join_stream(store.read_stream("l"), table.read_stream("t"))
    assert drain(join(), "append", tmp_path, "late") == []
    table.append(wire(spark, [("k", "K", 2, 1)]), "t")
    assert drain(join(), "append", tmp_path, "late") == []
    store.append(wire(spark, [("k", "l2", 2, 1)]), "l")
    assert [(l, r) for _, _, _, l, r in drain(join(), "append", tmp_path, "late")] == [("l2", "K")]


def test_streaming_count_reduce_and_fold(spark, store, tmp_path):
    s = Stream(store.read_stream("in", 1))
    last = lambda rows: {r[0]: r[1:] for r in rows}
    assert last(drain(s.count(), "update", tmp_path, "c")) == {f"k{i}": (4,) for i in range(3)}
    assert last(drain(s.reduce(top=F.max("offset"), least=F.min("value")), "update", tmp_path, "r")) == {f"k{i}": (9 + i, min(f"v{j}" for j in range(i, 12, 3))) for i in range(3)}
    folded = processors.fold_stream(s.df, "", lambda a, x: a + x)
    assert last(drain(folded, "update", tmp_path, "f")) == {f"k{i}": ("".join(f"v{j}" for j in range(i, 12, 3)),) for i in range(3)}


def test_gated_join_drops_versions_of_keys_without_left_rows(spark, tmp_path):
    path = f"file://{tmp_path}/gate"
    t = TopicStore(spark, path)
    for k in range(4):
        t.append(wire(spark, [("only", f"v{k}", k, 100 * k)]), "t")
        t.append(wire(spark, [("z", "end", k, 100 * k)]), "l")
    joined = processors.gated_join(t.read_stream("l", 1), t.read_stream("t", 1))
    finish(sinks.into_noop(joined, f"file://{tmp_path}/cg2", once=True))
    rows = spark.read.format("statestore").option("stateVarName", "versions").load(f"file://{tmp_path}/cg2").where("key.key = 'only'")
    assert rows.count() <= 2


@pytest.mark.parametrize("guarantee", sinks.GUARANTEES)
def test_guarantees(spark, store, tmp_path, guarantee):
    stream, checkpoint = Stream(store.read_stream("in", 2)), f"file://{tmp_path}/cp"
    for _ in range(2):
        finish(sinks.into_topic(stream.df, store, "sure", TEXT, TEXT, checkpoint, once=True, guarantee=guarantee))
    assert store.read("sure").count() == 12
    # the newest batch is taken as not done: it comes again but for AtMostOnce
    for p in (tmp_path / "cp" / "commits").glob("*1*"):
        p.unlink()
    finish(sinks.into_topic(stream.df, store, "sure", TEXT, TEXT, checkpoint, once=True, guarantee=guarantee))
    again = store.read("sure").count()
    assert again > 12 if guarantee == "AtLeastOnce" else again == 12


def test_null_keys_and_values_of_a_topic_fail(spark, store):
    for row in ((None, "v", 1, 1), ("k", None, 1, 1)):
        name = "nulls" + str(row[0])
        store.append(wire(spark, [row]), name)
        app = App(spark, Config().set("application.id", "n").set("state.dir", "/tmp/none"), store)
        with pytest.raises(Exception, match="record with a null"):
            app.stream(name, TEXT, TEXT).df.collect()


def test_debug_logs_every_record(spark, store, tmp_path):
    path = tmp_path / "lines"
    path.mkdir()

    def kept(rows):
        for r in rows:
            (path / r.line.replace(": ", "_")).write_text("")

    topics.lines(store.read("in"), TEXT, TEXT).foreachPartition(kept)
    assert len(list(path.iterdir())) == 12
    assert Stream(store.read("in")).into_debug(TEXT, TEXT) is None
    finish(sinks.into_debug(store.read_stream("in"), TEXT, TEXT, f"file://{tmp_path}/cd", once=True))


def test_bench_sink_reports_partitions(spark, store, tmp_path):
    bench = sinks.Bench()
    finish(sinks.into_bench(store.read_stream("in", 1), store, "timed", TEXT, TEXT, bench.progress, f"file://{tmp_path}/cb", once=True))
    assert bench.at == {0: 11} and bench.rows == 12 and bench.rate() > 0 and store.read("timed").count() == 12
    finish(sinks.into_topic_with(store.read_stream("in"), store, "chosen", lambda batch: (TEXT, serde.NativeBytes(T.StringType())), f"file://{tmp_path}/cs", once=True))
    assert store.read("chosen").where("value like '{%'").count() == 12


def test_imports_and_channels(spark, store, tmp_path):
    rows = [("a", "1"), ("b", "2"), ("c", "3")]
    stream = Import(spark, "outside", lambda at: rows[at:]).filter(lambda k, v: k != "b").map(lambda k, v: (F.upper(k), v)).integrate()
    finish(sinks.into_topic(stream.df, store, "brought", TEXT, TEXT, f"file://{tmp_path}/ci", once=True))
    assert sorted((r.topic, r.key, r.value, r.offset) for r in store.read("brought").collect()) == [("outside", "A", "1", 0), ("outside", "C", "3", 2)]
    channel = Channel(store, "own")
    channel.send([("x", "1")])
    Channel(store, "own").send([("y", "2")])
    finish(sinks.into_topic(channel.stream().df, store, "piped", TEXT, TEXT, f"file://{tmp_path}/cc", once=True))
    assert sorted((r.key, r.offset) for r in store.read("piped").collect()) == [("x", 0), ("y", 1)]


def test_app_settings_hooks_and_states(spark, store, tmp_path):
    config = Config().set("application.id", "set").set("state.dir", f"file://{tmp_path}/s").set("delivery.guarantee", "AtMostOnce").set("commit.interval", "1 second")
    app, seen = App(spark, config, store), []
    assert app.state() == "Created" and app.instance_id == App(spark, config, store).instance_id
    app.into_topic(app.stream("in", TEXT, TEXT, streaming=True), "out2", TEXT, TEXT, once=True).on_progress(seen.append)
    app.run(120)
    assert app.state() == "Stopped" and store.read("out2").count() == 12
    assert (tmp_path / "s/set/to-out2/begun").exists() and app.interval == "1 second"
    for _ in range(50):
        if sum(p["numInputRows"] for p in seen) == 12:
            break
        time.sleep(0.1)
    assert sum(p["numInputRows"] for p in seen) == 12 and app.stats()
    with pytest.raises(ValueError, match="isolation"):
        config.set("isolation.level", "none").build()
    read = TopicStore(spark, store.root, "read_uncommitted").read("in")
    assert read.count() == 12


def test_passing_failures_start_again_and_others_do_not(spark, store, tmp_path):
    for kind, ends in ((errors.Retryable, True), (errors.Fatal, False)):
        left = [2]

        def write(batch, _, kind=kind, left=left):
            left[0] -= 1
            if left[0] >= 0:
                raise kind("not now")

        app = App(spark, Config().set("application.id", kind.__name__).set("state.dir", f"file://{tmp_path}/r"), store)
        stream = app.stream("in", TEXT, TEXT, streaming=True)
        app.add(lambda a, write=write, stream=stream: sinks.tee(stream.df, [write], a.config.checkpoint("q"), once=True))
        if ends:
            app.run(120)
            assert left[0] < 0
        else:
            with pytest.raises(Exception, match="not now"):
                app.run(120)


def test_circuit_breaker():
    now = [0.0]
    b = errors.CircuitBreaker(2, 10, 5, lambda: now[0])
    b.failed()
    now[0] = 20
    b.failed()
    assert b.closed()
    b.failed()
    assert not b.closed()
    now[0] = 26
    assert b.closed()
