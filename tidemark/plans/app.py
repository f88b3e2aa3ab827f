"""Applications: configuration, topics, tables and the queries that run."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.serde import Serde
from tidemark.operators.stream import Stream
from tidemark.operators.table import Table
from tidemark.plans import errors
from tidemark.sources import topics
from tidemark.streaming import changelog, processors, sinks, views

#: Settings that must be there, those that are derived and so not accepted, and defaults.
REQUIRED = ("application.id", "state.dir")
DERIVED = ("group.id", "group.instance.id", "client.id")
DEFAULTS = {"isolation.level": "read_committed", "commit.interval": "250 milliseconds", "delivery.guarantee": "ExactlyOnce"}
#: The states of a query and of an application, from the least to the most advanced.
STATES = ("Stopped", "Created", "Rebuilding", "Running")


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    """Settings by name.  ``build`` drops derived ones, adds defaults and checks what is required."""

    values: dict[str, str] = field(default_factory=dict)

    def set(self, name: str, value: str) -> Config:
        self.values[name] = value
        return self

    def get(self, name: str) -> str | None:
        return self.values.get(name)

    def remove(self, name: str) -> Config:
        self.values.pop(name, None)
        return self

    def contains(self, name: str) -> bool:
        return name in self.values

    def extend(self, other: dict[str, str]) -> Config:
        self.values |= other
        return self

    def build(self) -> Config:
        own = DEFAULTS | {k: v for k, v in self.values.items() if k not in DERIVED}
        missing = [k for k in REQUIRED if not own.get(k)]
        if missing:
            raise ConfigError(f"missing settings: {', '.join(missing)}")
        if own["delivery.guarantee"] not in sinks.GUARANTEES:
            raise ConfigError(f"unknown delivery guarantee {own['delivery.guarantee']}")
        if own["isolation.level"] not in topics.ISOLATION:
            raise ConfigError(f"unknown isolation level {own['isolation.level']}")
        app = own["application.id"]
        return Config(own | {"group.id": app, "client.id": f"{app}-{uuid.uuid5(uuid.NAMESPACE_URL, app)}"})

    @property
    def application_id(self) -> str:
        return self.values["application.id"]

    def checkpoint(self, query: str) -> str:
        """A query's checkpoint, the same after a restart."""
        return f"{self.values['state.dir'].rstrip('/')}/{self.application_id}/{query}"


def start_logging(as_json: bool = False, level: int = logging.INFO) -> None:
    """Log lines of this library to stderr, plain or one JSON object each."""

    class Lines(logging.Formatter):
        def format(self, record):
            return json.dumps({"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()})

    handler = logging.StreamHandler()
    handler.setFormatter(Lines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log = logging.getLogger("tidemark")
    log.handlers = [handler]
    log.setLevel(level)


def instance_id(spark: SparkSession, config: Config) -> str:
    """The id kept in the state folder; made and kept on the first start."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(config.checkpoint("instance.json"))
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"instance.id": str(uuid.uuid4())}).encode()))
        out.close()
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])["instance.id"]


class TableHandle:
    """A streaming table that others can join, read and rebuild.

    ``records`` are the upserts it is made of, ``view`` reads its live state.
    """

    def __init__(self, app: App, name: str, records: DataFrame, query: StreamingQuery | None = None):
        self.app, self.name, self.records, self.query = app, name, records, query
        self.view = views.StateView(app.spark, app.config.checkpoint(name))

    def changelog(self) -> str:
        return changelog.name_of(self.app.config.application_id, self.name)


class Progress(StreamingQueryListener):
    """Keeps the newest progress of each query and passes all on to hooks."""

    def __init__(self, hooks: list[Callable[[dict], None]]):
        self.hooks, self.newest = hooks, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = json.loads(event.progress.json)
        self.newest[got["id"]] = got
        for hook in self.hooks:
            hook(got)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class App:
    """``stream`` and ``table`` read topics; ``run`` starts the queries given to ``add`` and waits.

    A query that fails with a Retryable or Revertable error starts again from
    its checkpoint, ``retries`` times at most and as long as the circuit breaker
    is closed; any other failure stops all queries and raises.
    """

    def __init__(self, spark: SparkSession, config: Config, store: topics.TopicStore, state_provider: str | None = None, retries: int = 3, breaker: errors.CircuitBreaker | None = None):
        self.spark, self.config = spark, config.build()
        self.store = topics.TopicStore(spark, store.root, self.config.get("isolation.level"))
        self.registry = topics.Registry()
        self.starts, self.queries, self.hooks = [], [], []
        self.retries, self.breaker = retries, breaker or errors.CircuitBreaker()
        self.progress: Progress | None = None
        self.stopped = False
        if state_provider:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_provider)

    @property
    def instance_id(self) -> str:
        return instance_id(self.spark, self.config)

    def stream(self, topic: str, key: Serde, value: Serde, streaming: bool = False) -> Stream:
        self.registry.topic(topic)
        read = self.store.read_stream(topic) if streaming else self.store.read(topic)
        return Stream(topics.decoded(read, key, value), self)

    def table(self, topic: str, name: str, key: Serde, value: Serde) -> Table:
        return self.stream(topic, key, value).into_table(name)

    def streaming_table(self, topic: str, name: str, key: Serde, value: Serde, once: bool = False) -> TableHandle:
        """A table kept by a query of its own: its state can be viewed, its upserts go to its changelog topic."""
        records = self.stream(topic, key, value, streaming=True).df
        self.registry.table(name)
        handle = TableHandle(self, name, records)
        write = changelog.writer(self.store, handle.changelog())

        def start(app: App) -> StreamingQuery:
            wire = topics.encoded(records, key, value)
            handle.query = sinks.tee(processors.latest_stream(wire), [write], app.config.checkpoint(name), once, app.interval, mode="update")
            return handle.query

        self.add(start)
        return handle

    @property
    def interval(self) -> str:
        return self.config.get("commit.interval")

    def into_topic(self, stream: Stream, topic: str, key: Serde, value: Serde, once: bool = False) -> App:
        """Adds a query to a topic, with the configured commit interval and delivery guarantee."""
        guarantee = self.config.get("delivery.guarantee")
        return self.add(lambda app: sinks.into_topic(stream.df, app.store, topic, key, value, app.config.checkpoint(f"to-{topic}"), once, app.interval, guarantee))

    def add(self, start) -> App:
        """``start(app)`` starts a streaming query and returns it."""
        self.starts.append(start)
        return self

    def on_progress(self, hook: Callable[[dict], None]) -> App:
        """``hook`` gets the progress of every batch of every query: offsets, rows, rates, state sizes."""
        self.hooks.append(hook)
        return self

    def stats(self) -> dict[str, dict]:
        """The newest progress of each query, by its id."""
        return dict(self.progress.newest) if self.progress else {}

    def state(self) -> str:
        """The least advanced state of the application's queries."""
        if not self.queries:
            return "Created"

        def one(query: StreamingQuery) -> str:
            if not query.isActive:
                return "Stopped"
            # before its first batch a query restores what its checkpoint holds
            return "Running" if query.lastProgress else "Rebuilding"

        return min(map(one, self.queries), key=STATES.index)

    def run(self, timeout: float | None = None) -> list[StreamingQuery]:
        """Starts all and waits until they end, or for ``timeout`` seconds."""
        self.progress, self.stopped = Progress(self.hooks), False
        self.spark.streams.addListener(self.progress)
        self.queries = [s(self) for s in self.starts]
        tries = [0] * len(self.queries)
        end = None if timeout is None else time.monotonic() + timeout
        try:
            while not self.stopped and (end is None or time.monotonic() < end) and any(q.isActive for q in self.queries) or any(q.exception() for q in self.queries):
                for k, q in enumerate(self.queries):
                    failed = None if q.isActive else q.exception()
                    if failed is not None:
                        self._again(k, tries, failed)
                for q in self.queries:
                    if q.isActive:
                        try:
                            q.awaitTermination(0.2)
                        except StreamingQueryException:
                            pass  # the next turn sees that it failed, and why
                        break
        except Exception:
            self.stop()
            raise
        finally:
            self.spark.streams.removeListener(self.progress)
        return self.queries

    def _again(self, k: int, tries: list[int], failed: Exception) -> None:
        error = errors.classified(failed)
        self.breaker.failed()
        if isinstance(error, errors.Fatal) or tries[k] >= self.retries or not self.breaker.closed():
            raise failed
        tries[k] += 1
        self.queries[k] = self.starts[k](self)

    def stop(self) -> None:
        self.stopped = True
        for q in self.queries:
            if q.isActive:
                q.stop()
