"""Nearest neighbours by inner product: balanced posting lists.

The centroids come from a balanced median-split tree over a bounded sample; a
robust-pruned graph over them is small enough for the memory of every task, and
greedy search in it finds the lists of a vector.  Every vector is in the list of
its nearest centroid, and boundary vectors in several: those of about the same
distance, unless one already taken is nearer to the centroid than the vector.
A query reads the lists whose centroids are at most ``ratio`` times as far as
its nearest one.  The ratio is measured: the least that finds ``AIM`` of the
true neighbours of a bounded set of audit queries, compared with brute force.
Where those lists are too short to hold k other vectors for sure, the next
nearest lists are read too.

Inner product becomes distance with one more component, which gives all vectors
the length of the longest.  Lists are read in parts of at most about
``PART_ROWS`` rows, so a hot list is many tasks' work.  Of equal vectors only
the ``k + 1`` of least id can be among the nearest, so only those are listed.

Defined results: null, zero or not finite vectors and those of a null id take no
part; the candidates of a query are the vectors of its dimension; of rows equal
in id and vector one counts; ties go to the smaller id; a query's own id is no candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch, vectors

#: Bounds of what the driver sees: sample rows for centroids, centroids, audit queries.
SAMPLE_ROWS, MOST_LISTS, AUDIT_QUERIES = 20_000, 4096, 64
LIST_ROWS = 256
PART_ROWS = 4096
REPLICAS, CLOSE = 4, 1.1
AIM = 0.96
K = 20


@dataclass
class Centroids:
    """points [lists, dim + 1]; graph of their neighbours; entry: the medoid."""

    points: np.ndarray
    graph: np.ndarray
    entry: int
    longest: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def near(self, lifted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and distances, nearest first, by greedy search."""
        got = [vectors.beam(self.points, self.graph, self.entry, lifted[i : i + 512], width) for i in range(0, len(lifted), 512)]
        return np.concatenate([g[0] for g in got]), np.sqrt(np.concatenate([g[1] for g in got]))

    def own_lists(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list, and those that a boundary vector is copied to."""
        nodes, dist = self.near(lifted, 32)
        taken = np.full((len(lifted), REPLICAS), -1, np.int64)
        taken[:, 0] = nodes[:, 0]
        count = np.ones(len(lifted), int)
        for k in range(1, nodes.shape[1]):
            ok = np.isfinite(dist[:, k]) & (dist[:, k] <= CLOSE * dist[:, 0]) & (count < REPLICAS)
            for j in range(REPLICAS):
                c = taken[:, j]
                apart = np.sqrt(((self.points[nodes[:, k]] - self.points[c]) ** 2).sum(axis=1))
                ok &= (c < 0) | (apart > dist[:, k])
            rows = np.flatnonzero(ok)
            taken[rows, count[rows]] = nodes[rows, k]
            count[rows] += 1
        r, c = np.nonzero(taken >= 0)
        return r, taken[r, c]


def centroids(rows: DataFrame, size: int) -> Centroids:
    """From at most SAMPLE_ROWS distinct vectors, those of least hash.

    rows: vec_id, vector, and first, which holds for one row of each distinct vector.
    """
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    sample = rows.where("first").orderBy(F.xxhash64("vector"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    x = vectors.matrix(sample, size)
    longest = float(np.sqrt(stats.longest or 0))
    x = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))])
    want = min(MOST_LISTS, max(1, int(stats.n) // LIST_ROWS))
    levels = vectors.tree(x, 4, want)
    points = levels[-1]
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    near = vectors.robust_pruned(points, 24)
    a, k = np.nonzero(near >= 0)
    graph = vectors.reached(points, vectors.linked(points, a, near[a, k].astype(np.int64), 64), np.array([entry]))
    return Centroids(points, graph, entry, longest)


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best distinct candidates: by score, then the smaller id."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # equal ids have equal scores
    order, q = order[fresh], q[fresh]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def _scan(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int):
    """(query, vec, score) of the k best in x for each query, with exact scores of those that may be."""
    for lo in range(0, len(q), 256):
        i = slice(lo, lo + 256)
        rough = q[i] @ x.T
        rough[qid[i][:, None] == vid] = -np.inf
        m = min(k, len(x))
        least = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        r, c = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        score = vectors.inner(q[i][r], x[c])
        pick = _top(r, vid[c], score, k)
        yield qid[i][r[pick]], vid[c[pick]], score[pick]


_PARTIAL = "query_id long, hits binary"


def _packed(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    end = np.r_[start[1:], len(q)]
    data = [v[a:b].astype("<i8").tobytes() + s[a:b].astype("<f8").tobytes() for a, b in zip(start, end)]
    return pa.RecordBatch.from_arrays([pa.array(q[start]), pa.array(data, pa.binary())], ["query_id", "hits"])


def _search_lists(rows: DataFrame, size: int, k: int) -> DataFrame:
    """rows: list, part, kind (0 vector, 1 query), id, vector (packed), sorted; partial results."""

    def run(batches):
        name, vid, x, own = None, None, None, []
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            ids, v = batch.column(3).to_numpy(zero_copy_only=False), vectors.packed(batch.column(4), size)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
            for a, b in zip(cut, [*cut[1:], len(key)]):
                if name != tuple(key[a, :2]):
                    name, own = tuple(key[a, :2]), []
                if key[a, 2] == 0:
                    own.append((ids[a:b], v[a:b]))
                elif own:
                    if len(own) > 1:
                        own = [tuple(map(np.concatenate, zip(*own)))]
                    for q, c, s in _scan(ids[a:b], v[a:b], *own[0], k):
                        yield _packed(q, c, s)

    return rows.mapInArrow(run, _PARTIAL)


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the partial results of a bounded number of lists a query."""

    def run(batches):
        for batch in batches:
            q, v, s = [], [], []
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in parts:
                    n = len(p) // 16
                    v.append(np.frombuffer(p, "<i8", n))
                    s.append(np.frombuffer(p, "<f8", n, 8 * n))
                    q.append(np.full(n, i))
            if not q:
                continue
            q, v, s = map(np.concatenate, (q, v, s))
            pick = _top(q, v, s, k)
            q, v, s = q[pick], v[pick], s[pick]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    return partial.groupBy("query_id").agg(F.collect_list("hits").alias("hits")).mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def brute_force(queries: DataFrame, rows: DataFrame, size: int, k: int) -> DataFrame:
    """The true nearest rows of a bounded set of queries, for audits."""
    got = queries.select("vec_id", "vector").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((got["vec_id"].to_numpy(), vectors.matrix(got["vector"].combine_chunks(), size)))

    def run(batches):
        qid, q = shared.value
        for batch in batches:
            if len(batch) and len(q):
                for a, b, s in _scan(qid, q, batch.column(0).to_numpy(), vectors.matrix(batch.column(1), size), k):
                    yield _packed(a, b, s)

    return _merged(rows.select("vec_id", "vector").mapInArrow(run, _PARTIAL), k)


def _needed_ratio(truth, lists, queries, model: Centroids, aim: float) -> float:
    """The least ratio whose lists hold ``aim`` of the true neighbours of the audit queries."""
    where: dict[int, list[int]] = {}
    for v, c in zip(lists["vec_id"].to_numpy(), lists["list"].to_numpy()):
        where.setdefault(int(v), []).append(int(c))
    lifted = model.lift(queries[1], True)
    d = np.sqrt(vectors.squared(lifted, model.points))
    row = {int(q): i for i, q in enumerate(queries[0])}
    need = [min(d[row[int(q)], where[int(v)]]) / max(d[row[int(q)]].min(), 1e-12) for q, v in zip(truth["query_id"].to_numpy(), truth["vec_id"].to_numpy()) if int(v) in where]
    return float(np.quantile(need, aim)) * (1 + 1e-9) if need else 1.0


def search(embeddings: DataFrame, every: int = 20, k: int = K, aim: float = AIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    Every dimension that occurs is a pass of its own.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = scratch.saved(rows.where(F.col("vec_id").isNotNull() & vectors.usable(F.col("vector"))).distinct())
    sizes = [r.n for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = None
    for size in sizes:
        own = _nearest(rows.where(F.size("vector") == size) if len(sizes) > 1 else rows, size, every, k, aim)
        found = own if found is None else found.union(own)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    if len(sizes) > 1:  # an id may have vectors of several dimensions
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found


def _nearest(rows: DataFrame, size: int, every: int, k: int, aim: float) -> DataFrame:
    """The search among distinct rows of one dimension."""
    spark = rows.sparkSession
    queries = rows.where(F.col("vec_id") % every == 0)
    # the k + 1 least ids of each distinct vector
    same = rows.groupBy(F.xxhash64("vector").alias("h"), "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    several = same.where("n > 1").select("h")
    alone = rows.join(several, F.xxhash64("vector") == several.h, "left_anti")
    copies = rows.join(several, F.xxhash64("vector") == several.h, "left_semi")
    # two steps, so that a hot vector's ids meet in a bounded array only
    salted = copies.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    listed = salted.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    listed = alone.select("vec_id", "vector", F.lit(True).alias("first")).union(listed.select(F.posexplode("ids").alias("place", "vec_id"), "vector").select("vec_id", "vector", F.col("place") == 0))
    listed = scratch.saved(listed)
    model = centroids(listed, size)
    shared = spark.sparkContext.broadcast(model)

    def post(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(1), size)
            if not len(x):
                continue
            r, c = shared.value.own_lists(shared.value.lift(x, False))
            data = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0).take(pa.array(r)), pa.array([data[i] for i in r.tolist()], pa.binary())], ["list", "vec_id", "vector"])

    lists = scratch.saved(listed.select("vec_id", "vector").mapInArrow(post, "list long, vec_id long, vector binary"))
    audit = queries.orderBy(F.xxhash64("vec_id")).limit(AUDIT_QUERIES)
    truth = brute_force(audit, rows, size, k).toPandas()
    wanted = spark.createDataFrame([(int(v),) for v in truth["vec_id"].unique()], "vec_id long")
    held = lists.select("list", "vec_id").join(F.broadcast(wanted), "vec_id").toPandas()
    got = audit.toArrow()
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.count("*").alias("n"))
    sizes = np.zeros(len(model.points), np.int64)
    for r in parts.collect():
        sizes[r.list] = r.n
    held_by = spark.sparkContext.broadcast(sizes)
    parts = parts.drop("n")
    ratio = _needed_ratio(truth, held, (got["vec_id"].to_numpy(), vectors.matrix(got["vector"].combine_chunks(), size)), model, aim)

    # a vector is in at most REPLICAS lists, so that many entries hold k others and the query for sure
    enough = REPLICAS * (k + 1)

    def probe(batches):
        m, sizes = shared.value, held_by.value
        for batch in batches:
            x = vectors.matrix(batch.column(1), size)
            if not len(x):
                continue
            width = 64
            while True:  # a wider beam till the lists found reach beyond the ratio
                nodes, dist = m.near(m.lift(x, True), width)
                entries = np.cumsum(np.where(nodes >= 0, sizes[nodes], 0), axis=1)
                if width >= len(m.points) or ((dist[:, -1] > ratio * dist[:, 0]) & (entries[:, -1] >= enough)).all():
                    break
                width *= 2
            before = np.column_stack([np.zeros(len(x), np.int64), entries[:, :-1]])
            r, c = np.nonzero(np.isfinite(dist) & ((dist <= ratio * dist[:, :1]) | (before < enough)))
            data = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[r, c]), batch.column(0).take(pa.array(r)), pa.array([data[i] for i in r.tolist()], pa.binary())], ["list", "vec_id", "vector"])

    probes = queries.mapInArrow(probe, "list long, vec_id long, vector binary")
    vec = lists.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "vector")
    ask = probes.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", "vector")
    both = vec.union(ask).repartition("list", "part").sortWithinPartitions("list", "part", "kind")
    return _merged(_search_lists(both, size, k), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours that were found, over the queries of ``truth``."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(truth.count(), 1)
