"""Near-duplicate embeddings with a robust-pruned flat graph.

Vectors are compared inside their label only, and with those of their own
dimension.  A label's vectors are cut into cells: a large label by the nearest
of a tree's centroids, its home; a vector that is within half the search radius
of another cell's border belongs to that cell too.  Of two vectors close enough
to link, at least one is so in a cell that is the other's home.  A cell of many
members is taken in blocks.  The steps:

1. in every block a graph of near neighbours is built with robust pruning;
2. the neighbour lists that a vector has in several blocks are united;
3. every vector searches the blocks of its home cell in the united graph: a
   greedy search from the nearest of the block's medoids, then an expansion
   over all nodes in range that grows as long as it finds new ones;
4. found pairs are verified by cosine in double precision and counted in the
   block that owns them; what leaves a block is a count for each vector and the
   edges of a spanning forest, never the pairs;
5. a bounded audit compares the links of some vectors with brute force after
   every search.  If any is missing the search runs again with a wider beam,
   and after the widest the blocks are scanned in full.

Equal vectors of a label are one class and are never compared with each other.

Defined results: null labels and null, zero or not finite vectors link with
nothing; vectors of different dimensions do not link; every row counts,
repeated rows too (they link with each other); a null id links nothing and has
a null component; all rows come out, linked or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components, scratch, vectors
from tidemark.llm import text as tx

COSINE = 0.98
#: Bounds: rows the driver sees for the tree, its leaves, audited vectors.
SAMPLE_ROWS, MOST_CELLS, AUDIT_ROWS = 20_000, 4096, 64
#: Home vectors a cell is to have, and members of a block.
CELL_ROWS, BLOCK_ROWS = 2048, 4096
DEGREE, MOST_NEIGHBOURS = 16, 48
#: The expansion goes on from nodes whose squared distance is so many times the radius's.
BEYOND = 3
#: Widths of the greedy search; None scans a block in full.
BEAMS = (8, 32, 128, None)


def _depths(labels: DataFrame, levels: int) -> DataFrame:
    """label, depth: the level of the tree that cuts a label into cells of about CELL_ROWS."""
    n = F.col("n") / CELL_ROWS
    return labels.select("label", F.least(F.greatest(F.ceil(F.log2(n)), F.lit(0)), F.lit(levels - 1)).cast("int").alias("depth"))


def _cells(rows: DataFrame, levels: list[np.ndarray], size: int, radius: float) -> DataFrame:
    """(label, cell, home, cid, weight, cells, raw): each class in its cells; cells lists all of them, home first."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    names = ["label", "cell", "home", "cid", "weight", "cells", "raw"]

    def run(batches):
        tree = shared.value
        for batch in batches:
            depth = batch.column(4).to_numpy()
            for d in np.unique(depth):
                points = tree[d]
                apart = np.sqrt(vectors.squared(points, points))
                step = max(1, (1 << 21) // len(points))
                every = np.flatnonzero(depth == d)
                for lo in range(0, len(every), step):
                    i = every[lo : lo + step]
                    own_rows = batch.take(pa.array(i))
                    x = vectors.matrix(own_rows.column(2), size)
                    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                    dist = vectors.squared(unit, points)
                    own = dist.argmin(axis=1)
                    # distance to the border with each other cell; the slack covers rounding
                    border = (dist - dist[np.arange(len(i)), own][:, None]) / np.maximum(2 * apart[own], 1e-12)
                    border[np.arange(len(i)), own] = -1
                    r, c = np.nonzero(border <= radius / 2 + 1e-6)
                    order = np.lexsort((c != own[r], r))
                    r, c = r[order], c[order].astype(np.int32)
                    offs = np.searchsorted(r, np.arange(len(i) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(c))
                    raw = tx.binaries(x.ravel(), np.arange(len(i) + 1) * size)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([own_rows.column(1).take(take), pa.array(c), pa.array(c == own[r]), own_rows.column(0).take(take), own_rows.column(3).take(take), lists.take(take), raw.take(take)], names)

    return rows.select("cid", "label", "vector", "weight", "depth").mapInArrow(run, "label long, cell int, home boolean, cid long, weight long, cells array<int>, raw binary")


def _blocks(batches, columns: int):
    """Groups of rows with equal first three columns, whole, from batches sorted by them."""
    name, held = None, []
    for batch in batches:
        key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]) if len(batch) else np.zeros((0, 3))
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
        for a, b in zip(cut, [*cut[1:], len(key)]):
            if name is not None and name != tuple(key[a]):
                yield name, [pa.concat_arrays([h.column(k) for h in held]) for k in range(3, columns)]
                held = []
            name = tuple(key[a])
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield name, [pa.concat_arrays([h.column(k) for h in held]) for k in range(3, columns)]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(vectors.inner(x, x))[:, None]).astype(np.float32)


def graph(members: DataFrame, size: int) -> DataFrame:
    """(cid, neighbours): the united neighbour lists of all blocks."""

    def run(batches):
        for _, (cid, raw) in _blocks(batches, 5):
            ids, x = cid.to_numpy(), _unit(vectors.packed(raw, size))
            near = vectors.robust_pruned(x, DEGREE)
            lens = (near >= 0).sum(axis=1)
            offs = np.r_[0, np.cumsum(lens)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([cid, pa.ListArray.from_arrays(pa.array(offs), pa.array(ids[near[near >= 0]]))], ["cid", "neighbours"])

    parts = members.select("label", "cell", "block", "cid", "raw").repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block")
    lists = parts.mapInArrow(run, "cid long, neighbours array<long>")
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def _in_range(x: np.ndarray, near: np.ndarray, entries: np.ndarray, query: np.ndarray, own: np.ndarray, least: float, width: int):
    """(query, node) pairs of about ``least`` or more: a greedy search, then an expansion over all nodes in range.

    ``own`` is the node that a query is itself, or -1; it is a start as the medoids are.
    """
    n = len(x)
    for lo in range(0, len(query), 256):
        q, self_ = query[lo : lo + 256], own[lo : lo + 256]
        first = entries[(q @ x[entries].T).argmax(axis=1)]
        nodes, dist = vectors.beam(x, near, first, q, width)
        seen = np.zeros((len(q), n), bool)
        line = np.repeat(np.arange(len(q)), nodes.shape[1])
        ok = nodes.ravel() >= 0
        r, c = line[ok], nodes.ravel()[ok]
        some = np.flatnonzero(self_ >= 0)
        r, c = np.r_[r, some], np.r_[c, self_[some]]
        while len(r):
            fresh = np.unique(r * n + c)
            r, c = fresh // n, fresh % n
            new = ~seen[r, c]
            r, c = r[new], c[new]
            seen[r, c] = True
            # single precision here; the exact test follows
            cos = vectors.inner(q[r], x[c])
            hit = cos >= least - 1e-5
            if hit.any():
                yield r[hit] + lo, c[hit]
            # nodes just out of range lead to others in range
            on = cos >= 1 - BEYOND * (1 - least)
            r, c = r[on], c[on]
            ways = near[c]
            ok = ways >= 0
            r, c = np.repeat(r, ok.sum(axis=1)), ways[ok].astype(np.int64)


def _scan(x: np.ndarray, query: np.ndarray, least: float):
    for lo in range(0, len(query), 256):
        r, c = np.nonzero(query[lo : lo + 256] @ x.T >= least - 1e-5)
        yield r + lo, c


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return vectors.inner(a, b) / (np.sqrt(vectors.inner(b, b)) * np.sqrt(vectors.inner(a, a)))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (node, least node of its component)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            break
    some = np.flatnonzero(label != np.arange(n))
    return some, label[some]


COUNT, EDGE = 0, 1


def search(members: DataFrame, adjacency: DataFrame, size: int, least: float, width: int | None) -> DataFrame:
    """(kind, a, b): COUNT rows say how many rows a class a links with; EDGE rows link classes a and b."""

    def run(batches):
        for (_, cell, block), (kind, cid, home, chunk, weight, cells, raw, near) in _blocks(batches, 11):
            ids, kind, home, chunk, weight = (c.to_numpy(zero_copy_only=False) for c in (cid, kind, home, chunk, weight))
            v = vectors.packed(raw, size)
            u = _unit(v)
            base, asks = np.flatnonzero(kind == 0), np.flatnonzero(home)
            if not len(base) or not len(asks):
                continue
            x, place = u[base], np.full(len(ids), -1)
            place[base] = np.arange(len(base))
            if width is None:
                found = _scan(x, u[asks], least)
            else:
                ways = vectors.linked(x, *_local(ids[base], near.take(pa.array(base))), MOST_NEIGHBOURS)
                entries = vectors.medoids(x)
                ways = vectors.reached(x, ways, entries)
                found = _in_range(x, ways, entries, u[asks], place[asks], least, width)
            pairs = [(asks[q], base[c]) for q, c in found]
            if not pairs:
                continue
            a, b = (np.concatenate(p) for p in zip(*pairs))
            # home vectors of a lower chunk ask for themselves in the block of the asking one
            keep = (a != b) & ~(home[b] & (chunk[b] < chunk[a]))
            a, b = a[keep], b[keep]
            one = np.unique(np.minimum(a, b).astype(np.int64) * len(ids) + np.maximum(a, b))
            a, b = one // len(ids), one % len(ids)
            keep = np.concatenate([_cosine(v[a[i : i + 65536]], v[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            # a pair of two homes belongs to the lesser of the two cells that hold both
            inner, outer = np.where(home[a], a, b), np.where(home[a], b, a)
            offs = cells.offsets.to_numpy().astype(np.int64)
            flat, offs = cells.flatten().to_numpy(), offs - offs[0]
            far = flat[offs[outer]]
            held = np.repeat(np.arange(len(ids)), np.diff(offs)) * np.int64(MOST_CELLS) + flat
            counted = (home[a] & home[b]) | (far > cell) | ~np.isin(inner * np.int64(MOST_CELLS) + far, held)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, a[counted], weight[b[counted]])
            np.add.at(total, b[counted], weight[a[counted]])
            some = np.flatnonzero(total)
            node, root = _forest(a, b, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(len(some), COUNT), np.full(len(node), EDGE)].astype(np.int32)), pa.array(np.r_[ids[some], ids[node]]), pa.array(np.r_[total[some], ids[root]])], ["kind", "a", "b"])

    own = members.join(adjacency, "cid", "left").select("label", "cell", "block", F.lit(0).alias("kind"), "cid", "home", F.col("block").alias("chunk"), "weight", "cells", "raw", "neighbours")
    others = members.where("home AND blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    others = others.select("label", "cell", F.col("other").alias("block"), F.lit(1).alias("kind"), "cid", "home", F.col("block").alias("chunk"), "weight", "cells", "raw", F.lit(None).cast("array<long>").alias("neighbours"))
    rows = own.union(others).repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "kind")
    return rows.mapInArrow(run, "kind int, a long, b long")


def _local(ids: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(node, neighbour) places of the neighbours that are in the block."""
    order = np.argsort(ids)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
    ok = ids[order][at] == flat
    return np.repeat(np.arange(len(ids)), sizes)[ok], order[at[ok]]


def _missing(found: DataFrame, classes: DataFrame, size: int, least: float) -> float:
    """The share of the true links of a bounded set of classes that the search has not found."""
    counts = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n"))
    linked = counts.select("cid").orderBy(F.xxhash64("cid")).limit(AUDIT_ROWS // 2)
    other = classes.select("cid").orderBy(F.xxhash64("cid")).limit(AUDIT_ROWS // 2)
    some = classes.join(F.broadcast(linked.union(other).distinct()), "cid").join(counts, "cid", "left").select("cid", "label", "vector", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    if not some.num_rows:
        return 0.0
    ids, labels = some["cid"].to_numpy(), some["label"].to_numpy()
    q = vectors.matrix(some["vector"].combine_chunks(), size)
    shared = classes.sparkSession.sparkContext.broadcast((ids, labels, q))

    def run(batches):
        ids, labels, q = shared.value
        unit, total = _unit(q), 0
        for batch in batches:
            if not len(batch):
                continue
            x = vectors.matrix(batch.column(2), size)
            r, c = np.nonzero((unit @ _unit(x).T >= least - 1e-5) & (labels[:, None] == batch.column(1).to_numpy()) & (ids[:, None] != batch.column(0).to_numpy()))
            total += int(batch.column(3).to_numpy()[c[_cosine(q[r], x[c]) >= least]].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["n"])

    true = classes.select("cid", "label", "vector", "weight").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    shared.unpersist()
    return 1 - int(np.sum(some["n"].to_numpy())) / true if true else 0.0


def _linked(classes: DataFrame, size: int, least: float) -> DataFrame:
    """The rows of ``search`` for the classes of one dimension, a saved table."""
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    x = vectors.matrix(sample, size)
    levels = vectors.tree(x / np.sqrt(vectors.inner(x, x))[:, None], 8, MOST_CELLS)
    depths = _depths(classes.groupBy("label").agg(F.count("*").alias("n")), len(levels))
    placed = scratch.saved(_cells(classes.join(depths, "label"), levels, size, float(np.sqrt(2 - 2 * least))))
    # a large cell's members are dealt out by hash; its home vectors ask in each block
    counts = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    members = placed.join(counts, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    adjacency = scratch.saved(graph(members, size))
    for width in BEAMS:
        found = scratch.saved(search(members, adjacency, size, least, width))
        if width is None or not _missing(found, classes, size, least):
            break
        scratch.drop(found)
    scratch.drop(placed)
    scratch.drop(adjacency)
    return found


def near_duplicates(embeddings: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``embeddings``.

    Every dimension that occurs is a pass of its own.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable(F.col("vector"))
    keyed = rows.withColumn("cid", F.when(part, F.xxhash64("label", "vector")))
    # the vector comes along once for each class and task
    classes = keyed.where("cid IS NOT NULL").groupBy("cid").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("rep"))
    classes = scratch.saved(classes)
    sizes = [r.n for r in classes.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = classes.select(F.lit(0).alias("kind"), F.col("cid").alias("a"), F.col("cid").alias("b")).where("false")
    for size in sizes:
        own = classes.where(F.size("vector") == size) if len(sizes) > 1 else classes
        found = found.union(_linked(own, size, least)) if len(sizes) > 1 else _linked(own, size, least)
    near = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("near"))
    labels = components.components(found.where(F.col("kind") == EDGE).select("a", "b")).withColumnRenamed("id", "cid")
    named = classes.select("cid", "rep", "weight").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "component").join(near, "cid", "left").select("cid", "component_id", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = keyed.select("vec_id", "cid").join(named, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
