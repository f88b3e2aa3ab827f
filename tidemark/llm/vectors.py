"""Numpy kernels and checks shared by the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Whether a vector is there, not zero, and has only finite components."""
    wide = column.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def common_size(rows: DataFrame) -> int:
    """The commonest dimension of the column ``vector``; the least of equally common ones; 0 if none."""
    got = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return int(got[0].n) if got else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """[rows, size] doubles of a column of lists of that length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def packed(column: pa.Array, size: int, dtype: str = "<f8") -> np.ndarray:
    """[rows, size] of a column of packed vectors."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype).reshape(len(column), size)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=-1)


def tree(x: np.ndarray, leaf: int, most: int) -> list[np.ndarray]:
    """Centroids of a balanced tree: level d has 2**d, each of its halves split at the median.

    A node is cut across the line between the means of the two halves of its
    points along a direction, taken twice, so that the cut follows the data.
    """
    if not len(x):
        return [np.zeros((1, x.shape[1]))]
    groups, levels = [np.arange(len(x))], [x.mean(axis=0, keepdims=True)]
    while len(groups) * 2 <= most and min(map(len, groups)) >= 2 * leaf:
        halves = []
        for g in groups:
            own = x[g]
            line = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))] - own[0]
            for _ in range(4):
                order = np.argsort(own @ line, kind="stable")
                half = len(g) // 2
                line = own[order[half:]].mean(axis=0) - own[order[:half]].mean(axis=0)
            halves += [g[order[:half]], g[order[half:]]]
        groups = halves
        levels.append(np.stack([x[g].mean(axis=0) for g in groups]))
    return levels


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] squared distances."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def robust_pruned(x: np.ndarray, degree: int, alpha: float = 1.2, block: int = 256, pool: int = 48) -> np.ndarray:
    """[rows, degree] neighbours (-1: none): near ones, but none that a nearer one covers.

    From each point's nearest ``pool`` points the nearest is taken again and
    again, and the points that are ``alpha`` times nearer to it than to the point go.
    """
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    if n < 2:
        return out
    pool = min(pool, n - 1)
    norm = (x * x).sum(axis=1)
    for lo in range(0, n, block):
        i = np.arange(lo, min(lo + block, n))
        d = norm[i][:, None] + norm - 2 * (x[i] @ x.T)
        d[np.arange(len(i)), i] = np.inf
        cand = np.argpartition(d, pool - 1, axis=1)[:, :pool]
        dist = np.take_along_axis(d, cand, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
        near = x[cand]
        between = norm[cand][:, :, None] + norm[cand][:, None, :] - 2 * (near @ near.transpose(0, 2, 1))
        live = np.isfinite(dist)
        line = np.arange(len(i))
        for k in range(degree):
            some = live.any(axis=1)
            if not some.any():
                break
            first = live.argmax(axis=1)
            out[i[some], k] = cand[line, first][some]
            live[line, first] = False
            live &= alpha * alpha * between[line, first] > dist
    return out


def _padded(a: np.ndarray, b: np.ndarray, n: int, width: int) -> np.ndarray:
    """[n, width] of the b of each a, in the order given; what is beyond the width goes; -1: none."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < width
    out = np.full((n, max(1, int(rank[keep].max()) + 1 if keep.any() else 1)), -1, np.int32)
    out[a[keep], rank[keep]] = b[keep]
    return out


def linked(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, sure: int = 4) -> np.ndarray:
    """Neighbour lists of the edges in both directions, about the ``most`` nearest of a node; -1: none.

    A node is listed for sure by the ``sure`` of its own neighbours that the
    fewest others name, so that one which is nobody's nearest is found too.
    """
    n = len(x)
    named = np.bincount(b, minlength=n)
    order = np.lexsort((named[b], a))
    rank = np.arange(len(a)) - np.searchsorted(a[order], a[order])
    back = order[rank < sure]
    must = np.unique(b[back] * n + a[back])
    pair = np.unique(np.r_[a * n + b, b * n + a])
    rest = ~np.isin(pair, must)
    a, b = pair // n, pair % n
    order = np.lexsort((((x[a] - x[b]) ** 2).sum(axis=1), rest))
    width = max([most, *np.bincount(must // n).tolist()]) if len(must) else most
    return _padded(a[order], b[order], n, width)


def medoids(x: np.ndarray, most: int = 64) -> np.ndarray:
    """For each leaf of a balanced tree of the points, the point nearest to its mean."""
    points = tree(x, 8, most)[-1]
    return np.unique(squared(points.astype(x.dtype), x).argmin(axis=1))


def reached(x: np.ndarray, graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The graph with an edge, there and back, into every part that the entries do not reach."""
    n = len(x)
    seen = np.zeros(n, bool)

    def spread(front):
        seen[front] = True
        while len(front):
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True

    spread(entries)
    a, b = [], []
    for out in range(n):
        if not seen[out]:
            inside = np.flatnonzero(seen)
            to = int(inside[(x[inside] @ x[out]).argmax()])
            a += [out, to]
            b += [to, out]
            spread(np.array([out]))
    if not a:
        return graph
    more = _padded(np.array(a), np.array(b), n, len(a))
    return np.concatenate([graph, more], axis=1)


def beam(x: np.ndarray, graph: np.ndarray, entry, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """([queries, width] nodes, their squared distances) of a greedy search, nearest first.

    ``entry`` is a node, or one for each query; ``graph`` has -1 for no
    neighbour.  All queries take a step together.
    """
    n, q = len(x), len(queries)
    width = min(width, n)
    nodes = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf, x.dtype)
    open_ = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    line = np.arange(q)
    entry = np.broadcast_to(entry, q)
    nodes[:, 0], dist[:, 0], open_[:, 0] = entry, ((queries - x[entry]) ** 2).sum(axis=1), True
    seen[line, entry] = True
    norm, own = (x * x).sum(axis=1), (queries * queries).sum(axis=1)
    while open_.any():
        best = np.where(open_, dist, np.inf).argmin(axis=1)
        go = open_[line, best]
        rows = line[go]
        open_[rows, best[rows]] = False
        new = graph[nodes[rows, best[rows]]].astype(np.int64)
        at = np.where(new >= 0, new, 0)
        ok = (new >= 0) & ~seen[rows[:, None], at]
        seen[rows[:, None], at] |= ok
        dots = (x[at] @ queries[rows][:, :, None])[:, :, 0]
        d = np.where(ok, np.maximum(norm[at] + own[rows][:, None] - 2 * dots, 0), np.inf).astype(x.dtype)
        both = np.concatenate([dist[rows], d], axis=1)
        if both.shape[1] > 2 * width:
            some = np.argpartition(both, width, axis=1)[:, :width]
            some = np.take_along_axis(some, np.argsort(np.take_along_axis(both, some, axis=1), axis=1, kind="stable"), axis=1)
        else:
            some = np.argsort(both, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(both, some, axis=1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], new], axis=1), some, axis=1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], ok], axis=1), some, axis=1) & np.isfinite(dist[rows])
    return nodes, dist
