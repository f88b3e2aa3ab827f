"""Removal of repeated passages, found with fixed-block anchors.

A passage is a window of ``size`` words.  Every document is cut into blocks of
``(size + 1) // 2`` words that do not overlap; any window holds one whole block
of its document.  So two places with the same window share a block hash: the
block of one is met by a rolling window of the other.  The steps:

1. index all blocks by hash, and probe them with the rolling window of every
   word position of every document (``hits``);
2. extend each hit: all windows of ``size`` words that contain it are compared
   by hash with those of all other hits (``repeats``); neighbouring windows
   that repeat join into maximal exact repeats;
3. remove the words they cover.

Equal hashes within one batch are settled there, and one of them goes on, so
a passage in a third of all documents sends one entry a batch.  Windows are
compared by 64 hash bits within one of ``parts`` hash ranges.

Defined results: documents are rows, so a repeated row is a repeat of the first
(both lose their windows); a null or empty text has no words; a text shorter
than ``size`` words is kept whole; a null id is allowed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import routing
from tidemark.llm import text as tx

WINDOW = 35
FLUSH_WORDS = 1_500_000


def keyed(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows as (row_key, doc_id, text, also_0 ..); row_key names a row by id and text."""
    text = F.col(text_col).cast("string")
    more = [F.col(c).alias(f"also_{k}") for k, c in enumerate(also)]
    return docs.select(F.xxhash64(F.col(id_col), text).alias("row_key"), F.col(id_col).alias("doc_id"), text.alias("text"), *more)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.word_spans(buf, offs)
    return tx.span_hash(buf, starts, ends), first


class _Buffer:
    """Entries (hash, key, position, mark) of several chunks, till they are worth a row."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else []
        self.parts, self.n = [], 0
        return out


def _local_repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries whose hash is in the batch more than once, entries that go on: one for each hash)."""
    order = np.argsort(h, kind="stable")
    start, n = tx.runs(h[order])
    again = np.zeros(len(h), bool)
    again[order] = np.repeat(n > 1, n)
    on = np.zeros(len(h), bool)
    on[order[start]] = True
    return again, on


def probes(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Packed blocks (kind 0), rolling windows (kind 1), and hits settled in a batch (kind 2)."""
    block, wide = (size + 1) // 2, parts > 60

    def flush(buffer):
        h, key, pos = buffer.take()
        again, on = _local_repeats(h)
        anchor = pos % block == 0
        part = routing.part_of(h, parts)
        low = h.astype(np.uint32)

        def pack(c):
            return [c[0], *routing.dump_places(c[1], c[2], wide)]

        for kind, pick in ((0, on & anchor), (1, on & ~anchor)):
            yield routing.routed(part[pick], kind, [low[pick], key[pick], pos[pick]], pack)
        own = np.full(int(again.sum()), int(part[0]) if len(part) else 0)
        yield routing.routed(own, 2, [key[again], pos[again]], lambda c: routing.dump_places(c[0], c[1], False))

    def run(batches):
        buffer = _Buffer()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in tx.chunks(batch.column(1)):
                h, first = _words(buf, offs)
                long = np.diff(first) >= size
                at, row = tx.windows(first, block)
                keep = long[row]
                at, row = at[keep], row[keep]
                if len(at):
                    buffer.add(tx.seq_hash(h, at, at + block), keys[i:j][row], at - first[row])
                if buffer.n >= FLUSH_WORDS:
                    yield from flush(buffer)
        if buffer.n:
            yield from flush(buffer)

    return docs.select("row_key", "text").mapInArrow(run, routing.SCHEMA)


def _index(low: np.ndarray) -> tx.HashTable:
    table = tx.HashTable(max(8, int(len(low)).bit_length() + 1))
    table.put(low.astype(np.uint64) + np.uint64(1), np.arange(len(low), dtype=np.int32))
    return table


def _answer(key: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places on their way back to the rows, packed by the rows' partitions."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    return routing.routed(routing.part_of(tx.mix(key.astype(np.uint64)), parts), 0, [key, pos], lambda c: routing.dump_places(c[0], c[1], False))


def gathered(packed: DataFrame, parts: int) -> DataFrame:
    """(row_key, data): all places of a row, one row each."""

    def run(batches):
        got = [routing.load_places(routing.load(x.as_buffer())) for batch in batches for x in batch.column(2)]
        if got:
            key, pos = map(np.concatenate, zip(*got))
            order = np.lexsort((pos, key))
            key, raw = key[order], pos[order].astype("<u4").tobytes()
            start, n = tx.runs(key)
            yield pa.RecordBatch.from_arrays([pa.array(key[start], pa.int64()), pa.array([raw[4 * a : 4 * (a + m)] for a, m in zip(start.tolist(), n.tolist())], pa.binary())], ["row_key", "data"])

    return routing.exchange(packed, parts).mapInArrow(run, "row_key long, data binary")


def hits(packed: DataFrame, parts: int) -> DataFrame:
    """Packed places whose block-long word sequence is an anchor elsewhere."""

    def run(batches):
        blocks, table, seen = _Buffer(), None, None
        for batch in batches:
            found = []
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                a = routing.load(data.as_buffer())
                if kind == 0:
                    blocks.add(a[0], *routing.load_places(a[1:]))
                    continue
                if table is None:
                    low, bkey, bpos = blocks.take() or [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                    some, slot, n = np.unique(low, return_inverse=True, return_counts=True)
                    table, seen = _index(some), n > 1
                if kind == 1:
                    at = table.get(a[0].astype(np.uint64) + np.uint64(1))
                    hit = at >= 0
                    if hit.any():
                        seen[at[hit]] = True
                        key, pos = routing.load_places(a[1:])
                        found.append((key[hit], pos[hit]))
                else:
                    found.append(routing.load_places(a))
            if found:
                yield _answer(*map(np.concatenate, zip(*found)), parts)
        if table is None and blocks.n:
            low, bkey, bpos = blocks.take()
            _, slot, n = np.unique(low, return_inverse=True, return_counts=True)
            table, seen = True, n > 1
        if table is not None and len(slot):
            yield _answer(bkey[seen[slot]], bpos[seen[slot]], parts)

    return routing.exchange(packed, parts).mapInArrow(run, routing.SCHEMA)


def _joined(lists, rows: int):
    """(row of each value, values) of a column of packed positions."""
    sizes = np.array([len(x) // 4 if x is not None else 0 for x in lists], np.int64)
    values = np.frombuffer(b"".join(x for x in lists if x is not None), "<u4").astype(np.int64)
    return np.repeat(np.arange(rows), sizes), values


def _cover(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:n]) > 0


def candidates(found: DataFrame, size: int, parts: int) -> DataFrame:
    """Packed windows around hits (kind 0), and repeats settled in a batch (kind 2).

    ``found`` has row_key, text and the packed hits of the row.
    """
    block, wide = (size + 1) // 2, parts > 60

    def flush(buffer):
        h, key, pos = buffer.take()
        again, on = _local_repeats(h)
        part = routing.part_of(h, parts)
        yield routing.routed(part[on], 0, [h[on], key[on], pos[on]], lambda c: [c[0], *routing.dump_places(c[1], c[2], wide)])
        own = np.full(int(again.sum()), int(part[0]) if len(part) else 0)
        yield routing.routed(own, 2, [key[again], pos[again]], lambda c: routing.dump_places(c[0], c[1], False))

    def run(batches):
        buffer = _Buffer()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2).to_pylist()
            for i, j, buf, offs in tx.chunks(batch.column(1)):
                h, first = _words(buf, offs)
                row, hit = _joined(lists[i:j], j - i)
                lo = first[row] + np.maximum(hit - (size - block), 0)
                hi = np.minimum(first[row] + hit, first[row + 1] - size) + 1
                ok = hi > lo
                at = np.flatnonzero(_cover(lo[ok], hi[ok], len(h) + 1))
                if len(at):
                    row = np.searchsorted(first, at, "right") - 1
                    buffer.add(tx.seq_hash(h, at, at + size), keys[i:j][row], at - first[row])
                if buffer.n >= FLUSH_WORDS:
                    yield from flush(buffer)
        if buffer.n:
            yield from flush(buffer)

    return found.mapInArrow(run, routing.SCHEMA)


def repeats(packed: DataFrame, parts: int) -> DataFrame:
    """Packed places of the windows that are anywhere else."""

    def run(batches):
        buffer = _Buffer()
        for batch in batches:
            settled = []
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                a = routing.load(data.as_buffer())
                if kind == 0:
                    buffer.add(a[0], *routing.load_places(a[1:]))
                else:
                    settled.append(routing.load_places(a))
            if settled:
                yield _answer(*map(np.concatenate, zip(*settled)), parts)
        if buffer.n:
            h, key, pos = buffer.take()
            order = np.argsort(h, kind="stable")
            _, n = tx.runs(h[order])
            pick = order[np.repeat(n > 1, n)]
            yield _answer(key[pick], pos[pick], parts)

    return routing.exchange(packed, parts).mapInArrow(run, routing.SCHEMA)


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, parts: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as ``text`` if asked.

    A text that loses nothing is returned as it is, null as null.  Columns named in ``also``
    come along, under the names also_0, also_1 and so on.

    One row for each row of ``docs``.  The texts are shuffled once, by row key;
    both joins read that exchange.
    """
    parts = parts or routing.partitions(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, also)
    extra = [f"also_{k}" for k in range(len(also))]

    found = gathered(hits(probes(rows, size, parts), parts), parts)
    # the id comes along so that both joins have the same columns and share one exchange
    near = rows.join(found, "row_key").select("row_key", "text", "data", "doc_id", *extra)
    covers = gathered(repeats(candidates(near, size, parts), parts), parts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    names = [x.split()[0] for x in schema.split(", ")] + extra
    schema += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(extra, also))

    def finish(batches):
        for batch in batches:
            words, removed, digest, kept = [], [], [], []
            lists = batch.column(2).to_pylist()
            for i, j, buf, offs in tx.chunks(batch.column(1)):
                raw = buf.tobytes()
                for k in range(j - i):
                    own = raw[offs[k] : offs[k + 1]].split()
                    n, spans = len(own), lists[i + k]
                    if spans is not None:
                        at = np.frombuffer(spans, "<u4").astype(np.int64)
                        gone = _cover(at, at + size, n)
                        own = [w for w, g in zip(own, gone.tolist()) if not g]
                    text = b" ".join(own)
                    words.append(n)
                    removed.append(n - len(own))
                    digest.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text if n > len(own) else raw[offs[k] : offs[k + 1]] if batch.column(1)[i + k].is_valid else None)
            arrays = [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays + batch.columns[3:], names)

    both = rows.join(covers, "row_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "data", *extra)
    return both.mapInArrow(finish, schema)
