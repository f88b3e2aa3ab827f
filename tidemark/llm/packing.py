"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are parted into reciprocal-capacity classes: class k holds the lengths
in (capacity / (k + 1), capacity / k], and a bin of class k takes exactly k
documents.  A class never needs to see another, nor a worker another worker, so
packing is one pass without a shuffle.

Documents up to the capacity go whole into the bins of their classes.  What a
full bin of class k leaves, less than a k + 1st of the capacity, is its gap.
Longer documents are *filler*: they are cut to fill gaps, and beyond what gaps
need into whole sequences.  Where gaps outrun the filler, a document of the
first class turns into filler once the gaps can take all of it, so a corpus of
short documents has few of them cut.  When a worker's rows end, the bins still
open are poured into the last gaps and sequences; a rest that fills no sequence
is cut into powers of two, which need no padding.

Bounds: a worker holds at most ``MOST_GAPS`` bins with gaps and
``MOST_FILLER`` sequences of filler beyond the document at hand.

Defined results: a null or empty text is the separator alone; every id lies in
one piece; sequences of a document's pieces may differ; sequence ids are unique
over all workers and the same for the same partitions.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

CAPACITY = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FLUSH_ROWS = 20_000
MOST_GAPS, MOST_FILLER = 2048, 64


def harmonic_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


class Packer:
    """Fills the bins of one worker.  A piece is (document, start, length); documents are told by the caller.

    ``add`` takes a document and yields (piece, sequence, offset) of all bins it completes.
    """

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list] = {}  # class -> pieces of its bin
        self.gaps: deque = deque()  # (room, pieces) of full bins
        self.room = 0  # of all gaps together
        self.filler: deque = deque()  # (document, start, length)
        self.held = 0  # tokens of filler

    def add(self, document, length: int) -> Iterator[tuple]:
        k = harmonic_class(length, self.capacity)
        # gaps that can take a whole document of the first class turn it into filler
        if k == 0 or (k == 1 and length < self.capacity and len(self.gaps) >= MOST_GAPS and length <= self.room):
            self.filler.append((document, 0, length))
            self.held += length
            yield from self._fill()
            while self.held > MOST_FILLER * self.capacity:
                yield from self._close(self._take(self.capacity))
            return
        bin_ = self.open.setdefault(k, [])
        bin_.append((document, 0, length))
        if len(bin_) == k:
            del self.open[k]
            room = self.capacity - sum(p[2] for p in bin_)
            if room:
                self.gaps.append((room, bin_))
                self.room += room
                yield from self._fill()
            else:
                yield from self._close(bin_)

    def _take(self, length: int) -> list:
        """Pieces of ``length`` tokens of filler in all, the oldest first."""
        self.held -= length
        out = []
        while length:
            document, start, rest = self.filler.popleft()
            n = min(rest, length)
            out.append((document, start, n))
            length -= n
            if rest > n:
                self.filler.appendleft((document, start + n, rest - n))
        return out

    def _fill(self) -> Iterator[tuple]:
        while self.gaps and self.held >= self.gaps[0][0]:
            room, bin_ = self.gaps.popleft()
            self.room -= room
            yield from self._close(bin_ + self._take(room))

    def _close(self, bin_: list) -> Iterator[tuple]:
        at = 0
        for piece in bin_:
            yield piece, self.next, at
            at += piece[2]
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        """All that is left when the worker's rows end: no sequence that is padded."""
        # whole documents first: gaps that an open bin's pieces fit into, the largest pieces first
        loose = sorted((p for k in self.open for p in self.open[k]), key=lambda p: -p[2])
        self.open = {}
        gaps = sorted(self.gaps, key=lambda g: g[0])
        self.gaps, self.room = deque(), 0
        for piece in loose:
            at = next((i for i, g in enumerate(gaps) if g[0] >= piece[2]), None)
            if at is None:
                room, at = self.capacity, len(gaps)
                gaps.append((room, []))
            room, bin_ = gaps[at]
            bin_.append(piece)
            room -= piece[2]
            if room:
                gaps[at] = (room, bin_)
                gaps.sort(key=lambda g: g[0])
            else:
                gaps.pop(at)
                yield from self._close(bin_)
        # then the fullest bins take the filler, and the emptiest bins become filler
        while gaps:
            room, bin_ = gaps.pop(0)
            while self.held < room and gaps:
                for piece in gaps.pop()[1]:
                    self.filler.append(piece)
                    self.held += piece[2]
            if self.held < room:
                for piece in bin_:
                    self.filler.append(piece)
                    self.held += piece[2]
                break
            yield from self._close(bin_ + self._take(room))
        while self.held:
            yield from self._close(self._take(1 << (min(self.held, self.capacity).bit_length() - 1)))


def pack(docs: DataFrame, path: str, separator: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs whole documents; one row a piece, with its ids if ``with_ids``.

    The capacity must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    schema = SCHEMA + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def table(placed):
        out = []
        for (document, start, length), sequence, offset in placed:
            doc_id, ids = document
            own = ids[start : start + length]
            out.append((doc_id, start, length, zlib.crc32(own), len(ids), sequence, offset) + (own,) * with_ids)
        columns = list(zip(*out)) or [[]] * len(names)
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        vocabulary, packer = bpe.load(path), Packer(TaskContext.get().partitionId(), capacity)
        out: list[tuple] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids in bpe.encoded(batch.column(1), vocabulary):
                ids = np.append(ids, separator).astype("<u4")
                for piece in packer.add((doc_ids[row], ids), len(ids)):
                    out.append(piece)
                    if len(out) >= FLUSH_ROWS:
                        yield table(out)
                        out = []
        for piece in packer.rest():
            out.append(piece)
            if len(out) >= FLUSH_ROWS:
                yield table(out)
                out = []
        yield table(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
