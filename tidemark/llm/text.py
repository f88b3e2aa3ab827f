"""Numpy kernels over the UTF-8 bytes of whole batches of texts.

A *chunk* is a run of rows of one Arrow batch: ``buf`` holds the bytes of all
its texts one after another, ``offs[i]:offs[i + 1]`` those of row ``i``.  Nulls
have no bytes.  Chunks bound the memory of the kernels below; a single longer
text makes a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Odd multipliers of the polynomial hashes (mod 2**64) and their inverses.
BYTE_BASE = 0x9E3779B97F4A7C15
SEQ_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=np.uint64)
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = got
    return got[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, budget: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) with about ``budget`` bytes."""
    buf, offs = text_column(column)
    n, i = len(column), 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + budget, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values of the bytes of values[at[i]:at[i + 1]]."""
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at, np.int64) * values.itemsize).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    return wide.cast(pa.binary())


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each row's first word.

    The third array has a last entry, so row i has words first[i]:first[i + 1].
    """
    word = np.zeros(len(buf) + 2, bool)
    word[1:-1] = ~_SPACE[buf]
    step = word[1:] != word[:-1]
    # a row's first byte starts a word even when the row before ends in one
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(buf))]
    inner = np.unique(inner)
    glued = inner[word[inner] & word[inner + 1]] if len(inner) else inner
    starts = np.flatnonzero(step & word[1:])
    ends = np.flatnonzero(step & word[:-1])
    if len(glued):
        starts = np.union1d(starts, glued)
        ends = np.union1d(ends, glued)
    return starts, ends, np.searchsorted(starts, offs, "left")


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in one pass over the bytes."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(inverse(BYTE_BASE), n), out=sums[1:])
    got = (sums[ends] - sums[starts]) * powers(BYTE_BASE, n + 1)[starts]
    return mix(got + (ends - starts).astype(np.uint64) * np.uint64(SEQ_BASES[1]))


def seq_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = SEQ_BASES[0]) -> np.ndarray:
    """64-bit hashes of runs values[starts:ends] of 64-bit hashes."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(base)) * powers(inverse(base), n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(base, n + 1)[starts] + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for lengths[0] values, then the next, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(sorted_values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, n])


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` words inside rows, and the row of each."""
    lengths = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1].astype(np.int64), lengths), np.repeat(np.arange(len(lengths)), lengths)


class HashTable:
    """uint64 -> small int, open addressing, all operations on whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BYTE_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where absent.  Key 0 stands for an empty slot."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        slot, mask = self._slot(keys), len(self.keys) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            found = self.keys[slot[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.values[slot[rest[same]]]
            rest = rest[~same & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and absent."""
        while (self.size + len(keys)) * 2 > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self.bits += 1
            self.keys, self.values, self.size = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
            self._place(k, v)
        self._place(np.where(keys == 0, np.uint64(1), keys), values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, mask = self._slot(keys), len(self.keys) - 1
        rest = np.arange(len(keys))
        self.size += len(keys)
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            win = free[one]
            self.keys[slot[win]] = keys[win]
            self.values[slot[win]] = values[win]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & mask
