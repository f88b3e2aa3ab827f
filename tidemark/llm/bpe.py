"""Byte-level BPE: encoding and decoding of whole texts with numpy.

Texts are cut into pieces by a vectorised form of the public splitting pattern.
A piece seen before is looked up by its 64-bit hash; the distinct new pieces of
a chunk are merged together in matrices, one for each length: in each round
every row merges its leftmost pair of least rank, which is found in a hash
table of pairs, and the rows are compacted to one column less.

Defined results: a null or empty text has no ids and decodes to nothing; ties
of rank go to the leftmost pair; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

#: White space of Unicode (property White_Space).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
LONG_PIECE = 1024
CACHE_PIECES = 2_000_000
NO_RANK = np.int32(2**31 - 1)

_classes: np.ndarray | None = None


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy twice as long, so that it holds n values."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def char_classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _classes[list(WHITE_SPACE)] = SPACE
    return _classes


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    out = table[buf]
    for low, high, extra, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        lead = np.flatnonzero((buf >= low) & (buf < high))
        lead = lead[lead + extra < len(buf)]
        if not len(lead):
            continue
        point = (buf[lead] & mask).astype(np.int64)
        for k in range(1, extra + 1):
            point = (point << 6) | (buf[lead + k] & 0x3F)
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(extra + 1):
            out[lead + k] = kind
    return out


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the matches of the splitting pattern start, in all texts of a chunk."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(buf)
    head = np.zeros(n + 1, bool)  # first bytes of texts, and the end
    head[offs] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(start)
    first, after = at[:-1], at[1:]  # runs of one class
    # white space: its last character is a piece, or goes to the next one if it is U+0020
    space = (kind[first] == SPACE) & ~head[after]
    a, b = first[space], after[space]
    plain = buf[b - 1] == 0x20
    start[b[plain]] = False
    last = b - 1
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    # contractions: an apostrophe of its own, no space before, then s t re ve m ll d
    q = first[(after - first == 1) & (buf[first] == 0x27)]
    if len(q):
        q = q[start[q] & (q + 1 < n)]
        q = q[~head[q + 1] & (kind[q + 1] == LETTER)]
        c1 = buf[q + 1]
        two = np.minimum(q + 2, n - 1)
        c2 = np.where((q + 2 < n) & ~head[np.minimum(q + 2, n)], buf[two], 0)
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        pair = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for hit, size in ((q[one], 1), (q[pair], 2)):
            start[hit + 1] = False
            start[hit + 1 + size] = True
    return np.flatnonzero(start[:n])


class Vocabulary:
    """Merges of a byte-level BPE: pairs of ids with their rank and result."""

    def __init__(self, tokens: dict[int, bytes], single: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray, whole: bool, special: dict[bytes, int] | None = None):
        self.single, self.whole, self.special = single, whole, special or {}
        keys = self._pair(left, right)
        self.pairs = tx.HashTable(18)
        self.pairs.put(keys, np.arange(len(keys), dtype=np.int32))
        self.merged = merged.astype(np.int32)
        self.pair_at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(left, right))}
        self.size = max(tokens) + 1
        parts = [tokens.get(i, b"") for i in range(self.size)]
        self.token_lens = np.fromiter(map(len, parts), np.int64, self.size)
        self.token_offs = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.ids = {v: k for k, v in tokens.items()}
        self.clear()

    def clear(self) -> None:
        """Forgets the pieces seen so far."""
        self.known = tx.HashTable(18)
        self.lens, self.at, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pieces = self.used = 0
        if self.whole:  # a piece that is itself a token is that token
            lens = self.token_lens
            ids = np.flatnonzero(lens > 0)
            self._remember(tx.span_hash(self.token_bytes, self.token_offs[ids], self.token_offs[ids] + lens[ids]), np.ones(len(ids), np.int32), ids.astype(np.int32))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) + np.uint64(1))

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A .tiktoken file: any two tokens whose bytes joined are a token merge, by its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        found = [(r, ranks[t[:k]], ranks[t[k:]]) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found.sort()
        r, a, b = (np.array(x, np.int64) for x in zip(*found))
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        return cls({v: k for k, v in ranks.items()}, single, a, b, r, True)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizers file of a byte-level BPE: the listed merges, in their order."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [i for i in range(256) if i not in set(visible)]
        byte_of = {chr(i): i for i in visible} | {chr(256 + k): i for k, i in enumerate(rest)}
        char_of = {v: k for k, v in byte_of.items()}
        split = [m if isinstance(m, list) else m.split(" ") for m in merges]
        a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in split)))
        tokens = {i: bytes(byte_of[ch] for ch in t) for t, i in vocab.items() if all(ch in byte_of for ch in t)}
        special = {x["content"].encode(): x["id"] for x in data.get("added_tokens") or []}
        tokens |= {i: t for t, i in special.items()}
        return cls(tokens, np.array([vocab[char_of[i]] for i in range(256)], np.int32), a, b, c, False, special)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pairs.get(self._pair(a, b).ravel()).reshape(a.shape)
        return np.where(got < 0, NO_RANK, got)

    def _remember(self, hashes: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> None:
        n, m = self.pieces, self.used
        self.lens = _grown(self.lens, n + len(lens))
        self.at = _grown(self.at, n + len(lens))
        self.flat = _grown(self.flat, m + len(flat))
        self.lens[n : n + len(lens)] = lens
        self.at[n : n + len(lens)] = m + np.cumsum(lens) - lens
        self.flat[m : m + len(flat)] = flat
        self.pieces, self.used = n + len(lens), m + len(flat)
        self.known.put(hashes, np.arange(n, self.pieces, dtype=np.int32))

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids row after row) of pieces of the same number of bytes."""
        ids = self.single[rows]
        n, width = ids.shape
        out_len = np.full(n, 1, np.int32)
        out = np.full((n, width), -1, np.int32)
        who = np.arange(n)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while width > 1 and len(who):
            at = ranks.argmin(axis=1)
            line = np.arange(len(who))
            best = ranks[line, at]
            done = best == NO_RANK
            if done.any():
                out[who[done], :width] = ids[done]
                out_len[who[done]] = width
                go = ~done
                who, ids, ranks, at, best = who[go], ids[go], ranks[go], at[go], best[go]
                line = np.arange(len(who))
                if not len(who):
                    break
            ids[line, at] = self.merged[best]
            keep = np.ones((len(who), width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(who), width - 1)
            width -= 1
            if width == 1:
                break
            keep = np.ones((len(who), width), bool)
            keep[line, np.minimum(at, width - 1)] = False  # the rank of the merged pair goes
            ranks = ranks[keep].reshape(len(who), width - 1)
            for side, ok in ((at - 1, at > 0), (at, at < width - 1)):
                r, s = line[ok], side[ok]
                ranks[r, s] = self._ranks(ids[r, s], ids[r, s + 1])
        if len(who) and width == 1:
            out[who, 0] = ids[:, 0]
            out_len[who] = 1
        return out_len, out[out >= 0]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one very long piece, with a heap of pairs."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_at.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pair_at.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        size = ends - starts
        long = size > LONG_PIECE
        for k in np.flatnonzero(long):
            got = self._merge_long(buf[starts[k] : ends[k]].tobytes())
            self._remember(hashes[k : k + 1], np.array([len(got)], np.int32), got)
        learned = []
        order = np.argsort(size[~long], kind="stable")
        starts, hashes, size = starts[~long][order], hashes[~long][order], size[~long][order]
        for at, n in zip(*tx.runs(size)):
            width = int(size[at])
            rows = buf[starts[at : at + n, None] + np.arange(width)]
            learned.append(self._merge_rows(rows))
        if learned:
            self._remember(hashes, *map(np.concatenate, zip(*learned)))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, offsets of each text in them)."""
        starts = piece_starts(buf, offs)
        ends = np.r_[starts[1:], len(buf)]
        hashes = tx.span_hash(buf, starts, ends)
        if self.pieces > CACHE_PIECES:
            self.clear()
        entry = self.known.get(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            some, one = np.unique(hashes[new], return_index=True)
            pick = new[one]
            self._learn(buf, starts[pick], ends[pick], some)
            entry[new] = self.known.get(hashes[new])
        lens = self.lens[entry].astype(np.int64)
        ids = self.flat[tx.ranges(self.at[entry], lens)]
        ends_at = np.r_[0, np.cumsum(lens)]
        return ids, ends_at[np.searchsorted(starts, offs, "left")]

    def encode_special(self, text: bytes) -> np.ndarray:
        """One text, in which the strings of special tokens are those tokens."""
        parts, text = [], text
        while True:
            at, token = min(((p, t) for t in self.special if (p := text.find(t)) >= 0), default=(-1, b""))
            head = np.frombuffer(text if at < 0 else text[:at], np.uint8)
            parts.append(self.encode(head, np.array([0, len(head)]))[0])
            if at < 0:
                return np.concatenate(parts)
            parts.append(np.array([self.special[token]], np.int32))
            text = text[at + len(token) :]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        return self.token_bytes[tx.ranges(self.token_offs[ids], self.token_lens[ids])]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """The vocabulary of a file, once a worker."""
    kind = "ranks" if path.endswith(".tiktoken") else "json"
    if (kind, path) not in _loaded:
        _loaded[kind, path] = Vocabulary.from_ranks(path) if kind == "ranks" else Vocabulary.from_json(path)
    return _loaded[kind, path]


def encoded(column: pa.Array, vocabulary: Vocabulary, budget: int = 2 * tx.CHUNK_BYTES):
    """Yield (row, ids) for each row of a string column."""
    for i, j, buf, offs in tx.chunks(column, budget):
        ids, at = vocabulary.encode(buf, offs)
        odd: set[int] = set()
        if vocabulary.special:
            whole = buf.tobytes()
            if any(t in whole for t in vocabulary.special):
                odd = {k for k in range(j - i) if any(t in whole[offs[k] : offs[k + 1]] for t in vocabulary.special)}
        for k in range(j - i):
            yield i + k, vocabulary.encode_special(whole[offs[k] : offs[k + 1]]) if k in odd else ids[at[k] : at[k + 1]]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int> of each whole text; null text: no ids."""

    def run(batches):
        vocabulary = load(path)
        for batch in batches:
            ids = [x for _, x in encoded(batch.column(1), vocabulary)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), flat)], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded binary; null ids decode to nothing."""

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        vocabulary = load(path)
        return ids.map(lambda x: b"" if x is None else vocabulary.decode(np.asarray(x, np.int64)).tobytes())

    return tokens.select(F.col(id_col), bytes_of(F.col(ids_col)).alias("decoded"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them.

    Encoding and decoding run in one pass, so ids never leave the worker.
    """

    def run(batches):
        vocabulary = load(path)
        for batch in batches:
            n, a, b = [], [], []
            for _, ids in encoded(batch.column(1), vocabulary):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(vocabulary.decode(ids).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
