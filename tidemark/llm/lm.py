"""Language-model scores of whole documents: a gated recurrent network in numpy.

Tokens are lower-cased words, then one end.  The corpus pass counts every token
of all training documents; the counts stay distributed.  A head of at most
``HEAD`` words, those above a count threshold, is the only part that is
broadcast.  The network reads and predicts the ``WORDS`` most frequent tokens;
the output softmax is factored into classes.  Rarer words form classes by
frequency band, the rest of the vocabulary and all unknown words one more;
within those a word has its unigram share.

    P(token) = base(token) * (MIX * P_gru(token) / base(token) + 1 - MIX)

so a document's score is its base score plus a gain that needs the network and
the head only.  The base scores of rare words come from the distributed counts,
asked for by hash.

Texts are tokenised twice: to count, and to be encoded into a saved table of two
bytes a token, which training and scoring read, and the hashes of rare words.

Training is truncated backpropagation over every token of every training
document, from its first to its last with the state carried from window to
window.  The documents are dealt by hash to one learner for each
``LEARNER_TOKENS`` tokens of the corpus and to rounds of growing ``SHARES``;
the learners of a round start from the same parameters, which are averaged
after it.  So the model depends on the corpus, not on its partitions.  Scoring
runs each document through in the same way.

Defined results: a null or empty text is the end token alone; repeated rows are
counted and scored each; without any training token every count is 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting, routing, scratch
from tidemark.llm import text as tx

MODULUS = 5
HEAD = 65_536
WORDS, CLASS_SIZE = 1024, 32
CLASSES = WORDS // CLASS_SIZE
BANDS = (WORDS, 4096, 16_384, HEAD)
OUTPUTS = CLASSES + len(BANDS)  # word classes, bands of the head, the rest
START = WORDS + len(BANDS)
HIDDEN = 24
MIX = 0.95
WINDOW = 16
#: Training tokens of a learner in all rounds; each round's share of the documents in 16ths and its rate.
LEARNER_TOKENS = 2_000_000
SHARES, RATES = (2, 2, 4, 8), (0.02, 0.015, 0.01, 0.005)
TRAIN_LANES, SCORE_LANES = 256, 512
FLUSH_TOKENS, TRAIN_TOKENS = 1_000_000, 250_000
BLOCKS = 256
END = np.uint64(0x2545F4914F6CDD1D)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each row among them, and each row's first token."""
    buf = tx.lowered(buf)
    starts, ends, first = tx.word_spans(buf, offs)
    rows = len(offs) - 1
    at = first + np.arange(rows + 1)
    out = np.empty(len(starts) + rows, np.uint64)
    word = np.ones(len(out), bool)
    word[at[1:] - 1] = False
    out[word] = tx.span_hash(buf, starts, ends)
    out[~word] = END
    return out, at


def _sum_pairs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    start, _ = tx.runs(keys[order])
    return keys[order][start], np.add.reduceat(values[order], start) if len(start) else values[:0]


def counts(docs: DataFrame, parts: int) -> DataFrame:
    """A saved table of one row for each part: its token hashes, sorted, and their counts."""

    def split(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return routing.routed(routing.part_of(h, parts), 0, [h, c], lambda x: [x[0].astype("<u8"), *routing.small(x[1], False)])

        for batch in batches:
            for _, _, buf, offs in tx.chunks(batch.column(0)):
                held.append(tokens(buf, offs)[0])
                n += len(held[-1])
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merge(batches):
        h, c, part = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            got = [routing.load(x.as_buffer()) for x in batch.column(2)]
            h, c = _sum_pairs(np.concatenate([h, *(a[0] for a in got)]), np.concatenate([c, *(routing.large(a[1], a[2]) for a in got)]))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([routing.dump([h, c])], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["part", "kind", "data", "distinct", "total"])

    packed = docs.select("text").mapInArrow(split, routing.SCHEMA)
    return scratch.saved(routing.exchange(packed, parts).mapInArrow(merge, routing.SCHEMA + ", distinct long, total long"))


def _bin(c: np.ndarray) -> np.ndarray:
    """Counts down to two leading binary digits more than the first: a few hundred values."""
    shift = np.maximum(np.frexp(c.astype(float))[1] - 3, 0)
    return (c >> shift) << shift


def head(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the tokens whose count is above a threshold that at most HEAD reach."""

    def histogram(batches):
        for batch in batches:
            for x in batch.column(0):
                v, n = np.unique(_bin(routing.load(x.as_buffer())[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["value", "n"])

    bins = table.select("data").mapInArrow(histogram, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    total, least = 0, 1 << 62
    for value, n in sorted(((r.value, r.n) for r in bins), reverse=True):
        total += n
        if total > HEAD - 1:
            break
        least = value

    def above(batches):
        for batch in batches:
            for x in batch.column(0):
                h, c = routing.load(x.as_buffer())
                pick = (_bin(c) >= least) & (h != END)
                yield pa.RecordBatch.from_arrays([pa.array(h[pick].astype(np.int64)), pa.array(c[pick])], ["h", "c"])
                if (h == END).any():
                    yield pa.RecordBatch.from_arrays([pa.array([int(END.astype(np.int64))], pa.int64()), pa.array(c[h == END], pa.int64())], ["h", "c"])

    got = table.select("data").mapInArrow(above, "h long, c long").toPandas()
    h, c = got["h"].to_numpy(np.int64).astype(np.uint64), got["c"].to_numpy(np.int64)
    if not (h == END).any():
        h, c = np.r_[h, END], np.r_[c, 0]
    order = np.lexsort((h, -c, h != END))  # the end first, then by count
    return h[order], c[order]


class Unigrams:
    """The head with the base probabilities of its words and the masses of the output classes."""

    def __init__(self, hashes: np.ndarray, c: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.norm = total + 0.5 * (distinct + 1)
        self.hashes, self.smoothed = hashes, c + 0.5
        self.known = c > 0
        rank = np.arange(len(c))
        group = np.where(rank < WORDS, rank // CLASS_SIZE, CLASSES + np.searchsorted(BANDS[1:], rank, "right"))
        self.mass = np.bincount(group, self.smoothed, OUTPUTS)
        self.mass[-1] += max(self.norm - self.smoothed.sum(), 0.5)
        self.word_mass = np.zeros(WORDS)
        self.word_mass[: min(WORDS, len(c))] = self.smoothed[:WORDS]
        # what the network reads for a rank; the last entry serves rank -1
        self.symbol = np.r_[np.where(rank < WORDS, rank, WORDS + group - CLASSES), WORDS + len(BANDS) - 1].astype(np.uint16)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not hasattr(self, "table"):
            self.table = tx.HashTable(17)
            self.table.put(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        return self.table.get(h)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def scores_only(self) -> Unigrams:
        """Without the head, for tasks that read symbols."""
        out = object.__new__(Unigrams)
        out.norm, out.mass, out.word_mass = self.norm, self.mass, self.word_mass
        return out


def _targets(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output class of each symbol and the word's place in it, -1 outside word classes."""
    inside = symbol < WORDS
    return np.where(inside, symbol // CLASS_SIZE, CLASSES + symbol - WORDS), np.where(inside, symbol % CLASS_SIZE, -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _side_by_side(a: np.ndarray) -> np.ndarray:
    """[..., windows * WINDOW, lanes] as [..., WINDOW, windows * lanes]."""
    a = a.reshape(*a.shape[:-2], -1, WINDOW, a.shape[-1])
    return np.ascontiguousarray(a.swapaxes(-3, -2)).reshape(*a.shape[:-3], WINDOW, -1)


class Network:
    """One gated recurrent layer; inputs are table rows, the output is class times word."""

    SHAPES = {"embed": (START + 1, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "out": (HIDDEN, OUTPUTS), "out_bias": (OUTPUTS,), "word": (CLASSES, HIDDEN, CLASS_SIZE), "word_bias": (CLASSES, CLASS_SIZE)}

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.m = None

    @classmethod
    def start(cls, base: Unigrams, seed: int = 11) -> Network:
        """Small random weights; the biases give the unigram probabilities."""
        rng = np.random.default_rng(seed)
        p = {k: (rng.normal(0, 0.1, s) if k not in ("out_bias", "word_bias") else np.zeros(s)).astype(np.float32) for k, s in cls.SHAPES.items()}
        p["out_bias"][:] = np.log(np.maximum(base.mass, 1e-3) / base.norm)
        words = np.log(np.maximum(base.word_mass, 1e-3)).reshape(CLASSES, CLASS_SIZE)
        p["word_bias"][:] = words - words.max(axis=1, keepdims=True)
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def unflat(cls, values: np.ndarray) -> Network:
        p, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            p[k] = values[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(p)

    def run(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool = False):
        """States [HIDDEN, steps, lanes] of inputs x, from state h [HIDDEN, lanes]; with what backpropagation needs.

        Lanes run along memory, so that gates are whole blocks of it.
        """
        u = np.ascontiguousarray(self.p["recur"].T)
        steps, lanes = x.shape
        a = np.ascontiguousarray(self.p["embed"][x.ravel()].T).reshape(3 * HIDDEN, steps, lanes)
        states = np.empty((HIDDEN, steps, lanes), np.float32)
        some = reset.any(axis=1)
        saved = []
        for t in range(steps):
            if some[t]:
                h = np.where(reset[t], np.float32(0), h)
            b = u @ h
            zr = b[: 2 * HIDDEN] + a[: 2 * HIDDEN, t]
            _sigmoid(zr)
            z, r, c = zr[:HIDDEN], zr[HIDDEN:], b[2 * HIDDEN :]
            n = r * c
            n += a[2 * HIDDEN :, t]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep:
                saved.append((h, z, r, c, n))
            states[:, t] = h = new
        return states, h, saved

    def _logits(self, name: str, columns: np.ndarray, k=...) -> np.ndarray:
        """Shifted so that their exponentials are finite; states are within -1 and 1, which bounds them."""
        w, b = self.p[name][k], self.p[name + "_bias"][k]
        logit = w.T @ columns
        logit += b[:, None]
        if np.abs(w).sum(axis=0).max() + np.abs(b).max() > 60:
            logit -= logit.max(axis=0)
        return logit

    def outputs(self, columns: np.ndarray, group: np.ndarray, word: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of the class and of the word in it; word is -1 outside word classes.

        columns: [HIDDEN, n], a state each, so that sums over the outputs run
        along memory.  With ``grads``, adds to it and returns also the gradient of the states.
        """
        logit = self._logits("out", columns)
        line = np.arange(columns.shape[1])
        logp = logit[group, line]
        exp = np.exp(logit, out=logit)
        total = exp.sum(axis=0)
        logp -= np.log(total)
        ds = None
        if grads is not None:
            exp /= total
            exp[group, line] -= 1
            grads["out"] += columns @ exp.T
            grads["out_bias"] += exp.sum(axis=1)
            ds = self.p["out"] @ exp
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cut = np.searchsorted(group[order], np.arange(CLASSES + 1))
        columns, inside = columns[:, order[: cut[-1]]], np.empty((HIDDEN, cut[-1]), np.float32)
        for k in range(CLASSES):
            a, b = cut[k], cut[k + 1]
            if a == b:
                continue
            i, own = order[a:b], columns[:, a:b]
            logit = self._logits("word", own, k)
            at = word[i], np.arange(b - a)
            logp[i] += logit[at]
            exp = np.exp(logit, out=logit)
            total = exp.sum(axis=0)
            logp[i] -= np.log(total)
            if grads is not None:
                exp /= total
                exp[at] -= 1
                grads["word"][k] += own @ exp.T
                grads["word_bias"][k] += exp.sum(axis=1)
                inside[:, a:b] = self.p["word"][k] @ exp
        if grads is not None:
            ds[:, order[: cut[-1]]] += inside
        return logp, ds

    def learn(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, group: np.ndarray, word: np.ndarray, rate: float, real: np.ndarray | None = None) -> np.ndarray:
        """One truncated window: forward, backward, an Adam step; returns the state to carry on.

        More steps than WINDOW are several whole windows one after the other: the
        state runs on through all, backpropagation stops at each window's start, so
        that they go back side by side, with one Adam step.  Places that are not
        ``real`` pad the ends of lanes and have no loss.
        """
        states, last, saved = self.run(x, reset, h, keep=True)
        if len(x) > WINDOW:
            x, reset, group, word, states = (_side_by_side(v) for v in (x, reset, group, word, states))
            real = None if real is None else _side_by_side(real)
            saved = [tuple(np.concatenate(v, axis=1) for v in zip(*saved[t::WINDOW])) for t in range(WINDOW)]
        steps, lanes = x.shape
        grads = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        states = states.reshape(HIDDEN, -1)
        if real is None or real.all():
            count, ds = x.size, self.outputs(states, group.ravel(), word.ravel(), grads)[1]
        else:
            flat = np.flatnonzero(real)
            count, ds = len(flat), np.zeros((HIDDEN, x.size), np.float32)
            ds[:, flat] = self.outputs(states[:, flat], group.ravel()[flat], word.ravel()[flat], grads)[1]
        ds = ds.reshape(HIDDEN, steps, lanes)
        u = self.p["recur"]
        carry = np.zeros((HIDDEN, lanes), np.float32)
        dx, back = (np.empty((3 * HIDDEN, steps, lanes), np.float32) for _ in range(2))
        some = reset.any(axis=1)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, n = saved[t]
            d = ds[:, t] + carry
            dz = before - n
            dz *= d
            dz *= z
            carry = d * z
            d -= carry
            dz -= dz * z
            n *= n
            np.subtract(1, n, out=n)
            d *= n
            through = d * r
            c *= through
            r *= c
            c -= r
            own = np.concatenate([dz, c, through])
            dx[: 2 * HIDDEN, t], dx[2 * HIDDEN :, t], back[:, t] = own[: 2 * HIDDEN], d, own
            carry += u @ own
            if some[t]:
                carry *= ~reset[t]
        grads["recur"] += np.concatenate([v[0] for v in saved], axis=1) @ back.reshape(3 * HIDDEN, -1).T
        dx = np.ascontiguousarray(dx.reshape(3 * HIDDEN, -1).T)
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        start, _ = tx.runs(x.ravel()[order])
        grads["embed"][x.ravel()[order][start]] = np.add.reduceat(dx[order], start, axis=0)
        self._adam(grads, count, rate)
        return last

    def _adam(self, grads: dict, n: int, rate: float) -> None:
        if self.m is None:
            self.m, self.v, self.t = ({k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()} for _ in range(2)), None, 0
            self.m, self.v = self.m
        self.t += 1
        step = np.float32(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            g /= np.float32(n)
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.p[k] -= step * m / (np.sqrt(v) + np.float32(1e-7))


class Lanes:
    """Training documents in lanes side by side, each whole in one lane; the network learns window by window.

    What a lane holds beyond the shortest one waits for more documents, so that
    windows are full until ``finish``.  ``done`` counts the tokens trained on.
    """

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.done = net, rate, 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(TRAIN_LANES)]
        self.size = np.zeros(TRAIN_LANES, np.int64)
        self.state = np.zeros((HIDDEN, TRAIN_LANES), np.float32)

    def add(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """Symbols of documents that begin at ``at``; longest first to the shortest lane."""
        lengths = np.diff(at)
        y = symbols.astype(np.int64)
        first = np.zeros(len(y), bool)
        first[at[:-1]] = True
        x = np.where(first, START, np.r_[START, y[:-1]])
        both = np.column_stack([x, y, first])
        heap = [(int(n), k) for k, n in enumerate(self.size)]
        heapq.heapify(heap)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n, k = heap[0]
            self.held[k].append(both[at[i] : at[i + 1]])
            heapq.heapreplace(heap, (n + int(lengths[i]), k))
        for n, k in heap:
            self.size[k] = n

    def learn(self) -> None:
        """Whole windows of all lanes, as far as the shortest goes."""
        self._run(int(self.size.min()) // WINDOW * WINDOW)

    def finish(self) -> None:
        """All that is left."""
        self._run(int(self.size.max()))

    def _run(self, stop: int) -> None:
        if not stop:
            return
        order = np.argsort(-self.size, kind="stable")
        size = self.size[order]
        offset = np.cumsum(size) - size
        flat = np.concatenate([v for k in order for v in self.held[k]])
        x, y, first = flat[:, 0], flat[:, 1], flat[:, 2].astype(bool)
        group, word = _targets(y)
        h = self.state[:, order]
        t = 0
        while t < stop:
            live = int(np.searchsorted(-size, -t, "left"))
            # the few lanes that long documents leave take several windows at once
            windows = min(max(TRAIN_LANES // live, 1), -(-(stop - t) // WINDOW))
            steps = windows * WINDOW if windows > 1 else min(WINDOW, stop - t)
            step = (t + np.arange(steps))[:, None]
            real = step < size[:live]
            t += steps
            place = np.where(real, offset[:live] + step, 0)
            n = int(real.sum())
            # few tokens give a noisy gradient and a smaller step
            rate = self.rate * float(np.sqrt(n / (TRAIN_LANES * WINDOW)))
            h[:, :live] = self.net.learn(np.where(real, x[place], START), first[place] & real, h[:, :live], group[place], word[place], rate, real)
            self.done += n
        self.state[:, order] = h
        for k, a, b in zip(order.tolist(), (offset + np.minimum(size, stop)).tolist(), (offset + size).tolist()):
            self.held[k] = [flat[a:b]] if b > a else []
        self.size[order] = size - np.minimum(size, stop)


def train(rows: DataFrame, learners: int, network: Network, rate: float) -> Network:
    """The average of the networks that the learners train on all their documents, weighted by tokens.

    rows: learner, row_key, symbols.  A learner's documents come in order of
    their keys, so that the same corpus gives the same network.
    """
    spark = rows.sparkSession
    flat = network.flat()
    shared = spark.sparkContext.broadcast(flat)
    size = -(-len(flat) // BLOCKS)

    def result(learner: int, lanes: Lanes) -> pa.RecordBatch:
        lanes.finish()
        values = np.zeros(size * BLOCKS, np.float32)
        values[: len(flat)] = lanes.net.flat() * np.float32(lanes.done)
        columns = [pa.array(range(BLOCKS), pa.int32()), pa.array([learner] * BLOCKS, pa.int32()), pa.array([lanes.done] * BLOCKS, pa.int64()), pa.array([b.tobytes() for b in values.reshape(BLOCKS, size)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "learner", "tokens", "sums"])

    def run(batches):
        learner, lanes, n = None, None, 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            start, size_ = tx.runs(own)
            for a, k in zip(start.tolist(), size_.tolist()):
                if own[a] != learner:
                    if lanes is not None:
                        yield result(learner, lanes)
                    learner, lanes, n = int(own[a]), Lanes(Network.unflat(shared.value), rate), 0
                for _, _, buf, offs in tx.chunks(batch.column(1).slice(a, k)):
                    lanes.add(np.frombuffer(buf.tobytes(), "<u2"), offs // 2)
                    n += len(buf) // 2
                    if n >= TRAIN_TOKENS:
                        lanes.learn()
                        n = 0
        if lanes is not None:
            yield result(learner, lanes)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(k.as_py(), n.as_py(), np.frombuffer(x.as_buffer(), np.float32)) for b in batches for k, n, x in zip(b.column(1), b.column(2), b.column(3))]
        total, n = np.zeros(size), 0
        for _, tokens_, sums in sorted(got, key=lambda x: x[0]):
            total += sums
            n += tokens_
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "tokens", "sums"])

    dealt = rows.select("learner", "symbols", "row_key").repartitionById(learners, "learner").sortWithinPartitions("learner", "row_key").select("learner", "symbols")
    trained = dealt.mapInArrow(run, "block int, learner int, tokens long, sums binary")
    got = trained.groupBy("block").applyInArrow(add, "block int, tokens long, sums binary").collect()
    shared.unpersist()
    if not got:
        return network
    values = np.concatenate([np.frombuffer(r.sums, np.float64) / r.tokens for r in sorted(got, key=lambda r: r.block)])
    return Network.unflat(values[: len(flat)])


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents by lane, longest first to the shortest lane; lanes by falling length."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + int(lengths[i]), k))
    size = {k: n for n, k in heap}
    return [out[k] for k in sorted(size, key=lambda k: -size[k])]


def gains(network: Network, base: Unigrams, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each document, the sum over its tokens of log10 P(token) / base(token)."""
    lengths = np.diff(at)
    plan = _lanes(lengths, SCORE_LANES)
    order = np.concatenate([np.array(x, np.int64) for x in plan]) if len(lengths) else np.zeros(0, np.int64)
    y = symbols[tx.ranges(at[:-1][order], lengths[order])].astype(np.int64)
    doc = np.repeat(order, lengths[order])
    first = np.zeros(len(y), bool)
    first[np.cumsum(lengths[order]) - lengths[order]] = True
    x = np.where(first, START, np.r_[START, y[:-1]] if len(y) else y)
    group, word = _targets(y)
    log_base = np.log(np.where(word >= 0, base.word_mass[np.minimum(y, WORDS - 1)], base.mass[group]) / base.norm)
    size = np.array([int(lengths[p].sum()) for p in plan])
    offset = np.cumsum(size) - size
    out = np.zeros(len(lengths))
    h = np.zeros((HIDDEN, len(plan)), np.float32)
    t = 0
    while t < (int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        # about as many tokens at once where few lanes are left
        steps = min(32 * max(SCORE_LANES // live, 1), int(size[0]) - t)
        place = offset[:live] + t + np.arange(steps)[:, None]
        real = (t + np.arange(steps)[:, None]) < size[:live]
        place = np.where(real, place, 0)
        states, h, _ = network.run(x[place], first[place] & real, h[:, :live])
        flat = np.flatnonzero(real)
        place = place.ravel()[flat]
        logp, _ = network.outputs(states.reshape(HIDDEN, -1)[:, flat], group[place], word[place])
        gain = np.logaddexp(np.log(MIX) + logp.astype(float) - log_base[place], np.log(1 - MIX)) / np.log(10)
        out += np.bincount(doc[place], gain, len(lengths))
        t += steps
    return out


def encoded(rows: DataFrame, base: Unigrams, learners: int) -> DataFrame:
    """A saved table of one row for each row: what training, scoring and the rare words need.

    row_key, doc_id, held_out, learner, slot (of 16, for the rounds), n_tokens, n_head (known head
    tokens), head_log (their sum), symbols (two bytes a token), rare (hashes of the other tokens).
    """
    shared = rows.sparkSession.sparkContext.broadcast(base)
    schema = "row_key long, doc_id long, held_out boolean, learner int, slot int, n_tokens long, n_head long, head_log double, symbols binary, rare binary"

    def run(batches):
        base = shared.value
        for batch in batches:
            for i, j, buf, offs in tx.chunks(batch.column(5)):
                h, at = tokens(buf, offs)
                sizes = np.diff(at)
                rank = base.ranks(h)
                inside = rank >= 0
                doc = np.repeat(np.arange(j - i), sizes)
                known = np.bincount(doc[inside], base.known[rank[inside]], j - i).astype(np.int64)
                logs = np.bincount(doc[inside], np.log10(base.smoothed[rank[inside]]), j - i)
                far = np.r_[0, np.cumsum(np.bincount(doc[~inside], minlength=j - i))]
                columns = [pa.array(sizes, pa.int64()), pa.array(known), pa.array(logs), tx.binaries(base.symbol[rank], at), tx.binaries(h[~inside], far)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:5]), *columns], names)

    names = [x.split()[0] for x in schema.split(", ")]
    learner = F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(learners)).cast("int").alias("learner")
    slot = F.pmod(F.xxhash64("row_key", F.lit(2)), F.lit(16)).cast("int").alias("slot")
    return scratch.saved(rows.select("row_key", "doc_id", "held_out", learner, slot, "text").mapInArrow(run, schema))


def scored(rows: DataFrame, base: Unigrams, network: Network) -> DataFrame:
    """row_key, doc_id, n_tokens, n_head, head_log, gain of encoded rows."""
    names = ["row_key", "doc_id", "n_tokens", "n_head", "head_log", "gain"]
    shared = rows.sparkSession.sparkContext.broadcast((base.scores_only(), network.flat()))

    def run(batches):
        base, flat = shared.value
        net = Network.unflat(flat)
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            data = table.column(5).chunk(0)
            buf, offs = tx.text_column(data)
            gain = gains(net, base, np.frombuffer(buf.tobytes(), "<u2"), offs // 2)
            return pa.RecordBatch.from_arrays([*(table.column(k).chunk(0) for k in range(5)), pa.array(gain)], names)

        n = 0
        for batch in batches:
            for i, j, buf, _ in tx.chunks(batch.column(5)):
                held.append(batch.slice(i, j - i))
                n += len(buf) // 2
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    return rows.select(*names[:-1], "symbols").mapInArrow(run, "row_key long, doc_id long, n_tokens long, n_head long, head_log double, gain double")


def rare(rows: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """row_key, rare_log, n_rare: sum of log10(c + 0.5) and known tokens outside the head, of encoded rows."""

    def ask(batches):
        held, n = [], 0

        def flush():
            h, key = (np.concatenate(x) for x in zip(*held))
            # a word said again and again is asked for once
            start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            times = np.diff(np.r_[start, len(h)]) if len(h) else np.zeros(0, np.int64)
            start = start[: len(h)]
            h, key = h[start], key[start]

            def pack(c):
                run, size = tx.runs(c[1])
                return [c[0].astype("<u8"), c[1][run].astype("<i8"), *routing.small(size, False), *routing.small(c[2], False)]

            return routing.routed(routing.part_of(h, parts), 1, [h, key, times], pack)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in tx.chunks(batch.column(1)):
                held.append((np.frombuffer(buf.tobytes(), "<u8"), np.repeat(keys[i:j], np.diff(offs) // 8)))
                n += len(held[-1][0])
                if n >= FLUSH_TOKENS // 4:
                    yield flush()
                    held, n = [], 0
        if n and held:
            yield flush()

    def back(held):
        key, logs, n = map(np.concatenate, zip(*held))
        return routing.routed(routing.part_of(tx.mix(key.astype(np.uint64)), parts), 0, [key, logs, n], lambda x: [x[0].astype("<i8"), x[1].view("<i8"), *routing.small(x[2], False)])

    def answer(batches):
        held, waiting = [], 0
        known, times_seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                a = routing.load(data.as_buffer())
                if kind == 0:
                    known, times_seen = a
                    continue
                if not len(a[0]):
                    continue
                size, times = routing.large(a[2], a[3]), routing.large(a[4], a[5])
                c = np.zeros(len(a[0]), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, a[0]), len(known) - 1)
                    c = np.where(known[at] == a[0], times_seen[at], 0)
                start = np.cumsum(size) - size
                held.append((a[1], np.add.reduceat(times * np.log10(c + 0.5), start), np.add.reduceat(times * (c > 0), start)))
                waiting += len(a[1])
                if waiting >= FLUSH_TOKENS:
                    yield back(held)
                    held, waiting = [], 0
        if held:
            yield back(held)

    def total(batches):
        got = [routing.load(x.as_buffer()) for batch in batches for x in batch.column(2)]
        if got:
            key, logs, n = (np.concatenate(x) for x in zip(*((a[0], a[1], routing.large(a[2], a[3])) for a in got)))
            order = np.argsort(key, kind="stable")
            start, _ = tx.runs(key[order])
            if len(start):
                yield pa.RecordBatch.from_arrays([pa.array(key[order][start]), pa.array(np.add.reduceat(logs.view(float)[order], start)), pa.array(np.add.reduceat(n[order], start))], ["row_key", "rare_log", "n_rare"])

    asked = rows.select("row_key", "rare").mapInArrow(ask, routing.SCHEMA)
    both = asked.union(table.select("part", "kind", "data"))
    answers = routing.exchange(both, parts).mapInArrow(answer, routing.SCHEMA)
    return routing.exchange(answers, parts).mapInArrow(total, "row_key long, rare_log double, n_rare long")


def score_documents(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row."""
    parts = routing.partitions(docs.sparkSession)
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    held = fitting.held_out(F.col(id_col), MODULUS) if held_out is None else held_out
    rows = docs.select(F.xxhash64(own, text).alias("row_key"), own.alias("doc_id"), text.alias("text"), held.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    table = counts(training, parts)
    sums = table.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = (int(x or 0) for x in sums)
    base = Unigrams(*head(table), total, distinct)
    learners = max(1, -(-total // LEARNER_TOKENS))
    coded = encoded(rows, base, learners)
    network, begin = Network.start(base), 0
    for share, rate in zip(SHARES, RATES):
        # the slots of the rounds make up all documents
        own = ~F.col("held_out") & (F.col("slot") >= begin) & (F.col("slot") < begin + share)
        network = train(coded.where(own), learners, network, rate)
        begin += share
    norm = float(np.log10(base.norm))
    # equal rows have asked together: each gets its share of the answer
    equal = coded.groupBy("row_key").agg(F.count("*").alias("equal")).where("equal > 1")
    asked = rare(coded, table, parts).join(equal, "row_key", "left").withColumn("equal", F.coalesce("equal", F.lit(1)))
    got = scored(coded, base, network).join(asked, "row_key", "left")
    logs = F.col("head_log") + F.coalesce(F.col("rare_log") / F.col("equal"), F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    known = (F.col("n_head") + F.coalesce((F.col("n_rare") / F.col("equal")).cast("long"), F.lit(0))).cast("long")
    held = fitting.held_out(F.col("doc_id"), MODULUS)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), logs.alias("base_score"), (logs + F.col("gain")).alias("score"))
