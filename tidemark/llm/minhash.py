"""Near-duplicate documents by MinHash with tensored banding.

The signature of a document is two small collections of groups of two minhash
values.  A table's key joins a group of the first collection with one of the
second, so ``GROUPS`` ** 2 tables of four values each come from ``4 * GROUPS``
minhash functions.  A pair of similarity s misses all tables only if it misses
all groups of a collection: at s = 0.8 with ten groups a side that is below
2 * 0.36 ** 10, 1 in 13,000, and 1 in 30 million at 0.9.

Documents with equal shingle sets are one class; all work is on classes.  A
table's bucket is linked as a star: each member with the member of least id.
Candidates are confirmed on the full shingle sets.  Where the members of a
bucket are still in several components, each is tried with the bucket's most
central member; then all pairs between components are looked at: signatures are
compared in numpy, bucket by bucket (large buckets in blocks, without those
inside the largest component), and the pairs that may be links are confirmed too.  No bucket is capped.

Defined results: words are lower-cased (A-Z); texts of fewer words than a
shingle have one shingle, texts without words none, and those link with
nothing; repeated rows are in one class; rows of a null id link nothing and
have a null component.  Sets are told apart by 64 hash bits, shingles too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components, routing, scratch
from tidemark.llm import text as tx

SHINGLE = 4
PERCENT = 80
GROUPS = 10
HASHES = 4 * GROUPS
FLUSH_KEYS = 2_000_000
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Agreeing minhash values below which a pair of similarity 0.8 is (1 in 100,000) unlikely.
LEAST_AGREED = 21

_SEEDS = tx.mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_FACTORS = tx.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    buf = tx.lowered(buf)
    starts, ends, first = tx.word_spans(buf, offs)
    words = tx.span_hash(buf, starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = tx.ranges(first[:-1].astype(np.int64), count)
    h = tx.seq_hash(words, at, at + np.repeat(np.minimum(n, size), count))
    cut = np.r_[0, np.cumsum(count)]
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def signature(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """[rows, HASHES] least 32-bit values of runs of ``flat`` that begin at ``start``."""
    out = np.empty((len(start), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat ^ _SEEDS[k]) * _FACTORS[k]) >> np.uint64(32), start)
    return out


def set_hash(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    return tx.mix(np.add.reduceat(tx.mix(flat ^ np.uint64(tx.BYTE_BASE)), start))


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, cid (hash of the shingle set), sketch (its minhash values)."""

    def run(batches):
        for batch in batches:
            n, cid, sketch = [], [], []
            for _, _, buf, offs in tx.chunks(batch.column(1)):
                sets = shingles(buf, offs, size)
                lens = np.array([len(s) for s in sets], np.int64)
                n.append(lens)
                some = np.flatnonzero(lens)
                ids, values = np.zeros(len(sets), np.int64), [b""] * len(sets)
                if len(some):
                    flat = np.concatenate(sets)
                    start = (np.cumsum(lens) - lens)[some]
                    ids[some] = set_hash(flat, start).astype(np.int64)
                    for i, s in zip(some.tolist(), signature(flat, start)):
                        values[i] = s.tobytes()
                cid.append(ids)
                sketch += values
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n, cid)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(sketch, pa.binary())], ["doc_id", "n", "cid", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, cid long, sketch binary")


def _keys(sketch: np.ndarray) -> np.ndarray:
    """[rows, GROUPS ** 2] table keys: each pair of a group of the first and of the second collection."""
    pair = (sketch[:, 0::2].astype(np.uint64) << np.uint64(32)) | sketch[:, 1::2]
    left, right = tx.mix(pair[:, :GROUPS]), tx.mix(pair[:, GROUPS:] ^ np.uint64(tx.SEQ_BASES[0]))
    number = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS) * np.uint64(tx.BYTE_BASE)
    return tx.mix(left[:, :, None] + right[:, None, :] * np.uint64(tx.SEQ_BASES[1]) + number).reshape(len(sketch), -1)


def _stars(key: np.ndarray, cid: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, cid, least cid of the bucket, size of the bucket) sorted by key; singles left in.

    An entry counts for as many members as it ``stands`` for.
    """
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    start, n = tx.runs(key)
    size = np.add.reduceat(stands[order], start) if len(start) else n
    return key, cid, np.repeat(cid[start], n), np.repeat(size, n)


def _buckets(key, cid, least, n) -> pa.RecordBatch:
    pick = (cid != least) | (n > 2)
    return pa.RecordBatch.from_arrays([pa.array(key[pick].astype(np.int64)), pa.array(cid[pick]), pa.array(least[pick]), pa.array(n[pick] > 2)], ["bucket", "id", "star", "many"])


BUCKETS = "bucket long, id long, star long, many boolean"


def buckets(classes: DataFrame, parts: int) -> DataFrame:
    """(bucket, id, star, many): members of buckets of two classes or more.

    A key that many classes of one batch share is settled in the batch: its
    members come out there, and only its least id goes on to meet the others,
    with their number, so that who meets it knows of many.
    """

    def flush(cids, sketches):
        cid = np.concatenate(cids)
        keys = _keys(np.concatenate(sketches))
        key, cid, least, n = _stars(keys.ravel(), np.repeat(cid, keys.shape[1]), np.ones(keys.size, np.int64))
        local = n > 16
        if local.any():
            pick = local
            order = [key[pick].astype("<u8"), cid[pick].astype("<i8"), least[pick].astype("<i8"), n[pick].astype("<i8")]
            yield routing.routed(np.full(int(pick.sum()), int(routing.part_of(key[pick][:1], parts)[0])), 1, order, lambda c: c)
            on = local & (cid == least)
            yield routing.routed(routing.part_of(key[on], parts), 2, [key[on], cid[on], n[on]], lambda c: [c[0].astype("<u8"), c[1].astype("<i8"), c[2].astype("<i8")])
        on = ~local
        yield routing.routed(routing.part_of(key[on], parts), 0, [key[on], cid[on]], lambda c: [c[0].astype("<u8"), c[1].astype("<i8")])

    def split(batches):
        cids, sketches, total = [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            cids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sketches.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES))
            total += len(cids[-1]) * GROUPS * GROUPS
            if total >= FLUSH_KEYS:
                yield from flush(cids, sketches)
                cids, sketches, total = [], [], 0
        if total:
            yield from flush(cids, sketches)

    def meet(batches):
        keys, cids, stands = [], [], []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                a = routing.load(data.as_buffer())
                if kind == 1:
                    yield _buckets(*a)
                else:
                    keys.append(a[0])
                    cids.append(a[1])
                    stands.append(a[2] if kind == 2 else np.ones(len(a[0]), np.int64))
        if keys:
            key, cid, least, n = _stars(*map(np.concatenate, (keys, cids, stands)))
            # one entry alone has met nobody here
            _, met = tx.runs(key)
            several = np.repeat(met, met) > 1
            yield _buckets(key[several], cid[several], least[several], n[several])

    # small inputs, so that a task's memory does not follow the batch size
    packed = classes.select("cid", "sketch").mapInArrow(split, routing.SCHEMA)
    return routing.exchange(packed, parts).mapInArrow(meet, BUCKETS)


def full_sets(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(cid, shingles): the sorted shingle hashes of the classes in ``pairs``, a saved table."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.select("cid", "rep").join(needed, "cid", "left_semi")

    def full(batches):
        for batch in batches:
            cids = batch.column(0).to_numpy(zero_copy_only=False)
            ids, data = [], []
            for i, j, buf, offs in tx.chunks(batch.column(1)):
                for c, s in zip(cids[i:j].tolist(), shingles(buf, offs, size)):
                    # an id may have several texts; only that of the class counts
                    if len(s) and int(set_hash(s, np.zeros(1, np.int64))[0].astype(np.int64)) == c:
                        ids.append(c)
                        data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["cid", "shingles"])

    sets = texts.join(wanted, texts.doc_id == wanted.rep).select("cid", "text").mapInArrow(full, "cid long, shingles binary")
    return scratch.saved(sets.dropDuplicates(["cid"]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough, a saved table."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))

    def check(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(big):
                    continue
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                same = int((big[at] == small).sum())
                ok[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return scratch.saved(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct unordered pairs, the larger id first."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    some = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], ["a", "b"])


def _grouped(batches, names: int):
    """Whole groups of rows with equal first columns, from batches sorted by them."""
    name, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(names)])
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for a, b in zip(cut, [*cut[1:], len(key)]):
            if name is not None and name != tuple(key[a]):
                yield name, held
                held = []
            name = tuple(key[a])
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield name, held


def _long(held, k: int) -> np.ndarray:
    return np.concatenate([h.column(k).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)


def _sketches(held, k: int, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for h in held for x in h.column(k)), dtype).reshape(-1, width)


def _mixed(inside: DataFrame) -> DataFrame:
    """The buckets whose members are in several components, with the largest of these as ``major``.

    A saved table, so that Spark may broadcast it, or split a hot bucket in the joins with it.
    """
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("load"))
    most = F.max(F.struct("size", "component"))
    found = parts.groupBy("bucket").agg(most["component"].alias("major"), F.count("*").alias("several"), F.sum("size").alias("size"), F.sum("load").alias("load"), most["size"].alias("major_size"), F.max_by("load", F.struct("size", "component")).alias("major_load"))
    return scratch.saved(found.where("several > 1").drop("several"))


def _chunks(size: str, load: str):
    """How many chunks of about BLOCK members or BLOCK_SHINGLES shingles the members make."""
    return F.ceil(F.greatest(F.expr(size) / BLOCK, F.expr(load) / BLOCK_SHINGLES)).cast("int")


def _dealt(rows: DataFrame, extra: DataFrame) -> DataFrame:
    rows = rows.select("bucket", "i", "j", "id", "component", "side", "n").join(extra, "id")
    rows = rows.select("bucket", "i", "j", "id", "component", "side", "n", *extra.drop("id").columns)
    return rows.repartition(routing.partitions(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _chunked(inside: DataFrame, extra: DataFrame) -> DataFrame:
    """Members of mixed buckets, each in one chunk of its bucket."""
    rows = inside.join(_mixed(inside).select("bucket", _chunks("size", "load").alias("chunks")), "bucket")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    return _dealt(rows.withColumns({"i": own, "j": own, "side": F.lit(0)}), extra)


def _blocks(inside: DataFrame, extra: DataFrame) -> DataFrame:
    """Members of mixed buckets, dealt out in blocks of two chunks.

    The members of a bucket's largest component are in chunks of their own, which
    meet no other such chunk, as they are linked already: a member of a hot group
    moves once for each chunk of the others.  ``side`` tells the chunk: 0 both, 1
    the first, 2 the second.
    """
    mixed = _mixed(inside).select("bucket", "major", _chunks("size - major_size", "load - major_load").alias("few"), _chunks("major_size", "major_load").alias("rest"))
    rows = inside.join(mixed, "bucket").withColumn("is_major", F.col("component") == F.col("major"))
    hashed = F.xxhash64("id")
    rows = rows.withColumn("own", F.when(F.col("is_major"), F.col("few") + F.pmod(hashed, F.col("rest"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
    meets = F.when(F.col("is_major"), F.col("few")).otherwise(F.col("few") + F.col("rest"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return _dealt(rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side}), extra)


def central(inside: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of a second star: each member apart from its chunk's most central member.

    Central is the member whose signature agrees most with the commonest values
    of the chunk; copies edited in many ways are all nearest to it.
    """

    def run(batches):
        for _, held in _grouped(batches, 3):
            ids, comp, sketch = _long(held, 3), _long(held, 4), _sketches(held, 7, np.uint32, HASHES)
            common = np.zeros(HASHES, np.uint32)
            for k in range(HASHES):
                v, c = np.unique(sketch[:, k], return_counts=True)
                common[k] = v[c.argmax()]
            best = np.lexsort((ids, -(sketch == common).sum(axis=1)))[0]
            pick = (comp != comp[best]) & ((sketch == sketch[best]).sum(axis=1) >= LEAST_AGREED)
            if pick.any():
                yield _pairs([ids[pick]], [np.full(int(pick.sum()), ids[best])])

    return _chunked(inside, classes.select(F.col("cid").alias("id"), "sketch")).mapInArrow(run, "a long, b long").distinct()


def half_keys(members: DataFrame) -> DataFrame:
    """(bucket, id) for each group of the first collection alone: ten wider buckets a member."""

    def run(batches):
        for batch in batches:
            sketch = _sketches([batch], 1, np.uint32, HASHES)
            pair = (sketch[:, 0 : 2 * GROUPS : 2].astype(np.uint64) << np.uint64(32)) | sketch[:, 1 : 2 * GROUPS : 2]
            key = tx.mix(pair + np.arange(GROUPS, dtype=np.uint64) * np.uint64(tx.BYTE_BASE))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sketch)), GROUPS)))], ["bucket", "id"])

    return members.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def cross_links(inside: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a > b) between the components inside a bucket.

    Each pair is looked at in the first bucket that its members share.  If their
    sizes and signatures allow the similarity, the full sets are compared; only
    links leave the block.
    """

    def run(batches):
        for name, held in _grouped(batches, 3):
            ids, comp, side, n = (_long(held, k) for k in (3, 4, 5, 6))
            sketch = _sketches(held, 7, np.uint32, HASHES)
            full = [np.frombuffer(x.as_buffer(), np.uint64) for h in held for x in h.column(8)]
            pair = (sketch[:, 0 : 2 * GROUPS : 2].astype(np.uint64) << np.uint64(32)) | sketch[:, 1 : 2 * GROUPS : 2]
            keys = tx.mix(pair + np.arange(GROUPS, dtype=np.uint64) * np.uint64(tx.BYTE_BASE)).astype(np.int64)
            y = np.flatnonzero(side != 1)
            left, right = [], []
            for i in np.flatnonzero(side != 2):
                # of one chunk each pair is seen from its later member
                q = y if side[i] else y[y < i]
                q = q[(comp[q] != comp[i]) & (100 * np.minimum(n[i], n[q]) >= percent * np.maximum(n[i], n[q]))]
                q = q[(sketch[q] == sketch[i]).sum(axis=1) >= LEAST_AGREED]
                q = q[keys[i, (keys[q] == keys[i]).argmax(axis=1)] == name[0]] if len(q) else q
                q = q[(keys[q] == keys[i]).any(axis=1)] if len(q) else q
                if not len(q):
                    continue
                own, other = full[i], np.concatenate([full[k] for k in q])
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = np.r_[0, np.cumsum(own[at] == other)]
                end = np.cumsum(n[q])
                same = hit[end] - hit[end - n[q]]
                ok = 100 * same >= percent * (n[i] + n[q] - same)
                left.append(np.full(int(ok.sum()), ids[i]))
                right.append(ids[q[ok]])
            if any(map(len, left)):
                yield _pairs(left, right)

    extra = sketches.join(sets.select(F.col("cid").alias("id"), "shingles"), "id").select("id", "sketch", "shingles")
    return scratch.saved(_blocks(inside, extra).mapInArrow(run, "a long, b long").distinct())


def link_classes(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(cid, component) of all classes that link with another."""
    found = scratch.saved(buckets(classes, routing.partitions(texts.sparkSession)))
    stars = scratch.saved(found.where("id != star").select(F.greatest("id", "star").alias("a"), F.least("id", "star").alias("b")).distinct())
    sets = full_sets(stars, texts, classes, size)
    links = confirmed(stars, sets, percent)
    labels = components.components(links)
    known = classes.select(F.col("cid").alias("id"), "n", "sketch")

    def placed(members):
        return scratch.saved(members.join(labels, "id", "left").join(known.select("id", "n"), "id").select("bucket", "id", "n", F.coalesce("component", "id").alias("component")))

    many = found.where("many").select("bucket", "id")
    inside = placed(many)
    more = scratch.saved(central(inside, classes).join(stars, ["a", "b"], "left_anti"))
    scratch.drop(inside)
    if more.limit(1).count():
        links = links.union(confirmed(more, sets, percent))
        labels = components.components(links)
    apart = scratch.saved(many.select("id").distinct().join(known, "id"))
    inside = placed(half_keys(apart))
    rest = cross_links(inside, apart.select("id", "sketch"), sets, percent)
    if rest.limit(1).count():
        labels = components.components(links.union(rest))
    for table in (found, stars, sets, more, apart, inside):
        scratch.drop(table)
    return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    rows = scratch.saved(signatures(docs, size, id_col, text_col))
    own = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.saved(own.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = link_classes(texts, classes, size, percent)
    named = classes.select("cid", "rep").join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "rep", F.coalesce("component", "cid").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.saved(named.join(least, "component").select("cid", "component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(named, "cid", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of least id stays.

    Rows without words or without an id stay.  Of rows with equal id and text
    one stays.
    """
    found = near_duplicates(docs, size, percent, id_col, text_col)
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.join(gone, docs[id_col] == F.col("gone"), "left_anti")
    again = scratch.saved(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("again")).count().where("count > 1").select("again"))
    if not again.limit(1).count():
        return rows
    several = rows.join(again, rows[id_col] == F.col("again"), "left_semi").dropDuplicates([id_col, text_col])
    return rows.join(again, rows[id_col] == F.col("again"), "left_anti").unionByName(several)
