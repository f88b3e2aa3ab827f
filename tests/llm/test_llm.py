"""The corpus operators against brute force, on small inputs with the awkward cases in."""

import hashlib
import math
import zlib
from collections import Counter

import base64
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, bpe, components, fitting, graphdedup, html, lm, minhash, packing, quality, routing, substring, toxicity, vectors
from tidemark.llm import text as tx

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Rows (doc_id, text), with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "cid": F.lit(2), "row_key": F.lit(3), "part": F.lit(4), "label": F.lit(5)}).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    extra = [(0, got[0][1]), (None, None), (None, got[5][1]), (900, ""), (901, None), (902, " \n\t "), (903, "a b"), (904, "A  b"), (905, "same " * 300), (906, "x" * 5000), (907, got[7][1] + " tail")]
    return got + extra


# kernels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né\x00漢", max_size=12), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    for _, _, buf, offs in tx.chunks(pa.array(texts, pa.string()), 1 << 20):
        s, e, first = tx.word_spans(buf, offs)
        got = [[buf[a:b].tobytes() for a, b in zip(s[x:y], e[x:y])] for x, y in zip(first[:-1], first[1:])]
        assert got == [t.encode().split() for t in texts]
        h = tx.span_hash(buf, s, e)
        words = [w for g in got for w in g]
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_packed_places_round_trip():
    rng = np.random.default_rng(0)
    keys = np.repeat(rng.integers(-(2**62), 2**62, 20), rng.integers(1, 9, 20))
    pos = rng.integers(0, 100_000, len(keys))
    for wide in (False, True):
        a = routing.load(routing.dump(routing.dump_places(keys, pos, wide)))
        k, p = routing.load_places(a)
        assert (k == keys).all() and (p == pos).all()


# byte-level BPE and packing

ODD = ["", " ", "'s 't're 'x it's  don't\n\n 've'll", "a  b   \n c \t", "naïve ½ ²3 漢字 🙂🙂", "<|endoftext|>x<|endoftext|>", "a" * 3000, "ab" * 900 + "!?" * 900, "\x1c\x85 　 x", "''s '' 's"]


def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, rows):
    enc = multi()
    inputs = rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = Counter(map(tuple, bpe.digests(docs_of(spark, inputs), P.path("byte_bpe_multi_50k.tiktoken")).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in inputs:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sltrevmd 1\n é!漢 ", max_size=40))
def test_pieces_of_any_text(text):
    enc, own = multi_cached(), bpe.load(P.path("byte_bpe_multi_50k.tiktoken"))
    assert [x.tolist() for _, x in bpe.encoded(pa.array([text, "x", text]), own)] == [enc.encode_ordinary(t) for t in (text, "x", text)]


_ENC = []


def multi_cached():
    if not _ENC:
        _ENC.append(multi())
    return _ENC[0]


def test_encode_then_decode(spark):
    ids = bpe.encode(docs_of(spark, list(enumerate(ODD)) + [(99, None)]), P.path("byte_bpe_50k.json"))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, P.path("byte_bpe_50k.json")).collect()}
    assert back == {i: t.encode() for i, t in enumerate(ODD)} | {99: b""}


def test_packing_is_gapless_and_whole(spark, rows):
    inputs = rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(docs_of(spark, inputs), P.path("byte_bpe_50k.json")).toPandas()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in inputs:
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    by_id = {}
    for (i, ids), n in want.items():
        by_id.setdefault(i, []).append((ids, n))
    seen = Counter()
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        fits = [ids for ids, _ in by_id[i] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits
        seen[i] += r.length
    assert seen == Counter({i: sum(len(ids) * n for ids, n in x) for i, x in by_id.items()})
    padded = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.iloc[0] == 0 and (s.offset.to_numpy()[1:] == (s.offset + s.length).to_numpy()[:-1]).all()
        total = int(s.length.sum())
        assert total <= 1024
        padded += 0 if total & (total - 1) == 0 else 1024 - total
    assert padded == 0


def packed(lengths, capacity=1024):
    """(document, start, length, sequence, offset) of documents of these lengths, by one worker."""
    packer, out = packing.Packer(0, capacity), []
    for i, n in enumerate(lengths):
        out += packer.add(i, n)
    out += packer.rest()
    return [(*p, s, at) for p, s, at in out]


def test_harmonic_bins_take_a_fixed_count():
    packer = packing.Packer(0, 1024)
    lengths = (300, 300, 340, 600, 290)
    assert [x for i, n in enumerate(lengths) for x in packer.add(i, n)] == [] and [len(g[1]) for g in packer.gaps] == [3, 1]
    # a long document fills the gaps of 84 and 424, in order
    got = list(packer.add("long", 1500))
    assert got == [((0, 0, 300), 0, 0), ((1, 0, 300), 0, 300), ((2, 0, 340), 0, 600), (("long", 0, 84), 0, 940), ((3, 0, 600), 1, 0), (("long", 84, 424), 1, 600)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120))
def test_packing_of_any_lengths_is_whole_and_unpadded(lengths):
    got = packed(lengths, 64)
    parts, bins = {}, {}
    for d, start, n, s, at in got:
        parts.setdefault(d, []).append((start, n))
        bins.setdefault(s, []).append((at, n))
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == dict(enumerate(lengths))
    for own, whole in [*((p, None) for p in parts.values()), *((b, 64) for b in bins.values())]:
        ends = 0
        for at, n in sorted(own):
            assert at == ends and n > 0
            ends += n
        assert whole is None or ends == 64 or ends < 64 and ends & (ends - 1) == 0
    assert sum(1 for b in bins.values() if sum(n for _, n in b) < 64) <= 6


@pytest.mark.parametrize("most, share", [(1024, 0.85), (1500, 0.99), (4000, 0.99)])
def test_documents_that_fit_stay_whole(monkeypatch, most, share):
    monkeypatch.setattr(packing, "MOST_GAPS", 64)
    lengths = np.random.default_rng(1).integers(1, most, 20_000).tolist()
    got = packed(lengths)
    pieces = Counter(d for d, *_ in got)
    fit = [i for i, n in enumerate(lengths) if n <= 1024]
    assert sum(pieces[i] == 1 for i in fit) >= share * len(fit)


def test_packing_on_nothing_and_on_clashes(spark):
    assert packing.pack(docs_of(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    df = docs_of(spark, [(1, None), (1, None), (None, "a b")]).withColumns({"start": F.lit("x"), "sequence_id": F.lit("y"), "ids": F.lit("z")}).coalesce(1)
    got = Counter(map(tuple, packing.pack(df, P.path("byte_bpe_50k.json"), with_ids=True).select("doc_id", "start", "length", "doc_tokens").collect()))
    assert got[1, 0, 1, 1] == 2 and sum(n for (d, *_), n in got.items() if d is None) >= 1


# substring deduplication


def test_repeated_passages(spark, rows):
    shared = " ".join(f"w{i}" for i in range(40))
    inputs = rows + [(2000 + i, f"p{i} q{i} " * (i + 1) + shared + f" r{i}") for i in range(5)] + [(2100, "z " * 34)]
    got = Counter(map(tuple, substring.remove_repeats(docs_of(spark, inputs)).collect()))
    words = [(t or "").encode().split() for _, t in inputs]
    count = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(inputs, words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def test_substring_keeps_other_columns_and_untouched_texts(spark):
    df = spark.createDataFrame([(1, " a  b ", "en"), (2, None, None)], "doc_id long, text string, lang string")
    got = substring.remove_repeats(df, with_text=True, also=("lang",)).select("doc_id", "text", "also_0")
    assert sorted(map(tuple, got.collect())) == [(1, " a  b ", "en"), (2, None, None)]


# near duplicates


def brute_components(sets, linked):
    """Least index reachable, for sets given in order."""
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [512, 3])
def test_minhash_components(spark, rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    copies = []
    for i in range(40):  # a cloud of copies, some too far from most others
        w = list(base)
        for k in rng.integers(0, 120, i % 8):
            w[k] = f"e{i}_{k}"
        copies.append((3000 + i, " ".join(w)))
    inputs = rows + copies
    got = Counter(map(tuple, minhash.near_duplicates(docs_of(spark, inputs)).collect()))
    sets = []
    for _, t in inputs:
        w = (t or "").translate(LOW).encode().split()
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    part = [i for i, (d, _) in enumerate(inputs) if d is not None and sets[i]]
    comp = brute_components([sets[i] for i in part], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    least = {}
    for i, c in zip(part, comp):
        least[c] = min(least.get(c, inputs[i][0]), inputs[i][0])
    own = {i: least[c] for i, c in zip(part, comp)}
    want = Counter((d, len(sets[i]), own.get(i, d), d is not None and own.get(i, d) == d) for i, (d, _) in enumerate(inputs))
    assert got == want
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_one_of_each_keeps_rows_without_words(spark):
    long = " ".join(f"w{i}" for i in range(50))
    inputs = [(1, long), (2, long), (2, long), (3, None), (None, ""), (None, long), (4, "other words here")]
    got = minhash.one_of_each(docs_of(spark, inputs), 5).select("doc_id", "text")
    assert Counter(map(tuple, got.collect())) == Counter([(1, long), (3, None), (None, ""), (None, long), (4, "other words here")])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def test_one_class_that_meets_a_bucket_settled_in_a_batch_knows_of_many(spark):
    rng = np.random.default_rng(6)
    tight, *other = (rng.integers(0, 1 << 32, minhash.HASHES, dtype=np.uint32).tobytes() for _ in range(20))
    rows = [(100 + i, tight) for i in range(20)] + [(3, tight)] + [(4 + i, x) for i, x in enumerate(other)]
    classes = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "cid long, sketch binary")
    got = minhash.buckets(classes, 4).toPandas()
    assert got[got.id == 3].bucket.nunique() == minhash.GROUPS**2 and got[got.id == 3].many.all()
    assert set(got[got.many].groupby("bucket").id.nunique()) == {21} and 4 not in set(got.id)


# embeddings


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:180] = x[0] + 0.09 * rng.normal(size=(80, 16))
    x[200] = x[201] = x[1]
    out = [(i, [float(v) for v in x[i].astype("f4")], i % 2 if i < 100 or i >= 180 else 0) for i in range(300)]
    bad = [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 1), (404, out[0][1], None), (405, [1.0], 0), (406, [float("inf")] + [0.0] * 15, 0), (0, out[0][1], 0)]
    return out + bad


def embedding_links(rows, least=0.98):
    """Brute force: (vec_id, n_links, component_id, kept) of all rows."""
    ok = [(k, r) for k, r in enumerate(rows) if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]

    def linked(i, j):
        x, y = (np.array(ok[k][1][1], float) for k in (i, j))
        return ok[i][1][2] == ok[j][1][2] and len(x) == len(y) and (x @ y) / np.sqrt((x @ x) * (y @ y)) >= least

    near = np.array([[linked(i, j) for j in range(len(ok))] for i in range(len(ok))]).reshape(len(ok), len(ok))
    comp = brute_components(range(len(ok)), lambda i, j: near[i, j])
    least_id = {}
    for (_, r), c in zip(ok, comp):
        least_id[c] = min(least_id.get(c, r[0]), r[0])
    own = {k: (int(near[i].sum()) - 1, least_id[comp[i]]) for i, (k, _) in enumerate(ok)}
    want = Counter()
    for k, r in enumerate(rows):
        n, c = own.get(k, (0, r[0]))
        want[r[0], n, c, r[0] is not None and c == r[0]] += 1
    return want


@pytest.mark.parametrize("cell, block, beams", [(2048, 4096, (8,)), (32, 20, (8, None)), (300, 16, (None,))])
def test_embedding_links(spark, cloud, monkeypatch, cell, block, beams):
    """One block; small cells with hot ones in several blocks; full scans of blocks."""
    for name, value in (("CELL_ROWS", cell), ("BLOCK_ROWS", block), ("BEAMS", beams)):
        monkeypatch.setattr(graphdedup, name, value)
    other = [(500 + i, [float(v) for v in np.array([1.0, i % 3, 0.01 * i]).astype("f4")], 0) for i in range(12)]
    rows = cloud + other + [(None, cloud[0][1], 0)]
    want = embedding_links(rows)
    assert Counter(map(tuple, graphdedup.near_duplicates(vectors_of(spark, rows)).collect())) == want
    assert max(n for _, n, _, _ in want) > 20 and sum(n > 0 for i, n, _, _ in want if i and i >= 500) > 5


def nearest_rows(rows, k=20, every=20):
    """Brute force: query_id -> [(score, vec_id)] of the nearest, ties to the smaller id."""
    ok = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    return {q: sorted((-float((np.array(x) * np.array(y)).sum()), v) for v, y in ok if v != q and len(y) == len(x))[:k] for q, x in ok if q % every == 0}


def test_nearest_neighbours(spark, cloud):
    other = [(500 + i, [1.0 + i, 2.0, 0.5 * i], 0) for i in range(30)] + [(None, [1.0, 2.0, 3.0], 0)]
    got = ann.search(vectors_of(spark, cloud + other)).toPandas()
    want = nearest_rows([(i, [float(np.float32(c)) if c is not None else None for c in v] if v is not None else None, lab) for i, v, lab in cloud + other])
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(want[q]) + 1))
        assert [(-a, b) for a, b in zip(g.score, g.vec_id)] == sorted((-a, b) for a, b in zip(g.score, g.vec_id))
        hit += len({v for _, v in want[q]} & set(g.vec_id))
        scores = {v: -s for s, v in want[q]}
        assert all(abs(scores[v] - s) < 1e-12 for v, s in zip(g.vec_id, g.score) if v in scores)
    assert set(got.query_id) == set(want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_a_vector_in_thousands_of_copies(spark, monkeypatch):
    """Ties go to the smaller ids, and the copies do not crowd out the sample of the centroids."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).astype("f4")
    rows = [(i, [float(v) for v in (x[0] if i < 3000 else x[i - 2999])], 0) for i in range(3399)]
    models, build = [], ann.centroids
    monkeypatch.setattr(ann, "centroids", lambda *a: models.append(build(*a)) or models[-1])
    got = ann.search(vectors_of(spark, rows), every=200).toPandas()
    assert len(np.unique(models[0].points, axis=0)) == len(models[0].points) > 4
    want = nearest_rows(rows, every=200)
    assert (got.groupby("query_id").size() == 20).all() and set(got.query_id) == set(want)
    hit = sum(len({v for _, v in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit / (20 * len(want)) >= 0.9


def test_empty_embeddings(spark):
    assert graphdedup.near_duplicates(vectors_of(spark, [])).count() == 0
    assert ann.search(vectors_of(spark, [])).count() == 0
    assert graphdedup.near_duplicates(vectors_of(spark, [(1, None, 0)])).count() == 1
    assert ann.search(vectors_of(spark, [(20, None, 0)])).count() == 0


# pages


def test_main_text():
    page = '<html><head><title>T &amp;</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Four &lt;5</p><div class="comments">nice!</div><form>x</form></article><footer>&copy;</footer>'
    assert html.main_text(page) == "Head & line\n\nOne two three\n\nFour <5"
    assert html.main_text("") == "" and html.main_text("a < b") == "a < b"


def test_template_removal(spark):
    side = '<div class="x"><ul><li>One</li><li>Two</li></ul></div>'
    rows = [(i, "http://a.example/p", f"<body>{side}<div><p>Text {i}</p></div></body>") for i in range(4)] + [(9, "http://b.example/", f"<body>{side}<p>Other</p></body>"), (10, None, None), (11, "bad url [", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row_key", F.lit(0))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {i: (f"Text {i}", 6) for i in range(4)} | {9: ("One\n\nTwo\n\nOther", 15), 10: ("", 0), 11: ("x", 1)}


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(df).orderBy("page_id").collect()]


def test_blocks_that_recur_inside_articles_are_removed(spark):
    box = '<div class="x"><p>Read our letter</p></div>'
    pages = [f"<article><h1>Head {i % 4}</h1><p>Text {i}</p>{box}</article>" for i in range(12)] + ["<article><p>Copy</p></article>" + f"<p>{i}</p>" for i in range(30)]
    assert texts_of(spark, pages) == [f"Head {i % 4}\n\nText {i}" for i in range(12)] + ["Copy"] * 30


def test_copies_and_chance_repeats_are_no_template(spark):
    side = "<div><p>Menu</p></div>"
    copies = [f"<body>{side}<div><p>Same {k}</p></div></body>" for k in (0, 0, 0, 0)]
    chance = [f"<body>{side}<div><p>{'Summary' if i < 4 else f'Head {i}'}</p></div><p>Text {i}</p></body>" for i in range(40)]
    assert texts_of(spark, copies + chance) == ["Same 0"] * 4 + [f"{'Summary' if i < 4 else f'Head {i}'}\n\nText {i}" for i in range(40)]


# classifiers


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.93)])
def test_held_out_accuracy(spark, tables, module, label, least):
    docs, labels = tables
    got = module.classify(docs.withColumn("score", F.lit("clash")), labels)
    assert got.count() == docs.count()
    both = got.join(labels, "doc_id").where("held_out").select("predicted", label).toPandas()
    assert (both["predicted"] == both[label]).mean() >= least
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_nothing_and_on_one_class(spark, module):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [(1, None), (2, ""), (None, "x"), (3, "some words")])
    assert module.classify(docs, empty).count() == 4
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert module.accepted(docs, one).count() == 4
    assert module.classify(docs.limit(0), one).count() == 0


def test_earlier_probabilities_reach_later_models():
    row, col = np.repeat(np.arange(200), 2), np.array([[0, 1] if i % 2 else [2, 3] for i in range(200)]).ravel()
    y = np.column_stack([np.arange(200) % 2, np.arange(200) % 2])
    terms = [np.array([1, 2, 3, 4], np.uint64)] * (toxicity.FOLDS + 1)
    chain = toxicity.fit(lambda k: (row, col, y), np.arange(200) // 2 % toxicity.FOLDS, 200, ("first", "second"), terms)
    assert len(chain.weights[1]) == 5 and chain.weights[1][4] > 0.1


def test_no_label_of_a_fold_reaches_its_own_models(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 7} " + ("vile " * (1 + i % 4) if i % 3 == 0 else "kind ")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    words = toxicity.sampled_words(docs, labels).toPandas()
    flipped = labels.join(spark.createDataFrame([(int(i),) for i in words[words.fold == 2].doc_id], "doc_id long"), "doc_id", "left").withColumn("toxic", F.when(F.col("doc_id").isin([int(i) for i in words[words.fold == 2].doc_id]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (toxicity.marked_terms(toxicity._term_counts(toxicity.sampled_words(docs, x))) for x in (labels, flipped))
    assert len(one[2][0]) and (one[2][0] == other[2][0]).all() and (one[2][1] == other[2][1]).all()
    # brute force: the documents of the other folds
    rows = {r.doc_id: set(r.text.split()) for r in docs.collect()}
    own = [(set(rows[r.doc_id]), r.toxic) for r in words.itertuples() if r.fold != 2]
    yes, no = [w for w, y in own if y], [w for w, y in own if not y]
    kept = {w for w in set().union(*yes) if sum(w in d for d in yes) >= 3 and sum(w in d for d in yes) / len(yes) >= 3 * (sum(w in d for d in no) + 0.5) / len(no)}
    assert kept == {"vile"} and len(one[2][0]) == 1


def test_temperature_is_chosen_on_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < fitting.sigmoid(z)).astype(int)
    assert abs(fitting.temperature(3 * z, y) - 3) < 0.5


# language model


def test_base_scores_and_normalisation(spark, rows):
    inputs = rows
    got = lm.score_documents(docs_of(spark, inputs)).toPandas()
    words = [(t or "").translate(LOW).encode().split() + [None] for _, t in inputs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in inputs]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for (i, _), ws, h in zip(inputs, words, held):
        want[i, h, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    assert got.score.sum() > got.base_score.sum()


def _small_base():
    c = np.arange(80, 0, -1)
    return lm.Unigrams(np.arange(1, 81, dtype=np.uint64), c, int(c.sum()) + 20, 90)


def test_outputs_sum_to_one():
    base = _small_base()
    net = lm.Network.start(base)
    s = np.random.default_rng(1).normal(size=(lm.HIDDEN, 3)).astype(np.float32)
    total = np.zeros(3)
    for g in range(lm.OUTPUTS):
        for w in range(lm.CLASS_SIZE if g < lm.CLASSES else 1):
            total += np.exp(net.outputs(s, np.full(3, g), np.full(3, w if g < lm.CLASSES else -1))[0])
    assert np.allclose(total, 1, atol=1e-4)


def test_state_is_carried_over_windows():
    base = _small_base()
    net = lm.Network.start(base)
    rng = np.random.default_rng(2)
    rank = rng.integers(0, 80, 300).astype(np.uint16)
    whole = lm.gains(net, base, rank, np.array([0, 100, 300]))
    alone = [lm.gains(net, base, rank[a:b], np.array([0, b - a]))[0] for a, b in ((0, 100), (100, 300))]
    assert np.allclose(whole, alone, atol=1e-3)


def test_gradient_of_the_network():
    base = _small_base()
    net = lm.Network.start(base)
    rng = np.random.default_rng(4)
    y = rng.integers(0, 80, (8, 2))
    x, group = np.r_[[[0, 0]], y[:-1]], y // lm.CLASS_SIZE
    reset, h = np.zeros((8, 2), bool), np.zeros((lm.HIDDEN, 2), np.float32)

    def loss():
        states, _, _ = net.run(x, reset, h)
        return -net.outputs(states.reshape(lm.HIDDEN, -1), group.ravel(), (y % lm.CLASS_SIZE).ravel())[0].sum()

    seen = {}
    net._adam = lambda grads, n, rate: seen.update(grads)
    net.learn(x, reset, h, group, y % lm.CLASS_SIZE, 0.1)
    for name in ("recur", "out", "embed"):
        at = np.unravel_index(np.abs(seen[name]).argmax(), seen[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert np.isclose((up - down) / 2e-2, seen[name][at], rtol=0.05, atol=1e-3), name


def test_windows_side_by_side_add_up():
    rng = np.random.default_rng(8)
    lanes, windows = 3, 4
    steps = windows * lm.WINDOW
    x = rng.integers(0, 60, (steps, lanes))
    group, word = lm._targets(rng.integers(0, 60, (steps, lanes)))
    reset, real = rng.random((steps, lanes)) < 0.1, np.ones((steps, lanes), bool)
    real[-5:, 1] = False
    h = rng.normal(0, 0.3, (lm.HIDDEN, lanes)).astype(np.float32)
    net, seen = lm.Network.start(_small_base()), []
    net._adam = lambda grads, n, rate: seen.append((grads, n))
    last = net.learn(x, reset, h, group, word, 0.1, real)
    for t in range(0, steps, lm.WINDOW):
        part = slice(t, t + lm.WINDOW)
        h = net.learn(x[part], reset[part], h, group[part], word[part], 0.1, real[part])
    (whole, n), *parts = seen
    assert n == sum(k for _, k in parts) == real.sum() and np.allclose(last, h, atol=1e-5)
    for name, g in whole.items():
        assert np.allclose(g, sum(p[name] for p, _ in parts), atol=1e-3), name


def test_training_reaches_every_token(spark, monkeypatch):
    networks, train = [], lm.train

    def kept(*args):
        networks.append(train(*args))
        return networks[-1]

    monkeypatch.setattr(lm, "train", kept)
    inputs = [(i, " ".join(f"v{i}x{k}" for k in range(3 + i % 7))) for i in range(140)]
    lm.score_documents(docs_of(spark, inputs)).count()
    held = sum(zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in inputs)
    words = sum(len(t.split()) for i, t in inputs if zlib.crc32(str(i).encode()) % 5 != 1)
    start = lm.Network.start(_small_base())
    moved = (networks[-1].p["embed"] != start.p["embed"]).any(axis=1)
    # each word is in one document and is the input of the token after it
    assert held and words < lm.WORDS and moved[1 : words + 1].all()


def test_held_out_gain_does_not_depend_on_the_partitions(spark, tables):
    docs, got = tables[0], []
    for n in (1, 7):
        rows = lm.score_documents(docs.repartition(n)).toPandas().sort_values("doc_id").reset_index(drop=True)
        held = rows[rows.held_out]
        assert (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum() >= 0.05
        got.append(rows)
    assert np.abs(got[0].score - got[1].score).max() <= 1e-4 and (got[0].doc_id == got[1].doc_id).all()


def test_scores_of_nothing_and_of_a_very_long_text(spark):
    assert lm.score_documents(docs_of(spark, [])).count() == 0
    got = lm.score_documents(docs_of(spark, [(1, "a b " * 100_000), (2, None), (2, None)])).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 200_001] and np.isfinite(got.score).all()


def test_documents_are_trained_on_whole_and_in_order(monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_LANES", 4)
    base = _small_base()
    net, seen, carried = lm.Network.start(base), {}, []
    learn = net.learn

    def watched(x, reset, h, group, word, rate, real):
        assert (word[real] >= 0).all()
        for k in range(x.shape[1]):
            seen.setdefault(k, []).append((reset[real[:, k], k], x[real[:, k], k]))
        carried.append(bool(np.abs(h).sum()))
        return learn(x, reset, h, group, word, rate, real)

    net.learn = watched
    lanes = lm.Lanes(net, 0.02)
    rank = np.random.default_rng(3).integers(0, 80, 701).astype(np.int32)
    at = np.array([0, 1, 200, 231, 300, 417, 500, 701])
    lanes.add(rank[:300], at[:5])
    lanes.learn()
    lanes.add(rank[300:], at[4:] - 300)
    lanes.learn()
    lanes.finish()
    assert lanes.done == 701 and any(carried[1:])
    assert sum(len(x) for own in seen.values() for _, x in own) == 701
    assert sum(int(r.sum()) for own in seen.values() for r, _ in own) == len(at) - 1
