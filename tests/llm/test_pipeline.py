"""The pipeline's stages, each on its own input."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import scratch, substring, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = scratch.saved(stage(spark, docs, SF))
        assert sorted(out.columns) == sorted(cp.COLUMNS)
        seen[name] = (docs, out)
        docs = out
    before, after = seen["toxicity"]
    bad = toxicity.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert after.count() == before.join(bad, "doc_id", "left_anti").count()
    before, after = seen["near_duplicates"]
    words = lambda t: t.lower().split()
    sets = {r.doc_id: frozenset(tuple(words(r.text)[k : k + 5]) for k in range(max(len(words(r.text)) - 4, 1))) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(any(like(g, k) for k in sets if k != g) for g in set(sets) - kept)
    before, after = seen["repeats"]
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring.remove_repeats(before).collect()}
    for r in after.collect():
        removed, digest = want[r.doc_id]
        if removed:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest and r.n_chars == len(r.text)
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_without_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
