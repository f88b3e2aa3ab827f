"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows to the
shared scratch folder, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, quality, scratch, substring, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    return toxicity.accepted(docs, _labels(spark, sf_dir))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, _labels(spark, sf_dir))


#: The pipeline's own choice: five words and a similarity of 0.8, as for all near-duplicate stages.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id."""
    return minhash.one_of_each(docs, STAGE_SHINGLE, STAGE_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that are elsewhere too are cut from the texts; n_chars follows."""
    cut = substring.remove_repeats(docs, with_text=True, also=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("also_2")).cast(docs.schema["n_chars"].dataType)
    return cut.select("doc_id", "text", F.col("also_0").alias("lang"), F.col("also_1").alias("source"), size.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL cannot train the classifiers; the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = scratch.saved(out)
            if k:
                scratch.drop(docs)
        docs = out
    return docs
