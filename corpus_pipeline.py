"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents. SQL cannot express the stages (shingle similarity,
sentence hashing, tokenization); the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.llm import jaccard_join, packing, quality_rules, span_dedup, stream_dedup
from streetlens.llm.common import materialize
from streetlens.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a rule rejects go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return stream_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity 0.8 of five-word shingles one document stays."""
    return jaccard_join.nearest_kept(docs, 5, 80)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans are cut from every text but the first; n_chars follows, texts left empty go."""
    cut = span_dedup.cut_repeated(docs).drop("removed_words")
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).where("n_chars > 0")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), 1, 2048)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("span_dedup", spans), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
