"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_table, jaccard_join, packing, quality_classifier, quality_rules, sharding, span_dedup, stream_dedup, token_store, url_filter
from .tokens import vocabulary_path

# The rules of the URL query.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in URL_RULES))))
    found = url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 40)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), 2)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.exact_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), 1, 2048)


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_dedup.cut_repeated(_documents(spark, sf_dir))
    return found.select("doc_id", "text", "removed_words", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op9_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.round_trip_digests(_documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), 4, 85)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_quality_rules, op3_sharding, op4_token_store, op5_quality_classifier, op6_stream_dedup, op7_packing, op8_span_dedup, op9_bpe_table, op10_jaccard_join)}

ORACLE = {
    "op1_url_filter": r"""
        WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        urls AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        hits AS (
            SELECT u.*, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
            FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1
    """,
    "op6_stream_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
