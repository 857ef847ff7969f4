"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from prioscope.llm import benchmark, exact, html, mixing, near, passages, phrases, pieces, quality, sharding, toxicity, urls, variants

SHARD_BYTES = 64 * 1024 * 1024


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeats(_read(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_read(spark, folder, "pages"), urls.rule_table(spark, urls.RULES))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_read(spark, folder, "pages"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(_read(spark, folder, "documents"), pieces.load_model(corpus_pipeline.PIECE_MODEL))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, folder, "labels")))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_read(spark, folder, "documents"), SHARD_BYTES).drop("row")


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(_read(spark, folder, "documents")).drop("key")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.decide(_read(spark, folder, "documents"), exact.fresh_index(spark))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents")).rows.select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(_read(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_read(spark, folder, "documents"), top=phrases.TOP)


QUERIES = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_url_filter": op2_url_filter,
    "op3_html_text": op3_html_text,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_mixing": op11_mixing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}

CHECKS = {
    "op2_url_filter": urls.ORACLE,
    "op3_html_text": html.ORACLE,
    "op7_sharding": sharding.oracle(SHARD_BYTES),
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op11_mixing": mixing.oracle(),
    "op13_collocations": phrases.ORACLE,
}
