"""Training corpus from raw documents: five filtering and encoding stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as Parquet
and read again as the next stage's docs, so a stage may drop the scratch tables of the one before.
Rows are identified by id and text: rows alike in both count as one from the exact dedup on.
All stages but the last return the columns of ``docs``; the last returns ids per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prioscope.llm import benchmark, exact, near, pieces, toxicity
from prioscope.llm.common import keep_rows, release
from prioscope.sources.staging import fresh_path

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut stay. The model is fitted to the labelled ones among them."""
    release(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_rows(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    release(spark)
    return exact.unique_rows(docs, exact.fresh_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    release(spark)
    return keep_rows(docs, near.near_classes(docs).where("kept"), "key")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    release(spark)
    return benchmark.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every document that is left."""
    release(spark)
    return pieces.encode(docs, pieces.load_model(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Fitted and iterative stages have no SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    release(spark, collect=False)
    return docs
