"""Exact dedup against a persistent digest index (operator 10).

The index is a Parquet table bucketed and sorted by digest, one row per text. A batch is
reduced to one entry per text, entries that the index lacks are found by a sort-merge
anti-join (the index side is neither shuffled nor sorted), and those are appended.

Defined results: a null text counts as empty, and empty texts are equal to each other. A null
id counts as the smallest. Among rows with the same text and id, one row stays. An empty table
gives an empty result. Extra columns are ignored by ``decide`` and returned by ``unique_rows``.

A batch with a name owns what it enters: given again under that name, whole or after a run that
died at any point, it gets the same verdicts as at first. Without a name every call is a new batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from prioscope.llm.common import by_group, keep_rows, kept, row_key, text_of
from prioscope.sources.staging import fresh_path

_COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING, n BIGINT"


class DigestIndex:
    """One row per text seen: its digest, the row that stays, and how often it came at first.

    ``path`` is a folder that all nodes share. A later session opens the same index by the same
    path; the number of buckets must be the one it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> None:
        """One sorted file per bucket."""
        entries.select("digest", "keep_id", "keep_row", "batch", "n").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def missing(self, entries: DataFrame) -> DataFrame:
        return entries.join(self.read().hint("merge"), "digest", "left_anti")


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as a shuffle has partitions."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, fresh_path(spark, "digest-index"), buckets)


def _dedupe(docs: DataFrame, index: DigestIndex, batch: str | None) -> tuple[DataFrame, DataFrame, int]:
    """Rows with digest, one verdict per digest, and the number of rows; the index has grown by the batch."""
    batch = batch or fresh_path(index.spark, "batch").rsplit("-", 1)[1]
    rows = kept(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(text_of(), 256)).alias("digest"),
            row_key().alias("key"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    entries = kept(
        rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).select(
            "digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.lit(batch).alias("batch"), "n"
        ),
        "entries",
    )
    index.append(index.missing(entries))
    here = F.col("i.batch") == batch
    verdicts = entries.alias("e").join(index.read().alias("i").hint("merge"), "digest").select(
        "digest",
        F.when(here, F.col("e.keep_id")).otherwise(F.col("i.keep_id")).alias("keep_id"),
        F.when(here, F.col("e.keep_row")).alias("keep_row"),
        F.when(here, F.col("e.n")).otherwise(F.col("e.n") + F.col("i.n")).alias("group_size"),
        F.col("e.n").alias("here"),
    )
    return rows, verdicts, rows.count()


def decide(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: which row of its text stays.

    A text that the index already held keeps the row of that earlier batch; of equal texts that
    come together the row with the largest id stays.
    """
    rows, verdicts, total = _dedupe(docs, index, batch)
    return by_group(rows, verdicts, "digest", "here", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keep_row").isNotNull() & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, verdicts, _ = _dedupe(docs, index, batch)
    staying = rows.join(verdicts.where("keep_row IS NOT NULL").select(F.col("keep_row").alias("row")), "row")
    return keep_rows(docs, staying, "key")
