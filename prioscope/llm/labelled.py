"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prioscope.llm.common import held_out


def training_labels(labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled documents that are not held out, chosen by a hash of the id.

    Null ids and labels are left out; a document with several labels has the largest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
