"""Connected components of a graph held as a table of edges, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prioscope.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b); the label is the least node of its component.

    Each round every node takes the least label of its neighbours and then the label of that
    label, so chains shrink by doubling. Every round is stored, so lineage stays short. A node
    with very many edges meets them as partial minima and in joins that can be split.
    """
    pairs = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = kept(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = kept(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels"
        )
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
