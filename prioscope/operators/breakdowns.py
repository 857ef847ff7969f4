"""Group-by questions about the audited table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.levels import level_rank
from prioscope.functions.numbers import rounded
from prioscope.operators.cleaning import keep_short_cases, type_for_display
from prioscope.operators.ordering import quantiles_of_counts, value_counts
from prioscope.settings import LEVELS
from prioscope.sources.staging import kept

_IS_MISMATCH = "mismatch_label = 'Mismatch'"


def _mismatches() -> Column:
    return F.count_if(F.expr(_IS_MISMATCH))


def level_table(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LEVELS)), "rank int, level string")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def counts_in_level_order(df: DataFrame, column: str) -> DataFrame:
    """One row per level, in order; a level without rows has a null count."""
    known = df.where(F.col(column).isin(LEVELS))
    counted = known.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = level_table(df.sparkSession)
    return levels.join(F.broadcast(counted), "level", "left").select("level", "n").orderBy(
        level_rank(F.col("level"))
    )


def mismatch_rate_by_priority(df: DataFrame) -> DataFrame:
    rate = F.avg(F.expr(f"CASE WHEN {_IS_MISMATCH} THEN 1.0D ELSE 0.0D END")) * 100
    return df.groupBy("priority").agg(rate.alias("mismatch_rate"))


def type_counts(df: DataFrame) -> DataFrame:
    shown = df.select(type_for_display(F.col("mismatch_type")).alias("mismatch_type"))
    return counts_by(shown, "mismatch_type")


def mismatches_by_channel(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(_mismatches().alias("mismatches"))


def channel_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(
        F.sum("label").alias("mismatches"),
        F.count("label").alias("total"),
        (F.sum("label") / F.count("label") * 100).alias("rate"),
    )


def priority_matrix(df: DataFrame) -> DataFrame:
    """Assigned priority against inferred severity; empty cells are 0."""
    return (
        df.groupBy("priority").pivot("inferred_severity", LEVELS).agg(F.count("severity_delta")).na.fill(0)
    )


def ordered_priority_matrix(df: DataFrame) -> DataFrame:
    """The same with a row for every level, in order."""
    cells = priority_matrix(df.where(F.col("priority").isin(LEVELS)))
    levels = level_table(df.sparkSession).withColumnRenamed("level", "priority")
    return levels.join(F.broadcast(cells), "priority", "left").na.fill(0).orderBy("rank").drop("rank")


def type_volumes(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("ticket_type").agg(
        F.count("mismatch_label").alias("total"), _mismatches().alias("mismatches")
    )
    return grouped.withColumn("mismatch_rate", rounded(F.col("mismatches") / F.col("total") * 100, 1))


def box_statistics(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Five-number summary per group and the 1.5 IQR whisker ends.

    Equal values are counted once, and everything else works on the stored counts.
    """
    names = ["minimum", "q1", "median", "q3", "maximum"]
    counts = kept(value_counts(df, value_col, [group_col]), "value-counts")
    boxes = kept(quantiles_of_counts(counts, [0.0, 0.25, 0.5, 0.75, 1.0], names, [group_col]), "boxes")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = boxes.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    value = F.col("_v").cast(dict(df.dtypes)[value_col])
    ends = (
        counts.join(fenced.select(group_col, "_low", "_high"), group_col)
        .where(value.between(F.col("_low"), F.col("_high")))
        .groupBy(group_col)
        .agg(F.min(value).alias("lower_whisker"), F.max(value).alias("upper_whisker"))
    )
    return boxes.join(ends, group_col).select(
        group_col, *names, "lower_whisker", "upper_whisker"
    )


def hours_box_by(df: DataFrame, group_col: str, limit: float | None = 200.0) -> DataFrame:
    cases = df if limit is None else keep_short_cases(df, limit)
    return box_statistics(cases.select(group_col, "resolution_hours"), "resolution_hours", group_col)


def level_ranks(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "inferred_rank": level_rank(F.col("inferred_severity")),
            "assigned_rank": level_rank(F.col("priority")),
        }
    )


def mean_hours(df: DataFrame, priority: str) -> DataFrame:
    return df.where(F.col("priority") == priority).agg(
        F.lit(priority).alias("priority"), F.avg("resolution_hours").alias("mean_hours")
    )
