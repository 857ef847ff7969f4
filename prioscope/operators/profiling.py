"""Questions about any clean ticket table: shape, gaps, duplicates, distributions."""

from __future__ import annotations

from itertools import combinations_with_replacement, product

from pyspark.sql import DataFrame, Window, functions as F

from prioscope.functions.numbers import rounded, share
from prioscope.operators.breakdowns import box_statistics
from prioscope.operators.ordering import quantiles
from prioscope.settings import LEVELS
from prioscope.sources.staging import kept

_HEAD = 32
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, with the size of the table."""
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
            for i, (n, t) in enumerate(df.dtypes, start=1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("rows", F.lit(len(df.columns)).alias("columns"), F.inline(listed))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows as text; nulls dropped."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def describe_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, unique, top and freq of text columns; moments and quartiles of numeric ones."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    texts = [c for c in columns if types[c] == "string"]
    numbers = [c for c in columns if types[c].startswith(_NUMERIC)]
    names = ["minimum", "q1", "median", "q3", "maximum"]

    result = []
    if texts:
        result.append(_describe_texts(df, texts))
    if numbers:
        result.append(_describe_numbers(df, numbers, names))
    joined = result[0] if len(result) == 1 else result[0].unionByName(result[1], allowMissingColumns=True)
    absent = [c for c in ("unique", "top", "freq", "mean", "std", *names) if c not in joined.columns]
    return joined.withColumns({c: F.lit(None) for c in absent}).select(
        "column", "count", "unique", "top", "freq", "mean", "std", *names
    )


def _describe_texts(df: DataFrame, texts: list[str]) -> DataFrame:
    """Values are counted by a 128-bit digest. Of the most frequent ones, those whose first characters come
    first are looked up in the table again; their list is short, so the texts themselves stay where they are.
    """
    rows = _long(df, texts).select(
        "column", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), F.col("value")).alias("b"), F.substring("value", 1, _HEAD).alias("head"), "value"
    )
    counts = kept(rows.groupBy("column", "a", "b").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n")), "value-counts")
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.max("n").alias("freq"),
    )
    first = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "head")).alias("first"))
    leading = counts.join(F.broadcast(first), "column").where((F.col("n") == -F.col("first.n")) & (F.col("head") == F.col("first.head")))
    tops = rows.join(kept(leading.select("column", "a", "b"), "leading"), ["column", "a", "b"], "left_semi").groupBy("column").agg(F.min("value").alias("top"))
    return summary.join(F.broadcast(tops), "column").select("column", "count", "unique", "top", "freq")


def _describe_numbers(df: DataFrame, numbers: list[str], names: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in numbers]
    )
    numeric = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
    moments = numeric.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    return moments.join(quantiles(numeric, "v", [0.0, 0.25, 0.5, 0.75, 1.0], names, ["column"]), "column")


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with count and percent."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    long = counted.unpivot(["_rows"], df.columns, "column", "missing_count")
    return long.where(F.col("missing_count") > 0).select(
        "column",
        "missing_count",
        rounded(F.col("missing_count") / F.col("_rows") * 100, 2).alias("missing_percent"),
    )


def total_nulls(df: DataFrame) -> DataFrame:
    empty = [F.col(f"`{c}`").isNull().cast("long") for c in df.columns]
    total = empty[0]
    for e in empty[1:]:
        total = total + e
    return df.agg(F.sum(total).alias("missing_values"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat an earlier combination of ``columns``, and their share."""
    # Rows are told apart by a digest of the columns, so whole texts are not shuffled.
    told = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    groups = df.select(told.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    found = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))
    return found.select(
        "rows",
        "duplicates",
        rounded(share(F.col("duplicates"), F.col("rows")) * 100, 1).alias("duplicate_percent"),
    )


def hours_summary(df: DataFrame, value_col: str = "resolution_hours") -> DataFrame:
    moments = df.agg(
        F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("std"),
        F.min(value_col).alias("minimum"), F.max(value_col).alias("maximum"),
    )
    middle = quantiles(df, value_col, [0.5], ["median"])
    return moments.crossJoin(F.broadcast(middle)).select("mean", "median", "std", "minimum", "maximum")


def percentile_rows(df: DataFrame, value_col: str, percents: list[int]) -> DataFrame:
    """One row per percent."""
    names = [f"p{p}" for p in percents]
    wide = quantiles(df, value_col, [p / 100 for p in percents], names)
    listed = F.array(*[F.struct(F.lit(p).alias("percent"), F.col(n).alias("value")) for p, n in zip(percents, names)])
    return wide.select(F.inline(listed))


def histogram(df: DataFrame, value_col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins are listed too.

    The last bin holds the maximum. A single value gets a range of one around it. With groups,
    equal values are counted first, so that only counts meet the ends of their group.
    """
    by = by or []
    value = F.col(value_col).cast("double")
    rows = df.where(value.isNotNull()).select(*by, value.alias("_v"))
    data = kept(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts") if by else rows.withColumn("_c", F.lit(1))
    ends = data.groupBy(*by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.sum("_c").alias("_n"))
    same = F.col("_a") == F.col("_b")
    ends = ends.where(F.col("_n") > 0).select(
        *by, "_n",
        F.when(same, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
        F.when(same, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"),
    )

    def with_ends(rows: DataFrame) -> DataFrame:
        return rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))

    position = F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins)
    binned = with_ends(data).select(*by, "_c", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
    counted = binned.groupBy(*by, "bin").agg(F.sum("_c").alias("n"))
    every = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_b") - F.col("_a")) / bins
    return every.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_a") + F.col("bin") * width).alias("lower"),
        (F.col("_a") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("_n").alias("rows"),
    )


def density_histogram(df: DataFrame, value_col: str, bins: int) -> DataFrame:
    found = histogram(df, value_col, bins)
    width = F.col("upper") - F.col("lower")
    return found.withColumn("density", F.col("n") / (F.col("rows") * width))


def share_matrix(df: DataFrame, row_col: str, column_col: str = "priority", values: list[str] = LEVELS) -> DataFrame:
    """Row percentages of a crosstab over known column values."""
    cells = df.groupBy(row_col).pivot(column_col, values).agg(F.count(F.lit(1))).na.fill(0)
    total = F.col(f"`{values[0]}`")
    for v in values[1:]:
        total = total + F.col(f"`{v}`")
    return cells.select(row_col, *[(F.col(f"`{v}`") / total * 100).alias(v) for v in values])


def with_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "subject_len": F.length("subject"),
            "desc_len": F.length("description"),
            "combined_len": F.length("combined_text"),
        }
    )


def length_summary(df: DataFrame) -> DataFrame:
    columns = ["subject_len", "desc_len", "combined_len"]
    found = describe_all(with_lengths(df).select(*columns))
    return found.select(
        "column", "count",
        *[rounded(F.col(c), 1).alias(c) for c in ("mean", "std", "minimum", "q1", "median", "q3", "maximum")],
    )


def length_histogram_by_priority(df: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(with_lengths(df), "desc_len", bins, ["priority"])


def length_box_by_priority(df: DataFrame) -> DataFrame:
    return box_statistics(with_lengths(df).select("priority", "desc_len"), "desc_len", "priority")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, long form, one pass.

    Only the upper triangle of the matrix is summed up; its mirror image reads the same numbers.
    """
    number = {pair: i for i, pair in enumerate(combinations_with_replacement(columns, 2))}
    wide = df.agg(
        *[rounded(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 3).alias(f"c{i}") for (a, b), i in number.items()]
    )
    listed = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{number.get((a, b), number.get((b, a)))}").alias("correlation"))
            for a, b in product(columns, columns)
        ]
    )
    return wide.select(F.inline(listed))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows per value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def equal_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Histogram with the mean of the column beside it."""
    return histogram(df, column, bins).crossJoin(F.broadcast(df.agg(F.avg(column).alias("mean"))))
