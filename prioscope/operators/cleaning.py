"""Ticket cleaning: from any raw table with some of the known columns to the fixed contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.numbers import to_hours
from prioscope.functions.text import capitalize, strip
from prioscope.operators.ordering import number_as_read, number_by, quantiles_of_counts, value_counts
from prioscope.settings import DEFAULT_HOURS, LEVELS, PRIORITY_SYNONYMS, SOURCE_COLUMNS
from prioscope.sources.staging import kept

OPTIONAL_COLUMNS = ["channel", "ticket_type", "customer_email", "product"]


def to_internal_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})


def to_source_names(df: DataFrame) -> DataFrame:
    back = {v: k for k, v in SOURCE_COLUMNS.items() if v in df.columns}
    if "resolution_hours" in df.columns:
        back["resolution_hours"] = "Resolution Time"
    return df.withColumnsRenamed(back)


def with_ticket_ids(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """``TKT-00001`` and so on, when the table has no ids."""
    if "ticket_id" in df.columns:
        return df
    numbered = number_by(df, order_col, "_nr") if order_col else number_as_read(df, "_nr")
    return numbered.withColumn("ticket_id", F.format_string("TKT-%05d", "_nr")).drop("_nr")


def clean_text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def clean_optional(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("Unknown")
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("Unknown")))


def standard_priority(c: Column) -> Column:
    level = capitalize(strip(c))
    named = F.create_map(*[F.lit(x) for pair in PRIORITY_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, level), level)


def keep_valid_priorities(df: DataFrame) -> DataFrame:
    """Standardise and filter; a table without the column gets Medium throughout."""
    if "priority" not in df.columns:
        return df.withColumn("priority", F.lit("Medium"))
    return df.withColumn("priority", standard_priority(F.col("priority").cast("string"))).where(
        F.col("priority").isin(LEVELS)
    )


def fill_hours(df: DataFrame) -> DataFrame:
    """Parse resolution time and fill gaps with the median of the rows at hand.

    The hours are counted once and stored: the median reads their counts several times.
    """
    if "resolution_time" not in df.columns:
        return df.withColumn("resolution_hours", F.lit(DEFAULT_HOURS))
    dtype = dict(df.dtypes)["resolution_time"]
    parsed = df.withColumn("resolution_hours", to_hours(F.col("resolution_time"), dtype)).drop(
        "resolution_time"
    )
    counts = kept(value_counts(parsed, "resolution_hours", []), "hour-counts")
    middle = quantiles_of_counts(counts, [0.5], ["median"], []).scalar()
    return parsed.withColumn("resolution_hours", F.coalesce("resolution_hours", middle))


def combined_text(subject: Column, description: Column) -> Column:
    return strip(F.concat_ws(" ", F.lower(subject), F.lower(description)))


def clean_tickets(raw: DataFrame, order_col: str | None = None) -> DataFrame:
    """The full contract. Extra columns of the input are kept at the end."""
    df = with_ticket_ids(to_internal_names(raw), order_col)
    extra = [c for c in df.columns if c not in SOURCE_COLUMNS.values()]
    df = df.withColumns({name: clean_text(df, name) for name in ("subject", "description")})
    df = fill_hours(keep_valid_priorities(df))
    df = df.withColumns({name: clean_optional(df, name) for name in OPTIONAL_COLUMNS})
    return df.select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        "subject",
        "description",
        "priority",
        "resolution_hours",
        *OPTIONAL_COLUMNS,
        combined_text(F.col("subject"), F.col("description")).alias("combined_text"),
        *extra,
    )


def cleaning_counts(raw: DataFrame) -> DataFrame:
    """Rows before and after the priority filter, in one pass over one column."""
    df = to_internal_names(raw)
    if "priority" not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
            "rows_after", F.col("rows_before")
        )
    kept = standard_priority(F.col("priority").cast("string")).isin(LEVELS)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after")
    )


def observe_rows(df: DataFrame, observation) -> DataFrame:
    """Count rows as they pass, without a job of their own."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def keep_short_cases(df: DataFrame, limit: float = 200.0) -> DataFrame:
    return df.where(F.col("resolution_hours") <= limit)


def type_for_display(c: Column) -> Column:
    return F.when(c == "", F.lit("Consistent")).otherwise(c)


def preview(df: DataFrame, order_col: str, rows: int = 5) -> DataFrame:
    return df.orderBy(order_col).limit(rows)
