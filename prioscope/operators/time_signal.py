"""Signal B: severity from where the resolution time falls among all tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.numbers import rounded
from prioscope.operators.ordering import median, quantiles, quick_quantiles
from prioscope.settings import FULL, Profile

LIMITS = {"q_critical": 0.15, "q_high": 0.35, "q_medium": 0.65}


def usable_logs(df: DataFrame, hours_col: str = "resolution_hours", profile: Profile = FULL) -> DataFrame:
    """(_log): the log hours that the limits are taken over."""
    hours = df.where(F.col(hours_col).isNotNull())
    if profile.fit_positive_only:
        hours = hours.where(F.col(hours_col) > 0)
    return hours.select(F.log1p(hours_col).alias("_log"))


def fit_thresholds(
    df: DataFrame, hours_col: str = "resolution_hours", profile: Profile = FULL, approximate: bool = False
) -> DataFrame:
    """One row with the three limits, taken over log hours."""
    logs = usable_logs(df, hours_col, profile)
    find = quick_quantiles if approximate else quantiles
    return find(logs, "_log", list(LIMITS.values()), list(LIMITS))


def thresholds_in_hours(thresholds: DataFrame) -> DataFrame:
    return thresholds.select(*[F.expm1(c).alias(c.replace("q_", "hours_")) for c in LIMITS])


def log_hours(hours: Column, fill: Column, profile: Profile = FULL) -> Column:
    filled = F.coalesce(hours, fill)
    if profile.fit_positive_only:
        usable = F.when(filled <= 0, F.lit(0.1)).otherwise(filled)
    else:
        usable = F.greatest(filled, F.lit(0.1))
    return F.log1p(usable)


def level_of(value: Column, low: Column, mid: Column, high: Column) -> Column:
    return (
        F.when(value <= low, "Critical").when(value <= mid, "High").when(value <= high, "Medium").otherwise("Low")
    )


def confidence_of(value: Column, low: Column, mid: Column, high: Column) -> Column:
    tiny = F.lit(1e-9)
    in_critical = F.lit(0.70) + (low - value) / (low + tiny) * 0.25
    in_high = F.lit(0.60) + (mid - value) / (mid - low + tiny) * 0.30
    in_medium = F.lit(0.55) + (high - value) / (high - mid + tiny) * 0.25
    in_low = F.lit(0.55) + (value - high) / (value + tiny) * 0.20
    return (
        F.when(value <= low, F.least(F.lit(0.95), in_critical))
        .when(value <= mid, F.least(F.lit(0.90), in_high))
        .when(value <= high, F.least(F.lit(0.85), in_medium))
        .otherwise(F.least(F.lit(0.85), in_low))
    )


def time_signal(
    df: DataFrame,
    hours_col: str = "resolution_hours",
    thresholds: DataFrame | None = None,
    profile: Profile = FULL,
    filled: bool = False,
) -> DataFrame:
    """Add ``rt_severity``, ``rt_score`` and ``rt_log``.

    Without stored thresholds they are fitted on ``df`` itself. Both the limits and
    the median are one-row subqueries, and drop out of plans that do not use them.
    ``filled`` says that the hours have no gaps, as after cleaning.
    """
    limits = fit_thresholds(df, hours_col, profile) if thresholds is None else thresholds
    row = limits.select(F.struct(*LIMITS).alias("limits")).scalar()
    fill = F.col(hours_col) if filled else median(df, hours_col).scalar()
    prepared = df.withColumns({"_limits": row, "rt_log": log_hours(F.col(hours_col), fill, profile)})
    value = F.col("rt_log")
    low, mid, high = (F.col(f"_limits.{name}") for name in LIMITS)
    score = confidence_of(value, low, mid, high)
    return prepared.select(
        *df.columns,
        level_of(value, low, mid, high).alias("rt_severity"),
        (rounded(score, 4) if profile.round_time_score else score).alias("rt_score"),
        "rt_log",
    )
