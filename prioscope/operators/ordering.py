"""Exact ranks, running sums and quantiles without a global sort in one task.

A value is cut into two coarse digits that keep its order. Totals per digit are
small tables, so offsets come from them, and only rows that share both digits
are ever sorted together. Equal values are pre-aggregated to one row first, so a
value held by a third of all rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prioscope.sources.staging import kept

_FIRST_DIGIT = 1024
_SECOND_DIGIT = 65536
_TIE_ROWS = 4096


def _digits(value: Column) -> tuple[Column, Column]:
    number = value.cast("double")
    scaled = F.signum(number) * F.log1p(F.abs(number)) * _FIRST_DIGIT
    finite = F.when(number == float("inf"), F.lit(1e6)).when(
        number == float("-inf"), F.lit(-1e6)
    ).otherwise(scaled)
    first = F.floor(finite)
    return first, F.floor((finite - first) * _SECOND_DIGIT)


def coarse_digit(value: Column) -> Column:
    """A whole number that keeps the order of the values; about a thousand of them for each e-fold."""
    return _digits(value)[0]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def running_sums(
    counts: DataFrame, value_col: str, sum_cols: list[str], by: list[str] | None = None
) -> DataFrame:
    """Add ``before_<c>`` (sum over smaller values) and ``all_<c>`` per group ``by``.

    ``counts`` must hold one row per group and value.
    """
    by = by or []
    first, second = _digits(F.col(value_col))
    rows = counts.withColumns({"_d1": first, "_d2": second})

    fine = rows.groupBy(*by, "_d1", "_d2").agg(*[F.sum(c).alias(f"_f_{c}") for c in sum_cols])
    coarse = fine.groupBy(*by, "_d1").agg(*[F.sum(f"_f_{c}").alias(f"_c_{c}") for c in sum_cols])

    def earlier(c: str, keys: list[str], order: str) -> Column:
        span = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(span), F.lit(0))

    coarse = coarse.select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        F.col("_d1").alias("_k_d1"),
        *[earlier(f"_c_{c}", by, "_d1").alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_c_{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in sum_cols],
    )
    match = F.col("_d1") == F.col("_k_d1")
    for key in by:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    offsets = fine.join(coarse, match).select(
        *[F.col(k).alias(f"_p_{k}") for k in by],
        F.col("_d1").alias("_p_d1"),
        F.col("_d2").alias("_p_d2"),
        *[
            (F.col(f"_o_{c}") + earlier(f"_f_{c}", [*by, "_d1"], "_d2")).alias(f"_o_{c}")
            for c in sum_cols
        ],
        *[f"all_{c}" for c in sum_cols],
    )

    inner = rows.withColumns(
        {f"_w_{c}": earlier(c, [*by, "_d1", "_d2"], value_col) for c in sum_cols}
    )
    place = (F.col("_d1") == F.col("_p_d1")) & (F.col("_d2") == F.col("_p_d2"))
    for key in by:
        place = place & F.col(key).eqNullSafe(F.col(f"_p_{key}"))
    return inner.join(offsets, place).select(
        *counts.columns,
        *[(F.col(f"_o_{c}") + F.col(f"_w_{c}")).alias(f"before_{c}") for c in sum_cols],
        *[f"all_{c}" for c in sum_cols],
    )


def quantiles(
    df: DataFrame, value_col: str, shares: list[float], names: list[str], by: list[str] | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per share. NaN and null do not count."""
    by = by or []
    return quantiles_of_counts(value_counts(df, value_col, by), shares, names, by)


def value_counts(df: DataFrame, value_col: str, by: list[str]) -> DataFrame:
    """(by, _v, _n): how often each number occurs."""
    number = F.col(value_col).cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*by, number.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def quantiles_of_counts(counts: DataFrame, shares: list[float], names: list[str], by: list[str]) -> DataFrame:
    """Quantiles from stored ``value_counts``."""
    return quantiles_of_ranked(running_sums(counts, "_v", ["_n"], by), shares, names, by)


def quantiles_of_ranked(placed: DataFrame, shares: list[float], names: list[str], by: list[str]) -> DataFrame:
    """Quantiles from values with the rows before them (``before__n``) and all rows (``all__n``); only values at the ranks need be there."""
    last = F.col("all__n") - 1

    def at(rank: Column) -> Column:
        hit = (F.col("before__n") <= rank) & (rank < F.col("before__n") + F.col("_n"))
        return F.max(F.when(hit, F.col("_v")))

    ends = []
    for i, s in enumerate(shares):
        position = last * F.lit(float(s))
        ends += [at(F.floor(position)).alias(f"_lo{i}"), at(F.ceil(position)).alias(f"_hi{i}")]
        ends.append(F.max(position - F.floor(position)).alias(f"_fr{i}"))
    bounds = placed.groupBy(*by).agg(*ends)

    def between(i: int) -> Column:
        low, high, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        return (
            F.when(low == high, low)
            .when(part < 0.5, low + (high - low) * part)
            .otherwise(high - (high - low) * (1 - part))
        )

    return bounds.select(*by, *[between(i).alias(name) for i, name in enumerate(names)])


def quick_quantiles(
    df: DataFrame, value_col: str, shares: list[float], names: list[str], by: list[str] | None = None,
    accuracy: int = 100_000,
) -> DataFrame:
    """One-pass quantiles; the rank is off by at most rows / accuracy."""
    by = by or []
    found = df.groupBy(*by).agg(
        F.percentile_approx(
            F.col(value_col).cast("double"), F.array(*[F.lit(float(s)) for s in shares]), F.lit(accuracy)
        ).alias("_q")
    )
    return found.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def median(df: DataFrame, value_col: str, name: str = "median") -> DataFrame:
    return quantiles(df, value_col, [0.5], [name])


def number_by(df: DataFrame, key_col: str, out_col: str) -> DataFrame:
    """Number rows from 1 in the order of a numeric key; NaN comes after all numbers, null last.

    Rows with the same key, NaN or null are numbered as they are stored. A key that very many rows share
    is cut into runs of stored rows; runs are placed by sums of their sizes, so no task ranks more
    than one run of it. Only the keys are ranked; the other columns move once, when the numbers are joined back.
    """
    stored = kept(df.withColumn("_row", F.monotonically_increasing_id()), "to-number")
    key = F.col(key_col).cast("double")
    kind = F.when(key.isNull(), 2).when(F.isnan(key), 1).otherwise(0)
    keys = stored.select(
        "_row", kind.alias("_kind"), F.when(kind == 0, F.col(key_col)).otherwise(F.lit(0).cast(dict(df.dtypes)[key_col])).alias("_key"), F.floor(F.col("_row") / _TIE_ROWS).alias("_cut")
    )
    cells = kept(keys.groupBy("_kind", "_key", "_cut").agg(F.count(F.lit(1)).alias("_n")), "key-cells")
    values = kept(cells.groupBy("_kind", "_key").agg(F.sum("_n").alias("_n")), "key-values")
    numbers, not_a_number = (values.where(F.col("_kind") == k).agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long"))).scalar() for k in (0, 1))
    ranked = running_sums(values.where("_kind = 0"), "_key", ["_n"]).select("_kind", "_key", F.col("before__n").alias("_start"))
    others = values.where("_kind > 0").select("_kind", "_key", (numbers + F.when(F.col("_kind") == 2, not_a_number).otherwise(0)).alias("_start"))
    earlier = Window.partitionBy("_kind", "_key").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.select("_kind", "_key", "_cut", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    starts = within.join(ranked.unionByName(others), ["_kind", "_key"]).select("_kind", "_key", "_cut", (F.col("_start") + F.col("_before")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_kind", "_key", "_cut").orderBy("_row"))
    numbered = keys.withColumn("_place", place).join(starts, ["_kind", "_key", "_cut"]).select("_row", (F.col("_before") + F.col("_place")).alias(out_col))
    return stored.join(numbered, "_row").select(*df.columns, out_col)


def number_values(df: DataFrame, column: str, out_col: str) -> DataFrame:
    """(column, number) of the distinct values in sorted order, from 0, without sorting in one task.

    The sorted table is stored, so that partition and place within it are fixed.
    """
    ordered = kept(df.select(column).distinct().orderBy(column).withColumn("_at", F.monotonically_increasing_id()), "values")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    span = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(span), F.lit(0)).alias("_start"))
    within = F.col("_at") - F.shiftleft(part, 33)
    return ordered.withColumn("_part", part).join(starts, "_part").select(column, (F.col("_start") + within).alias(out_col))


def number_as_read(df: DataFrame, out_col: str) -> DataFrame:
    """Number rows from 1 in scan order, with one count per input partition and no sort.

    Only for a plain file scan, whose partitions come back the same in both passes.
    """
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    span = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(span), F.lit(0)).alias("_start"))
    within = F.col("_m") - F.shiftleft(F.shiftright("_m", 33), 33)
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out_col, F.col("_start") + within + 1)
        .select(*df.columns, out_col)
    )
