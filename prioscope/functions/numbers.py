"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prioscope.functions.text import strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"^[+-]?(?i:inf|infinity)$"


def to_hours(c: Column, dtype: str) -> Column:
    """Double from any column; text that is not a plain number, and NaN, become null.

    The pattern guards the cast, which alone would take type suffixes and hexadecimals.
    """
    if dtype != "string":
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    bare = strip(c)
    return (
        F.when(F.rlike(bare, F.lit(_NUMBER)), bare.try_cast("double"))
        .when(
            F.rlike(bare, F.lit(_INFINITY)),
            F.when(F.startswith(bare, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
        )
    )


def rounded(c: Column, decimals: int) -> Column:
    """Round; ties go to the even digit."""
    return F.bround(c, decimals)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null on an empty whole."""
    return F.when(whole != 0, part / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole, 0 on an empty whole."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))
