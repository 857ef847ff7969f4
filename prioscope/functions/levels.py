"""Column functions over the ordered severity levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prioscope.settings import LEVELS


def level_rank(level: Column) -> Column:
    """Low 0 to Critical 3; anything else, null included, ranks as Medium."""
    rank = F.when(level == LEVELS[0], 0)
    for position, name in enumerate(LEVELS[1:], start=1):
        rank = rank.when(level == name, position)
    return rank.otherwise(LEVELS.index("Medium"))


def best_level(scores: dict[str, Column], prefer_severe: bool) -> Column:
    """Level with the highest score; ties go up or down the scale as asked."""
    ranked = []
    for level, score in scores.items():
        rank = LEVELS.index(level)
        ranked.append(
            F.struct(
                score.cast("double").alias("score"),
                F.lit(rank if prefer_severe else -rank).alias("tie"),
                F.lit(level).alias("level"),
            )
        )
    return F.array_max(F.array(*ranked))["level"]


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """Text of the first band whose inclusive upper limit holds; the last has no limit."""
    chosen = None
    for limit, text in bands:
        if limit is None:
            return chosen.otherwise(F.lit(text))
        test = value <= limit
        chosen = F.when(test, F.lit(text)) if chosen is None else chosen.when(test, F.lit(text))
    return chosen
