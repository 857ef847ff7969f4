"""Signal C: severity from lexicon hits, patterns and typographic marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.levels import best_level
from prioscope.functions.numbers import rounded
from prioscope.functions import text as T
from prioscope.settings import FULL, NEGATED_HIT, QUIET_BONUS, Profile

KEYWORD_FEATURES = {
    "critical_kw_hits": "critical",
    "high_kw_hits": "high",
    "medium_kw_hits": "medium",
    "low_kw_hits": "low",
}
FEATURES = [
    *KEYWORD_FEATURES,
    "escalation_hits",
    "business_impact_hits",
    "quantifier_hits",
    "caps_word_count",
    "exclamation_count",
    "text_length_norm",
]


def weighted_hits(
    df: DataFrame, text_col: str, lexicons: dict[str, list[str]], once: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add one column per lexicon: hits count 1, hits after a negation 0.2.

    Lexicons in ``once`` count each of their keywords at most once, negated or not.
    One pass over the text finds the hits of all lexicons; the look-behind pass
    only runs on rows that have a hit at all.
    """
    text, once = F.col(text_col), once or {}
    words = list(dict.fromkeys(w for lexicon in lexicons.values() for w in lexicon))
    more = [w for lexicon in once.values() for w in lexicon if w not in words]
    kept = df.columns
    df = df.withColumn("_hits", T.keyword_hits(text, words + more))
    df = df.withColumn("_negated", F.when(F.size("_hits") > 0, T.negated_hits(text, words)))
    df = df.select(
        *kept,
        *[
            T.count_of(F.col(kind), lexicon).alias(f"{kind}_{name}")
            for name, lexicon in lexicons.items()
            for kind in ("_hits", "_negated")
        ],
        *[
            T.count_of(F.array_distinct("_hits"), lexicon).alias(name)
            for name, lexicon in once.items()
        ],
    )
    weighted = {}
    for name in lexicons:
        negated = F.coalesce(F.col(f"_negated_{name}"), F.lit(0))
        plain = (F.col(f"_hits_{name}") - negated).cast("double")
        weighted[name] = plain + F.lit(NEGATED_HIT) * negated
    return df.select(*kept, *[c.alias(name) for name, c in weighted.items()], *once)


def with_rule_features(df: DataFrame, text_col: str = "combined_text", profile: Profile = FULL) -> DataFrame:
    """Add every feature as a plain column."""
    raw = F.col(text_col)
    clean = T.normalise(raw) if profile.normalise_text else F.lower(raw)
    lexicons = {name: profile.words(group) for name, group in KEYWORD_FEATURES.items()}
    text = F.col("_clean")
    if profile.escalation_whole_word:
        counted = weighted_hits(
            df.withColumn("_clean", clean), "_clean", lexicons, {"escalation_hits": profile.escalation}
        )
    else:
        counted = weighted_hits(df.withColumn("_clean", clean), "_clean", lexicons).withColumn(
            "escalation_hits", T.count_contained(text, profile.escalation)
        )
    return counted.withColumns(
        {
            "business_impact_hits": T.count_present_patterns(text, profile.impact),
            "quantifier_hits": T.count_present_patterns(text, profile.quantifiers),
            "caps_word_count": T.count_capital_words(raw),
            "exclamation_count": T.count_character(raw, "!"),
            "text_length_norm": F.least(F.length(text) / F.lit(500.0), F.lit(1.0)),
        }
    ).drop("_clean")


def level_scores(profile: Profile = FULL) -> dict[str, Column]:
    """Weighted sums over the feature columns, one per level."""
    scores = {}
    for level, terms in profile.weights.items():
        name, weight = terms[0]
        score = F.col(name) * weight
        for name, weight in terms[1:]:
            score = score + F.col(name) * weight
        scores[level] = score
    quiet = (F.col("critical_kw_hits") == 0) & (F.col("high_kw_hits") == 0)
    scores["Low"] = scores["Low"] + F.when(quiet, F.lit(QUIET_BONUS)).otherwise(F.lit(0.0))
    return scores


def with_level_scores(df: DataFrame, profile: Profile = FULL) -> DataFrame:
    return df.withColumns({f"score_{k.lower()}": v for k, v in level_scores(profile).items()})


def with_margin(df: DataFrame, profile: Profile = FULL) -> DataFrame:
    """Add the lead of the best level over the second, and the sum of all four."""
    columns = [F.col(f"score_{level.lower()}") for level in profile.weights]
    total = columns[0] + columns[1] + columns[2] + columns[3] + F.lit(1e-9)
    descending = F.sort_array(F.array(*columns), asc=False)
    return df.withColumns({"score_margin": descending[0] - descending[1], "score_total": total})


def rule_confidence(margin: Column, total: Column) -> Column:
    bold = F.lit(0.50) + (margin / (total + F.lit(1e-9))) * 2.0
    return rounded(F.greatest(F.lit(0.40), F.least(F.lit(0.95), bold)), 4)


def rule_signal(
    df: DataFrame, text_col: str = "combined_text", profile: Profile = FULL, keep_features: bool = True
) -> DataFrame:
    """Add ``rule_severity``, ``rule_score`` and the ``rule_features`` struct."""
    scored = with_margin(with_level_scores(with_rule_features(df, text_col, profile), profile), profile)
    scores = {level: F.col(f"score_{level.lower()}") for level in profile.weights}
    added = [
        best_level(scores, prefer_severe=True).alias("rule_severity"),
        rule_confidence(F.col("score_margin"), F.col("score_total")).alias("rule_score"),
    ]
    if keep_features:
        added.append(F.struct(*FEATURES).alias("rule_features"))
    return scored.select(*df.columns, *added)


def mean_features(scored: DataFrame) -> DataFrame:
    """Mean of each feature per rule severity."""
    return scored.groupBy("rule_severity").agg(
        *[rounded(F.avg(f"rule_features.{name}"), 3).alias(name) for name in FEATURES]
    )
