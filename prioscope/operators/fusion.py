"""Fusion of the three signals, mismatch labels, and statistics about the signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.levels import best_level, level_rank
from prioscope.functions.numbers import rounded, share
from prioscope.settings import FAST_AGREEMENT, LEVELS, SIGNAL_WEIGHTS

SIGNALS = {"semantic": "semantic", "resolution_time": "rt", "rule_based": "rule"}
PAIR_TITLES = [
    ("semantic_severity", "rt_severity", "Semantic vs RT"),
    ("semantic_severity", "rule_severity", "Semantic vs Rule"),
    ("rt_severity", "rule_severity", "RT vs Rule"),
    ("semantic_severity", "inferred_severity", "Semantic vs Fused"),
    ("rt_severity", "inferred_severity", "RT vs Fused"),
    ("rule_severity", "inferred_severity", "Rule vs Fused"),
]


def level_votes(weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Weighted confidence each level collects from the three signals."""
    chosen = weights or SIGNAL_WEIGHTS
    votes = {}
    for level in LEVELS:
        vote = F.lit(0.0)
        for name, prefix in SIGNALS.items():
            backs = F.col(f"{prefix}_severity") == level
            vote = vote + F.when(backs, F.lit(chosen[name]) * F.col(f"{prefix}_score")).otherwise(F.lit(0.0))
        votes[level] = vote
    return votes


def with_votes(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return df.withColumns({f"vote_{k.lower()}": v for k, v in level_votes(weights).items()})


def fuse_signals(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``inferred_severity``, ``fusion_confidence`` and ``signal_agreement``."""
    voted = with_votes(df, weights)
    votes = {level: F.col(f"vote_{level.lower()}") for level in LEVELS}
    columns = list(votes.values())
    total = columns[0] + columns[1] + columns[2] + columns[3] + F.lit(1e-9)
    decided = voted.withColumn("inferred_severity", best_level(votes, prefer_severe=False))
    agreeing = F.lit(0)
    for prefix in SIGNALS.values():
        same = F.col(f"{prefix}_severity") == F.col("inferred_severity")
        agreeing = agreeing + F.when(same, 1).otherwise(0)
    return decided.select(
        *df.columns,
        "inferred_severity",
        rounded(F.greatest(*columns) / total, 4).alias("fusion_confidence"),
        rounded(agreeing / F.lit(3.0), 4).alias("signal_agreement"),
    )


def label_mismatch(df: DataFrame, assigned_col: str = "priority", inferred_col: str = "inferred_severity") -> DataFrame:
    """Add the label, its type, the signed gap in levels, and the binary label."""
    delta = level_rank(F.col(inferred_col)) - level_rank(F.col(assigned_col))
    gapped = df.withColumn("severity_delta", delta)
    gap = F.col("severity_delta")
    return gapped.select(
        *df.columns,
        F.when(gap == 0, "Consistent").otherwise("Mismatch").alias("mismatch_label"),
        F.when(gap == 0, "").when(gap > 0, "Hidden Crisis").otherwise("False Alarm").alias("mismatch_type"),
        "severity_delta",
        (gap != 0).cast("int").alias("label"),
    )


def fast_fusion(df: DataFrame) -> DataFrame:
    """Rule severity as the inferred one; the text signal columns are copies of it."""
    return df.withColumns(
        {
            "inferred_severity": F.col("rule_severity"),
            "fusion_confidence": F.col("rule_score"),
            "signal_agreement": F.lit(FAST_AGREEMENT),
            "semantic_severity": F.col("rule_severity"),
            "semantic_score": F.col("rule_score"),
        }
    )


def rule_only_prediction(df: DataFrame) -> DataFrame:
    """Prediction columns when no model is at hand."""
    sure = F.when(F.col("mismatch_label") == "Mismatch", F.col("rule_score")).otherwise(
        1 - F.col("rule_score")
    )
    return df.withColumns(
        {
            "predicted_label": F.col("mismatch_label"),
            "prediction_confidence": sure,
            "mismatch_probability": F.col("rule_score"),
        }
    )


def label_summary(df: DataFrame) -> DataFrame:
    found = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("mismatch_label") == "Mismatch").alias("mismatches"),
        F.count_if(F.col("mismatch_type") == "Hidden Crisis").alias("hidden_crisis"),
        F.count_if(F.col("mismatch_type") == "False Alarm").alias("false_alarm"),
        F.avg("signal_agreement").alias("mean_agreement"),
    )
    return found.select(
        "total",
        "mismatches",
        rounded(share(F.col("mismatches"), F.col("total")) * 100, 1).alias("mismatch_percent"),
        "hidden_crisis",
        "false_alarm",
        (F.col("total") - F.col("mismatches")).alias("consistent"),
        rounded(F.col("mean_agreement"), 4).alias("mean_agreement"),
    )


def _agreement(a: str, b: str) -> Column:
    return rounded(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)), 4)


def pairwise_agreement(df: DataFrame) -> DataFrame:
    """Share of tickets on which two severities agree, six pairs, one pass."""
    rates = df.agg(*[_agreement(a, b).alias(title) for a, b, title in PAIR_TITLES])
    return rates.unpivot([], [t for _, _, t in PAIR_TITLES], "signal_pair", "agreement_rate")


def decisive_votes(df: DataFrame) -> DataFrame:
    """How often one signal alone backs the fused level, with its share in percent."""
    backs = {p: F.col(f"{p}_severity") == F.col("inferred_severity") for p in SIGNALS.values()}
    alone = {}
    for prefix, own in backs.items():
        others = [~other for name, other in backs.items() if name != prefix]
        alone[prefix] = F.count_if(own & others[0] & others[1])
    counted = df.agg(*[c.alias(p) for p, c in alone.items()]).withColumn(
        "_all", sum((F.col(p) for p in alone), F.lit(0))
    )
    return counted.unpivot(["_all"], list(alone), "signal", "decisive_votes").select(
        "signal",
        "decisive_votes",
        rounded(share(F.col("decisive_votes"), F.col("_all")) * 100, 1).alias("contribution_percent"),
    )


def signal_agreement(df: DataFrame) -> DataFrame:
    """One row, one column per pair of the severities that are present."""
    present = {n: f"{p}_severity" for n, p in SIGNALS.items() if f"{p}_severity" in df.columns}
    names = list(present)
    pairs = {
        f"{a}_vs_{b}": (present[a], present[b])
        for i, a in enumerate(names)
        for b in names[i + 1:]
    }
    if "inferred_severity" in df.columns:
        pairs.update({f"{n}_vs_fused": (c, "inferred_severity") for n, c in present.items()})
    return df.agg(*[_agreement(a, b).alias(n) for n, (a, b) in pairs.items()])
