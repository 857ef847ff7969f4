"""All counts of the overview page from one scan of the labeled table.

Every question is a grouping set. Rows are expanded as narrow keys and added up before the one
shuffle, so what moves is bounded by the number of groups. The result, a few hundred rows, is what
the answers are worked out from, however many are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.numbers import rounded, share
from prioscope.operators.cleaning import type_for_display
from prioscope.operators.fusion import PAIR_TITLES, SIGNALS
from prioscope.settings import LEVELS

_SEVERITIES = [f"{p}_severity" for p in SIGNALS.values()]
QUESTIONS: dict[str, list[str]] = {
    "all": [],
    "priority": ["priority"],
    "inferred_severity": ["inferred_severity"],
    "channel": ["channel"],
    "ticket_type": ["ticket_type"],
    "mismatch_type": ["mismatch_type"],
    "matrix": ["priority", "inferred_severity"],
    "signals": [*_SEVERITIES, "inferred_severity"],
}
KEYS = ["k1", "k2", "k3", "k4"]
MEASURES = ["total", "mismatches", "labels", "label_sum", "judged", "deltas", "agreements", "agreement_sum"]


def dashboard_counts(df: DataFrame) -> DataFrame:
    """(question, k1 to k4, measures): one row per group of every question.

    ``k1`` and so on are the values of the question's columns in order; those it does not have are null.
    A null value in the data is a group of its own. An empty table has the row of ``all`` only.
    """
    columns = sorted({c for keys in QUESTIONS.values() for c in keys})
    mismatch = F.col("mismatch_label") == "Mismatch"
    grouped = df.groupingSets([[F.col(c) for c in keys] for keys in QUESTIONS.values()], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(mismatch).alias("mismatches"),
        F.count("label").alias("labels"),
        F.sum("label").cast("long").alias("label_sum"),
        F.count("mismatch_label").alias("judged"),
        F.count("severity_delta").alias("deltas"),
        F.count("signal_agreement").alias("agreements"),
        F.sum("signal_agreement").alias("agreement_sum"),
    )
    # grouping_id has a bit for every column, the first one highest, set where the question leaves it out.
    number = {q: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in keys) for q, keys in QUESTIONS.items()}

    def pick(value_of) -> Column:
        chosen = F.lit(None).cast("string")
        for q, keys in QUESTIONS.items():
            chosen = F.when(F.col("_set") == number[q], value_of(q, keys)).otherwise(chosen)
        return chosen

    key = lambda i: lambda q, keys: F.col(keys[i]) if i < len(keys) else F.lit(None).cast("string")
    return grouped.select(pick(lambda q, _: F.lit(q)).alias("question"), *[pick(key(i)).alias(k) for i, k in enumerate(KEYS)], *MEASURES)


def _groups(counts: DataFrame, question: str) -> DataFrame:
    named = [F.col(k).alias(c) for k, c in zip(KEYS, QUESTIONS[question])]
    return counts.where(F.col("question") == question).select(*named, *MEASURES)


def counts_by(counts: DataFrame, column: str) -> DataFrame:
    return _groups(counts, column).select(column, F.col("total").alias("n")).orderBy(F.desc("n"), column)


def mismatch_rate_by_priority(counts: DataFrame) -> DataFrame:
    return _groups(counts, "priority").select("priority", (F.col("mismatches") / F.col("total") * 100).alias("mismatch_rate"))


def type_counts(counts: DataFrame) -> DataFrame:
    shown = _groups(counts, "mismatch_type").withColumn("mismatch_type", type_for_display(F.col("mismatch_type")))
    return shown.groupBy("mismatch_type").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), "mismatch_type")


def mismatches_by_channel(counts: DataFrame) -> DataFrame:
    return _groups(counts, "channel").select("channel", "mismatches")


def channel_rates(counts: DataFrame) -> DataFrame:
    rate = F.col("label_sum") / F.col("labels") * 100
    return _groups(counts, "channel").select("channel", F.col("label_sum").alias("mismatches"), F.col("labels").alias("total"), rate.alias("rate"))


def priority_matrix(counts: DataFrame) -> DataFrame:
    return _groups(counts, "matrix").groupBy("priority").pivot("inferred_severity", LEVELS).agg(F.sum("deltas")).na.fill(0)


def type_volumes(counts: DataFrame) -> DataFrame:
    rate = rounded(F.col("mismatches") / F.col("judged") * 100, 1)
    return _groups(counts, "ticket_type").select("ticket_type", F.col("judged").alias("total"), "mismatches", rate.alias("mismatch_rate"))


def label_summary(counts: DataFrame) -> DataFrame:
    of_type = lambda name: F.coalesce(F.sum(F.when(F.col("k1") == name, F.col("total"))), F.lit(0))
    types = counts.where("question = 'mismatch_type'").agg(of_type("Hidden Crisis").alias("hidden_crisis"), of_type("False Alarm").alias("false_alarm"))
    return _groups(counts, "all").crossJoin(F.broadcast(types)).select(
        "total",
        "mismatches",
        rounded(share(F.col("mismatches"), F.col("total")) * 100, 1).alias("mismatch_percent"),
        "hidden_crisis",
        "false_alarm",
        (F.col("total") - F.col("mismatches")).alias("consistent"),
        rounded(F.col("agreement_sum") / F.when(F.col("agreements") > 0, F.col("agreements")), 4).alias("mean_agreement"),
    )


def pairwise_agreement(counts: DataFrame) -> DataFrame:
    """At most one row per combination of four levels is read."""
    agreed = lambda a, b: F.sum(F.when(F.col(a) == F.col(b), F.col("total")).otherwise(0)) / F.sum("total")
    rates = _groups(counts, "signals").agg(*[rounded(agreed(a, b), 4).alias(title) for a, b, title in PAIR_TITLES])
    return rates.unpivot([], [t for _, _, t in PAIR_TITLES], "signal_pair", "agreement_rate")


def decisive_votes(counts: DataFrame) -> DataFrame:
    backs = {p: F.col(f"{p}_severity") == F.col("inferred_severity") for p in SIGNALS.values()}
    alone = {}
    for prefix, own in backs.items():
        for other in (c for p, c in backs.items() if p != prefix):
            own = own & ~other
        alone[prefix] = F.coalesce(F.sum(F.when(own, F.col("total"))), F.lit(0))
    counted = _groups(counts, "signals").agg(*[c.alias(p) for p, c in alone.items()])
    every = sum((F.col(p) for p in alone), F.lit(0))
    return counted.withColumn("_all", every).unpivot(["_all"], list(alone), "signal", "decisive_votes").select(
        "signal", "decisive_votes", rounded(share(F.col("decisive_votes"), F.col("_all")) * 100, 1).alias("contribution_percent")
    )
