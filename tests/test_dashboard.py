"""Answers worked out from the one-scan counts against the single queries, and a plan with one scan."""

import pytest
from pyspark.sql import functions as F

from prioscope.operators import breakdowns, dashboard, fusion
from prioscope.plans.catalog import labeled
from prioscope.sources.staging import kept

ANSWERS = {
    "mismatch_rate_by_priority": breakdowns.mismatch_rate_by_priority,
    "type_counts": breakdowns.type_counts,
    "mismatches_by_channel": breakdowns.mismatches_by_channel,
    "channel_rates": breakdowns.channel_rates,
    "priority_matrix": breakdowns.priority_matrix,
    "type_volumes": breakdowns.type_volumes,
    "label_summary": fusion.label_summary,
    "pairwise_agreement": fusion.pairwise_agreement,
    "decisive_votes": fusion.decisive_votes,
}


def same(found, wanted):
    assert found.columns == wanted.columns
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert rows(found) == rows(wanted)


@pytest.fixture(scope="module")
def table(spark, folder):
    """The labeled tickets, some with nulls."""
    some = F.crc32(F.col("ticket_id").cast("binary"))
    df = labeled(spark, folder)
    holes = {"channel": 7, "severity_delta": 11, "label": 13, "signal_agreement": 17}
    return df.withColumns({c: F.when(some % n != 0, F.col(c)) for c, n in holes.items()})


@pytest.fixture(scope="module")
def counts(table):
    return kept(dashboard.dashboard_counts(table), "dashboard")


@pytest.mark.parametrize("name", ANSWERS)
def test_answers_equal_the_single_queries(table, counts, name):
    same(getattr(dashboard, name)(counts), ANSWERS[name](table))


@pytest.mark.parametrize("column", ["priority", "inferred_severity", "channel", "ticket_type", "mismatch_type"])
def test_counts_equal_the_single_queries(table, counts, column):
    same(dashboard.counts_by(counts, column), breakdowns.counts_by(table, column))


def test_one_scan_and_one_shuffle(spark, folder):
    plan = dashboard.dashboard_counts(labeled(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "subject" not in plan


def test_empty_table(table):
    rows = dashboard.dashboard_counts(table.where("false")).collect()
    assert [(r.question, r.total) for r in rows] in ([], [("all", 0)])
