import pytest
from pyspark.sql import Observation, functions as F

from prioscope import settings as S
from prioscope.operators import evidence as E

BASE = {
    "ticket_id": "T1", "subject": "Server down", "description": "production outage, all users affected",
    "priority": "Low", "inferred_severity": "Critical", "mismatch_label": "Mismatch", "mismatch_type": "Hidden Crisis",
    "severity_delta": 3, "fusion_confidence": 0.91, "resolution_hours": 2.0, "rt_severity": "Critical",
    "semantic_severity": "Critical", "semantic_score": 0.8125, "channel": "Email", "ticket_type": "Technical Issue",
}
SCHEMA = (
    "ticket_id string, subject string, description string, priority string, inferred_severity string, mismatch_label string, "
    "mismatch_type string, severity_delta int, fusion_confidence double, resolution_hours double, rt_severity string, "
    "semantic_severity string, semantic_score double, channel string, ticket_type string"
)


def frame(spark, *changes):
    return spark.createDataFrame([{**BASE, **c} for c in changes], SCHEMA)


def one(spark, **change):
    return E.evidence_records(frame(spark, change)).first()


def signals(record):
    return [i.signal for i in record.feature_evidence]


def test_items_in_order(spark):
    r = one(spark)
    assert signals(r) == ["keyword"] * 3 + ["resolution_time", "semantic_embedding"]
    assert [i.value for i in r.feature_evidence[:3]] == ["server down", "production outage", "all users affected"]
    assert [i.source_field for i in r.feature_evidence[:3]] == ["Ticket Subject", "Ticket Description", "Ticket Description"]
    assert r.feature_evidence[3].value == "2.0 hours" and "extremely fast" in r.feature_evidence[3].interpretation
    assert r.feature_evidence[4].value == "Semantic similarity to 'Critical' anchor: 0.812"


@pytest.mark.parametrize(
    "text, left",
    [
        ("nothing here", ["resolution_time", "semantic_embedding"]),
        ("urgent asap hack error", ["keyword"] * 4 + ["resolution_time"]),
        ("urgent asap hack error bug", ["keyword"] * 5),
        ("urgent asap hack error bug crash slow broken", ["keyword"] * 5),
    ],
)
def test_five_items_at_most(spark, text, left):
    assert signals(one(spark, subject="x", description=text)) == left


def test_substrings_and_the_border_count(spark):
    r = one(spark, subject="the data", description="loss at the hackathon")
    assert [i.value for i in r.feature_evidence if i.signal == "keyword"] == ["data loss", "hack"]
    assert {i.source_field for i in r.feature_evidence if i.signal == "keyword"} == {"Ticket Description"}


def test_medium_words_are_no_evidence(spark):
    assert signals(one(spark, subject="help", description="a question")) == ["resolution_time", "semantic_embedding"]


@pytest.mark.parametrize("channel, shown", [("Phone", True), ("phone", True), ("Email", False)])
def test_channel_item(spark, channel, shown):
    r = one(spark, subject="x", description="y", channel=channel)
    assert ("ticket_channel" in signals(r)) == shown
    if shown:
        assert r.feature_evidence[-1].value == channel


@pytest.mark.parametrize(
    "hours, word", [(4.0, "extremely fast"), (4.01, "fast resolution"), (12.0, "fast resolution"), (12.01, "moderate"), (48.0, "moderate"), (48.01, "slow")]
)
def test_hour_bands(spark, hours, word):
    item = one(spark, subject="x", description="y", resolution_hours=hours).feature_evidence[0]
    assert word in item.interpretation and item.value == f"{hours:.1f} hours"


@pytest.mark.parametrize("score, label", [(0.85, "High (85.00%)"), (0.8499, "Medium (84.99%)"), (0.6, "Medium (60.00%)"), (0.5999, "Low (59.99%)")])
def test_confidence_label(spark, score, label):
    assert one(spark, fusion_confidence=score).confidence == label


def test_crisis_text(spark):
    fast, slow = one(spark, resolution_hours=12.0), one(spark, resolution_hours=12.5)
    assert "The 12.0-hour resolution time" in fast.constraint_analysis
    assert "language patterns strongly associated with Critical-level" in slow.constraint_analysis
    assert "a gap of 3 levels." in fast.constraint_analysis and "Low→Critical" in fast.constraint_analysis
    assert fast.constraint_analysis.endswith("affected technical issue requests.")


def test_alarm_text_keeps_the_doubled_word(spark):
    change = {"mismatch_type": "False Alarm", "severity_delta": -3, "priority": "Critical", "inferred_severity": "Low"}
    slow, fast = one(spark, **change, resolution_hours=72.0), one(spark, **change, resolution_hours=71.9)
    assert "over-prioritized by 3 levels levels." in slow.constraint_analysis
    assert "The 72.0-hour resolution time" in slow.constraint_analysis
    assert "type ('Technical Issue') are inconsistent with Critical-level" in fast.constraint_analysis
    single = one(spark, **{**change, "severity_delta": -1})
    assert "over-prioritized by 1 level level." in single.constraint_analysis


def test_model_only_mismatch_reads_as_alarm(spark):
    r = one(spark, mismatch_type="", severity_delta=0)
    assert r.mismatch_type == "" and "over-prioritized by 0 level level." in r.constraint_analysis


def test_subject_is_cut_at_sixty(spark):
    assert f"'{'s' * 60}...'" in one(spark, subject="s" * 99).constraint_analysis


def test_consistent_tickets_have_no_record(spark):
    df = frame(spark, {}, {"ticket_id": "T2", "mismatch_label": "Consistent", "mismatch_type": "", "severity_delta": 0})
    assert [r.ticket_id for r in E.evidence_records(df).collect()] == ["T1"]
    assert {r.ticket_id: r.dossier is None for r in E.with_record(df).collect()} == {"T1": False, "T2": True}
    counts = E.record_counts(df).first()
    assert (counts.made, counts.skipped) == (1, 1)
    seen = Observation("o")
    E.evidence_records(df, observation=seen).collect()
    assert seen.get == {"made": 1, "skipped": 1}


def test_absent_columns_read_as_defaults(spark):
    df = spark.createDataFrame([("Mismatch",)], "mismatch_label string")
    r = E.evidence_records(df).first()
    assert (r.ticket_id, r.assigned_priority, r.mismatch_type, r.confidence) == ("UNKNOWN", "Unknown", "Unknown", "Low (50.00%)")
    assert r.feature_evidence[0].value == "24.0 hours" and r.feature_evidence[1].inferred_severity == "Medium"


def test_flat_items_and_summary(spark):
    records = E.evidence_records(frame(spark, {}))
    flat = E.flat_records(records)
    assert "feature_evidence" not in flat.columns and flat.first().num_evidence_items == 5
    assert E.record_items(records).count() == 5
    assert E.record_summary(records).columns == ["ticket_id", "mismatch_type", "severity_delta", "confidence"]


def test_json_leaves_out_unset_fields(spark):
    text = E.evidence_records(frame(spark, {})).select(F.to_json("feature_evidence").alias("j")).first().j
    assert '"weight":"Critical severity indicator"' in text and "null" not in text


def test_every_item_is_grounded(spark):
    df = frame(spark, {}, {"channel": "PHONE", "subject": "a", "description": "b", "resolution_hours": 0.04}, {"resolution_hours": 1234567.89})
    assert E.ungrounded_items(df).count() == 0
    checks = E.grounding_checks(df)
    assert {r.signal for r in checks.collect()} == {"keyword", "resolution_time", "ticket_channel"}


def test_grounding_rules(spark):
    df = spark.createDataFrame([(100.0, 100.9), (100.0, 101.1), (0.5, 0.505), (0.5, 0.52)], "a double, c double")
    assert [r[0] for r in df.select(E.hours_are_grounded(F.col("a"), F.col("c"))).collect()] == [True, False, True, False]
    row = spark.range(1).select(
        E.keyword_is_grounded(F.lit("Server Down"), F.lit("the SERVER DOWN")), E.keyword_is_grounded(F.lit("up"), F.lit("down")),
        E.channel_is_grounded(F.lit("Phone"), F.lit("pHONE")), E.channel_is_grounded(F.lit("Phone"), F.lit("Chat")),
    ).first()
    assert list(row) == [True, False, True, False]


def test_compact_evidence(spark):
    r = E.evidence_records(frame(spark, {"description": "urgent data loss, crash, error, bug"}), S.COMPACT).first()
    assert signals(r) == ["keyword"] * 3 + ["resolution_time", "semantic_embedding"]
    assert r.confidence == "High (91.0%)" and r.feature_evidence[3].inferred_severity is None
    assert "level(s)" in r.constraint_analysis
