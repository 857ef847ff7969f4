import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import fuse, similarities
from prioscope import settings as S
from prioscope.functions.vectors import cosine
from prioscope.operators import fusion, ordering
from prioscope.operators import text_signal as A
from prioscope.operators import time_signal as B


def hours_frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, resolution_hours double")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(2, 1.5, 700), np.full(350, 7.25), -rng.random(20), [0.0]])
    shares = [0.0, 0.1, 0.15, 0.35, 0.5, 0.65, 0.95, 1.0]
    names = [f"q{i}" for i in range(len(shares))]
    row = ordering.quantiles(hours_frame(spark, values.tolist()), "resolution_hours", shares, names).first()
    assert list(row) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def test_quantiles_by_group_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("c", None)], "g string, v double")
    rows = {r.g: r.m for r in ordering.quantiles(df, "v", [0.5], ["m"], ["g"]).collect()}
    assert rows == {"a": 2.5, "b": 2.0}
    assert ordering.median(df.where("v > 9"), "v").first().median is None


def test_running_sums_and_numbering(spark):
    rng = random.Random(5)
    keys = rng.sample(range(10**12), 500) + list(range(5))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    rows = ordering.number_by(df, "k", "n").collect()
    assert {r.k: r.n for r in rows} == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_a_key_of_a_third_of_all_rows_is_numbered_in_runs(spark):
    df = spark.range(0, 60_000, 1, 6).selectExpr("id", "if(id % 3 = 0, 777, 9007199254740993 + id) AS k")
    numbered = ordering.number_by(df, "k", "n")
    rows = numbered.collect()
    assert sorted(r.n for r in rows) == list(range(1, 60_001))
    assert {r.n for r in rows if r.k == 777} == set(range(1, 20_001))
    assert [r.id for r in sorted(rows, key=lambda r: r.n)][20_000:] == [i for i in range(60_000) if i % 3]
    # The windows that see rows are cut by run as well as by key.
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "row_number" in line and "_cut" in line]


def moved(df) -> list[str]:
    """The columns that each exchange of the plan moves."""
    text = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"^\(\d+\) (?:Broadcast)?Exchange.*\nInput[^:]*: (.*)", text, re.M)


def test_similarities_come_back_without_moving_texts(spark):
    from prioscope.plans.audit import label_tickets

    rows = [(f"T{i}", f"word{i % 7} system down server", "Low", "Email", float(i + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "ticket_id string, combined_text string, priority string, channel string, resolution_hours double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for out in (A.semantic_signal(df), label_tickets(df)):
            assert A.ROW not in out.columns and "combined_text" in out.columns
            assert moved(out) and not [line for line in moved(out) if "combined_text" in line]
            assert out.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vocabulary_that_needs_a_second_count(spark):
    from prioscope.operators.features import vocabulary

    texts = [" ".join(f"w{(i * j) % 50}" for j in range(1, 30)) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "combined_text string")
    want = [tuple(r) for r in vocabulary(df, size=40).collect()]
    for cells in (1, 3, 64):  # few cells say little about their terms
        assert [tuple(r) for r in vocabulary(df, size=40, cells=cells).collect()] == want


def test_most_frequent_texts_by_digest(spark):
    from prioscope.operators.profiling import describe_all

    long = "x" * 40
    rows = [(long + "b", f"id{i}", None) for i in range(3)] + [(long + "a", f"id{i + 3}", None) for i in range(3)] + [("zz", "id9", None), (None, "id0", None)]
    found = {r["column"]: r for r in describe_all(spark.createDataFrame(rows, "t string, i string, n string")).collect()}
    assert (found["t"]["count"], found["t"]["unique"], found["t"]["top"], found["t"]["freq"]) == (7, 3, long + "a", 3)
    assert (found["i"]["unique"], found["i"]["top"], found["i"]["freq"]) == (7, "id0", 2) and "n" not in found


def test_quick_quantiles_are_close(spark):
    df = hours_frame(spark, [float(i) for i in range(1001)])
    row = ordering.quick_quantiles(df, "resolution_hours", [0.15, 0.65], ["a", "b"]).first()
    assert row.a == pytest.approx(150, abs=2) and row.b == pytest.approx(650, abs=2)


def test_thresholds_are_taken_over_logs_of_positive_hours(spark):
    values = [0.0, -3.0, 1.0, 2.0, 4.0, 8.0, 20.0, 90.0, None]
    row = B.fit_thresholds(hours_frame(spark, values)).first()
    logs = np.log1p([1.0, 2.0, 4.0, 8.0, 20.0, 90.0])
    assert list(row) == pytest.approx(np.percentile(logs, [15, 35, 65]).tolist(), rel=1e-12)


def test_time_signal_bands_and_floor(spark):
    values = [0.0, -3.0, 0.5, 1.0, 3.0, 9.0, 30.0, 100.0, 400.0, None]
    df = hours_frame(spark, values)
    rows = {r.id: r for r in B.time_signal(df).collect()}
    limits = B.fit_thresholds(df).first()
    assert rows[0].rt_log == rows[1].rt_log == pytest.approx(np.log1p(0.1))
    assert rows[0].rt_severity == "Critical" and rows[8].rt_severity == "Low"
    for r in rows.values():
        v = r.rt_log
        if v <= limits.q_critical:
            want = min(0.95, 0.70 + (limits.q_critical - v) / (limits.q_critical + 1e-9) * 0.25)
        elif v <= limits.q_high:
            want = min(0.90, 0.60 + (limits.q_high - v) / (limits.q_high - limits.q_critical + 1e-9) * 0.30)
        elif v <= limits.q_medium:
            want = min(0.85, 0.55 + (limits.q_medium - v) / (limits.q_medium - limits.q_high + 1e-9) * 0.25)
        else:
            want = min(0.85, 0.55 + (v - limits.q_medium) / (v + 1e-9) * 0.20)
        assert r.rt_score == pytest.approx(want, abs=1e-4)
    assert rows[9].rt_log == pytest.approx(np.log1p(np.median([v for v in values if v is not None])))


def test_stored_thresholds_are_not_refitted(spark):
    fitted = B.fit_thresholds(hours_frame(spark, [1.0, 2.0, 3.0, 50.0, 60.0]))
    rows = B.time_signal(hours_frame(spark, [1000.0, 2000.0]), thresholds=fitted).collect()
    assert {r.rt_severity for r in rows} == {"Low"}


def test_tfidf_equals_brute_force(spark):
    rng = random.Random(11)
    words = [w for l in S.LEVELS for s in S.ANCHORS[l] for w in s.lower().strip(".?").split()] + ["zeta", "omega", "a", "é", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 20))) for _ in range(150)] + ["", "zz qq"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ticket_id string, combined_text string")
    wanted = similarities(texts)
    scored = {r.ticket_id: r for r in A.semantic_signal(df).collect()}
    assert len(scored) == len(texts)
    for i, sims in enumerate(wanted):
        row = scored[str(i)]
        assert row.semantic_score == pytest.approx(max(sims), abs=1e-9)
        ordered = sorted(sims)
        if ordered[3] - ordered[2] > 1e-9 or ordered[3] == 0:
            assert row.semantic_severity == S.LEVELS[sims.index(ordered[3])]


def test_tfidf_with_rare_and_common_terms_gives_the_same(spark, monkeypatch):
    texts = [f"system w{i % 7} unique{i} the service is very slow" for i in range(60)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ticket_id string, combined_text string")
    monkeypatch.setattr(A, "MAX_COMMON_TERMS", 3)
    rows = {r.ticket_id: r for r in A.semantic_signal(df).collect()}
    for i, sims in enumerate(similarities(texts)):
        assert rows[str(i)].semantic_score == pytest.approx(max(sims), abs=1e-9)


def test_tfidf_with_shared_ids_and_copies(spark):
    pairs = [("a", "server is down"), ("a", "change my profile"), ("b", "server is down"), ("b", "server is down"), ("c", "the the end")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ticket_id string, combined_text string")
    rows = {r.i: r for r in A.semantic_signal(df).collect()}
    assert len(rows) == 5
    for i, sims in enumerate(similarities([t for _, t in pairs])):
        assert rows[i].semantic_score == pytest.approx(max(sims), abs=1e-9)


def test_vector_mode(spark):
    anchors = spark.createDataFrame(
        [(0, "Low", [1.0, 0.0]), (1, "Medium", [0.0, 1.0]), (2, "High", [1.0, 0.0])], "rank int, level string, anchor array<double>"
    )
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.1, 3.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    rows = {r.id: r for r in A.semantic_signal(df, "embedding", vector_col="v", anchors=anchors).collect()}
    assert rows[1].semantic_severity == "Low"  # a tie goes to the lower rank
    assert rows[2].semantic_severity == "Medium"
    assert rows[3].semantic_severity == "Low" and rows[3].semantic_score == pytest.approx(1 / 3, abs=1e-4)
    e = np.exp(10 * np.array([1.0, 0.0, 1.0]))
    assert rows[1].semantic_score == pytest.approx(e.max() / e.sum(), abs=1e-4)


def test_cosine_and_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 0.0])], "g string, v array<double>")
    means = {r.g: r.anchor for r in A.mean_vectors(df, "g", "v").collect()}
    assert means == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    got = [r.c for r in df.select(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()]
    assert got == pytest.approx([1 / 5**0.5, 1 / 5**0.5, 0.0])


def test_embedding_udf_runs_in_batches(spark):
    def make():
        def predict(batch):
            return np.stack([np.array([len(str(t)), 1.0], dtype=np.float32) for t in batch])

        return predict

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 200)], "id int, t string")
    rows = A.embed_texts(df, "t", make, batch_size=16).collect()
    assert all(r.embedding == [float(r.id), 1.0] for r in rows)


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        A.semantic_signal(spark.range(1), "other")


FUSED = "semantic_severity string, semantic_score double, rt_severity string, rt_score double, rule_severity string, rule_score double"


def test_fusion_equals_brute_force(spark):
    rng = random.Random(7)
    cases = [tuple(x for _ in range(3) for x in (rng.choice(S.LEVELS), rng.choice([0.0, 0.4, 0.5, 0.6, 0.9, 1.0]))) for _ in range(300)]
    cases += [("Low", 0.0, "High", 0.0, "Critical", 0.0), ("High", 0.5, "Low", 0.9, "Medium", 0.75)]
    df = spark.createDataFrame(cases, FUSED).withColumn("i", F.monotonically_increasing_id())
    for r in fusion.fuse_signals(df).collect():
        want = fuse((r.semantic_severity, r.semantic_score), (r.rt_severity, r.rt_score), (r.rule_severity, r.rule_score))
        assert r.inferred_severity == want[0]
        assert (r.fusion_confidence, r.signal_agreement) == (pytest.approx(want[1], abs=1.01e-4), want[2])


def test_fusion_tie_goes_to_the_less_severe_level(spark):
    df = spark.createDataFrame([("High", 0.5, "Low", 0.5, "Medium", 0.0)], FUSED)
    even = {"semantic": 0.5, "resolution_time": 0.5, "rule_based": 0.0}
    assert fusion.fuse_signals(df, even).first().inferred_severity == "Low"


def test_labels_for_all_pairs(spark):
    pairs = [(a, i) for a in [*S.LEVELS, "?", None] for i in [*S.LEVELS, "?", None]]
    df = spark.createDataFrame(pairs, "priority string, inferred_severity string")
    order = {l: n for n, l in enumerate(S.LEVELS)}
    for r in fusion.label_mismatch(df).collect():
        gap = order.get(r.inferred_severity, 1) - order.get(r.priority, 1)
        kind = "" if gap == 0 else "Hidden Crisis" if gap > 0 else "False Alarm"
        assert (r.severity_delta, r.mismatch_type, r.label) == (gap, kind, int(gap != 0))
        assert r.mismatch_label == ("Mismatch" if gap else "Consistent")


def test_decisive_votes_without_any_is_null(spark):
    df = spark.createDataFrame([("Low", "Low", "Low", "Low")], "semantic_severity string, rt_severity string, rule_severity string, inferred_severity string")
    rows = fusion.decisive_votes(df).collect()
    assert {r.decisive_votes for r in rows} == {0} and {r.contribution_percent for r in rows} == {None}


def test_agreement_tolerates_absent_signals(spark):
    df = spark.createDataFrame([("Low", "High", "Low"), ("High", "High", "High")], "rt_severity string, rule_severity string, inferred_severity string")
    row = fusion.signal_agreement(df).first().asDict()
    assert row == {"resolution_time_vs_rule_based": 0.5, "resolution_time_vs_fused": 1.0, "rule_based_vs_fused": 0.5}


def test_like_rows_side_by_side_share_their_postings(spark, monkeypatch):
    stored = {}

    def noted(df, name):
        stored[name] = kept(df, name)
        return stored[name]

    from prioscope.sources.staging import kept

    monkeypatch.setattr(A, "kept", noted)
    df = spark.createDataFrame([(i, f"printer jams often office{i % 2}") for i in range(640)], "i int, combined_text string").coalesce(1).orderBy("i")
    rows = A.semantic_signal(df).collect()
    assert len({(r.semantic_severity, r.semantic_score) for r in rows}) <= 2 and len(rows) == 640
    assert stored["run-terms"].count() <= 640 / 32 * 9 + 9
    assert {r.df for r in stored["vocabulary"].where("df > 4").collect()} <= {640, 641, 642, 643, 644, 320, 321, 322, 323, 324}
