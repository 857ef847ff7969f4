import random

import numpy as np
import pytest

from prioscope.operators import breakdowns as G
from prioscope.operators import evaluate as V
from prioscope.operators import fusion
from prioscope.operators import profiling as P
from prioscope.operators.rule_signal import rule_signal
from prioscope.operators.splitting import expected_counts, stratified_split


def predictions(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, probability double")


def brute_auc(rows):
    pos = [p for y, _, p in rows if y == 1]
    neg = [p for y, _, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        p = rng.choice([0.0, 0.1, 0.3, 0.3, 0.5, 0.5000001, 0.9, 1.0, rng.random()])
        rows.append((int(rng.random() < 0.3 + 0.4 * p), int(p >= 0.5), p))
    df = predictions(spark, rows)
    tp, fp = sum(y and q for y, q, _ in rows), sum((not y) and q for y, q, _ in rows)
    fn, tn = sum(y and not q for y, q, _ in rows), sum(not y and not q for y, q, _ in rows)
    r = V.evaluate(df, "m", score="probability").first()
    assert r.confusion_matrix == [[tn, fp], [fn, tp]]
    assert r.accuracy == pytest.approx((tp + tn) / 400, abs=1e-4)
    assert r.per_class.Mismatch.recall == pytest.approx(tp / (tp + fn), abs=1e-4)
    assert r.per_class.Consistent.precision == pytest.approx(tn / (tn + fn), abs=1e-4)
    f1 = (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2
    assert r.macro_f1 == pytest.approx(f1, abs=1e-4)
    assert r.roc_auc == pytest.approx(brute_auc(rows), abs=1e-4)
    assert r.per_class.Mismatch.support == r.n_mismatch == tp + fn


def test_roc_curve_points(spark):
    rows = [(1, 1, 0.9), (0, 1, 0.9), (1, 1, 0.6), (0, 0, 0.2), (0, 0, 0.2)]
    points = {r.threshold: (r.fpr, r.tpr) for r in V.roc_curve(predictions(spark, rows)).collect()}
    assert points == {float("inf"): (0.0, 0.0), 0.9: (pytest.approx(1 / 3), 0.5), 0.6: (pytest.approx(1 / 3), 1.0), 0.2: (1.0, 1.0)}


def test_single_class(spark):
    r = V.evaluate(predictions(spark, [(1, 1, 0.9), (1, 1, 0.4)]), score="probability").first()
    assert r.roc_auc is None and r.accuracy == 1.0 and r.macro_f1 == 1.0
    assert r.per_class.Consistent.recall == 0.0 and not r.overall_pass


def test_no_positive_prediction(spark):
    r = V.evaluate(predictions(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert r.per_class.Mismatch.precision == 0.0 and r.macro_f1 == pytest.approx(1 / 3, abs=1e-4)


def test_compare_models_lists_targets(spark):
    df = predictions(spark, [(1, 1, 0.9), (0, 0, 0.2)])
    rows = V.compare_models([V.evaluate(df, "a"), V.evaluate(df, "b")]).collect()
    assert len(rows) == 8 and {r.target for r in rows} == {0.83, 0.82, 0.78}
    assert all(r.value == 1.0 for r in rows)


# Our own labeled cases: understated outages, overstated trifles, negation, jargon.
CASES = [
    ("c01", "Small favour: the server down light is red and all users affected say hello.", "Low", True, "Hidden Crisis"),
    ("c02", "No hurry, but customers cannot pay and the payment gateway is dead.", "Low", True, "Hidden Crisis"),
    ("c03", "WORST DAY! I need a profile picture change and new settings, also feedback.", "Critical", True, "False Alarm"),
    ("c04", "Kindly add dark colours, a feature request and a suggestion, nice to have.", "High", True, "False Alarm"),
    ("c05", "There is no emergency and nothing is urgent, only a cosmetic preference.", "Critical", True, "False Alarm"),
    ("c06", "It is not a data breach, it is not ransomware, we only ask a question about settings.", "Critical", True, "False Alarm"),
    ("c07", "Elevated latency, then timeout and api error on half of the calls, connection refused.", "Low", True, "Hidden Crisis"),
    ("c08", "Token exchange yields 502, authentication broken, cannot login.", "Medium", True, "Hidden Crisis"),
    ("c09", "Database down, data loss confirmed, revenue loss expected.", "Critical", False, ""),
    ("c10", "Please change my username, a small profile suggestion.", "Low", False, ""),
    ("c11", "The report page is slow and the search is broken, some users wait.", "High", False, ""),
    ("c12", "I am confused, a question on how to export, need clarification and assistance.", "Medium", True, "False Alarm"),
    ("c13", "Everyone in the office is blocked, complete outage since noon, asap please.", "Medium", True, "Hidden Crisis"),
    ("c14", "Our auditors call it a compliance violation with legal action to follow.", "Low", True, "Hidden Crisis"),
    ("c15", "Thanks for the great tool, just some feedback.", "Low", False, ""),
    ("c16", "Intrusion alarm, credentials compromised, please react immediately.", "High", True, "Hidden Crisis"),
    ("c17", "The tooltip has a minor bug in the notification settings.", "Low", False, ""),
    ("c18", "I escalate this: still not fixed, unacceptable, production outage again.", "Critical", False, ""),
    ("c19", "Formally and solemnly we request one more font size preference.", "High", True, "False Alarm"),
    ("c20", "no one can access the portal, our entire company is idle", "Medium", True, "Hidden Crisis"),
    ("c21", "Ship it whenever: the figures vanished overnight and nobody can find them.", "Low", True, "Hidden Crisis"),
    ("c22", "Password mail arrives late, error shown twice.", "High", False, ""),
]


def test_case_suite(spark):
    df = spark.createDataFrame(CASES, "case_id string, text string, priority string, expected_mismatch boolean, expected_type string")
    found = fusion.label_mismatch(rule_signal(df, "text").withColumnRenamed("rule_severity", "inferred_severity"))
    results = V.case_results(found)
    wrong = [r.case_id for r in results.collect() if not r.correct]
    assert "c21" in wrong  # no lexicon word: the rules cannot see it
    share = V.case_accuracy(results).first()
    assert share.cases == 22 and share.accuracy >= 0.64


@pytest.mark.parametrize("n, rate", [(1000, 0.3), (997, 0.5), (60, 0.1), (7, 0.4)])
def test_split_sizes_and_purity(spark, n, rate):
    rng = random.Random(n)
    df = spark.createDataFrame([(f"t{i}", int(rng.random() < rate)) for i in range(n)], "ticket_id string, label int")
    rows = stratified_split(df).collect()
    assert len(rows) == n == len({r.ticket_id for r in rows})
    count = lambda s, l=None: sum(r.split == s and (l is None or r.label == l) for r in rows)
    assert (count("train"), count("validation"), count("test")) == expected_counts(n)
    for label in (0, 1):
        size = sum(r.label == label for r in rows)
        assert abs(count("test", label) - size * count("test") / n) <= 1
    again = {r.ticket_id: r.split for r in stratified_split(df.repartition(5)).collect()}
    assert again == {r.ticket_id: r.split for r in rows}
    if n > 500:
        other = {r.ticket_id: r.split for r in stratified_split(df, seed=1).collect()}
        assert other != again


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(10, 4, 500), [0.0, 20.0]])
    rows = P.histogram(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 50).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.lower for r in rows] == pytest.approx(edges[:-1].tolist())
    density, _ = np.histogram(values, bins=50, density=True)
    dense = P.density_histogram(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 50).orderBy("bin")
    assert [r.density for r in dense.collect()] == pytest.approx(density.tolist())


def test_histogram_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    rows = P.histogram(df, "v", 10).collect()
    assert sum(r.n for r in rows) == 2 and min(r.lower for r in rows) == 4.5
    assert P.histogram(df.where("v > 9"), "v", 10).count() == 0


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = G.box_statistics(df, "v", "g").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    inside = [v for v in values if q1 - reach <= v <= q3 + reach]
    assert (r.q1, r.q3, r.lower_whisker, r.upper_whisker) == (q1, q3, min(inside), max(inside))


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), (None, None)], "s string, d string")
    r = P.duplicate_rows(df, ["s", "d"]).first()
    assert (r.rows, r.duplicates, r.duplicate_percent) == (4, 1, 25.0)


def test_describe_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", None), (None, 6.0)], "s string, v double")
    rows = {r.column: r for r in P.describe_all(df).collect()}
    assert (rows["s"]["count"], rows["s"].unique, rows["s"].top, rows["s"].freq) == (3, 2, "b", 2)
    assert (rows["v"]["count"], rows["v"].mean, rows["v"].median) == (3, 3.0, 2.0)
    nulls = {r.column: (r.missing_count, r.missing_percent) for r in P.null_counts(df).collect()}
    assert nulls == {"s": (1, 25.0), "v": (1, 25.0)}
    assert P.total_nulls(df).first().missing_values == 2


def test_level_order_keeps_empty_levels(spark):
    df = spark.createDataFrame([("High",), ("High",), ("Low",)], "priority string")
    assert [tuple(r) for r in G.counts_in_level_order(df, "priority").collect()] == [
        ("Low", 1), ("Medium", None), ("High", 2), ("Critical", None)
    ]


def test_matrix_and_shares(spark):
    df = spark.createDataFrame([("Low", "High", 2), ("Low", "Low", 0), ("High", "High", 0)], "priority string, inferred_severity string, severity_delta int")
    rows = {r.priority: r.asDict() for r in G.ordered_priority_matrix(df).collect()}
    assert rows["Low"]["High"] == 1 and rows["Critical"]["Low"] == 0 and len(rows) == 4
    share = P.share_matrix(df, "inferred_severity").collect()
    assert all(sum(r[l] for l in ("Low", "Medium", "High", "Critical")) == pytest.approx(100) for r in share)


def test_correlations(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(x + y)) for x, y in zip(a, b)], "a double, b double")
    found = {(r["first"], r["second"]): r.correlation for r in P.correlations(df, ["a", "b"]).collect()}
    assert found[("a", "b")] == pytest.approx(np.corrcoef(a, a + b)[0, 1], abs=1e-3) and found[("a", "a")] == 1.0


def test_rates(spark):
    df = spark.createDataFrame([("Low", "Mismatch", "Chat", 1), ("Low", "Consistent", "Chat", 0)], "priority string, mismatch_label string, channel string, label int")
    assert G.mismatch_rate_by_priority(df).first().mismatch_rate == 50.0
    assert G.channel_rates(df).first().rate == 50.0
    assert G.mismatches_by_channel(df).first().mismatches == 1
