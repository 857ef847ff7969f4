import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prioscope.operators import classify as C
from prioscope.operators import features as X
from prioscope.plans import audit
from prioscope.sources import files
from prioscope.streaming import score as streams

WORDS = ["server", "down", "please", "change", "logo", "late", "again", "été", "x", "error", "never", "slow"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        label = int(rng.random() < 0.4)
        words = [rng.choice(WORDS[:6] if label else WORDS[4:]) for _ in range(rng.randint(2, 9))]
        rows.append(
            (f"t{i:03d}", " ".join(words), "s", " ".join(words), rng.choice(["Chat", "Email", "Phone"]), rng.choice(["B", "A"]),
             float(rng.choice([1.0, 5.0, 30.0, 200.0])), label, ["Low", "High"][label])
        )
    return spark.createDataFrame(
        rows,
        "ticket_id string, combined_text string, subject string, description string, channel string, ticket_type string, "
        "resolution_hours double, label int, priority string",
    )


def grams(text):
    w = re.findall(r"\w+", text.lower())
    return w + [" ".join(w[i:i + 2]) for i in range(len(w) - 1)] + [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]


def brute_vocabulary(texts, size):
    counts, seen = Counter(), Counter()
    for t in texts:
        counts.update(grams(t))
        seen.update(set(grams(t)))
    usable = [t for t in counts if seen[t] >= 2]
    return sorted(usable, key=lambda t: (-counts[t], t.encode()))[:size], seen


def brute_matrix(rows, terms, seen):
    n, place = len(rows), {t: i for i, t in enumerate(terms)}
    m = np.zeros((n, len(terms)))
    for i, r in enumerate(rows):
        for t, c in Counter(grams(r.combined_text)).items():
            if t in place:
                m[i, place[t]] = (1 + math.log(c)) * (math.log((1 + n) / (1 + seen[t])) + 1)
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1, lengths)


def brute_meta(rows):
    channels, types = sorted({r.channel for r in rows}), sorted({r.ticket_type for r in rows})
    m = np.array([[channels.index(r.channel), types.index(r.ticket_type), math.log1p(r.resolution_hours), len(r.combined_text) / 1000] for r in rows])
    return (m - m.mean(axis=0)) / m.std(axis=0)


@pytest.mark.parametrize("size", [7, 40, 15000])
def test_vocabulary(spark, table, size):
    wanted, seen = brute_vocabulary([r.combined_text for r in table.collect()], size)
    got = X.vocabulary(table, size=size).collect()
    assert [r.term for r in got] == wanted
    assert all(r.document_count == seen[r.term] for r in got)


def test_features_equal_brute_force(spark, table):
    rows = table.orderBy("ticket_id").collect()
    terms, seen = brute_vocabulary([r.combined_text for r in rows], 15000)
    terms = sorted(terms)
    idf = [math.log((1 + len(rows)) / (1 + seen[t])) + 1 for t in terms]
    channels, types = X.category_codes(table, "channel"), X.category_codes(table, "ticket_type")
    described = X.with_metadata(table, channels, types)
    full = X.text_weights(X.standardise(described, X.meta_moments(described)), terms, idf, coefficients=[0.5] * len(terms))
    full = full.withColumn("features", X.feature_vector(len(terms)))
    found = full.orderBy("ticket_id").select(vector_to_array("features").alias("v"), "text_score").collect()
    got = np.array([r.v for r in found])
    assert np.allclose([r.text_score for r in found], 0.5 * got[:, : len(terms)].sum(axis=1))
    want = np.hstack([brute_matrix(rows, terms, seen), brute_meta(rows)])
    assert np.allclose(got, want, atol=1e-9)


def codes(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, code long")


def test_any_number_of_categories(spark):
    df = spark.range(20_000).selectExpr("concat('c', lpad(id, 5, '0')) AS channel", "'A' AS ticket_type", "1.0 AS resolution_hours", "'abc' AS combined_text")
    known = X.category_codes(df, "channel")
    found = X.with_metadata(df, known, codes(spark, "A")).collect()
    assert len(found) == 20_000 and all(r.channel_code == int(r.channel[1:]) for r in found)


def test_unseen_category_takes_the_first_and_constant_column_is_safe(spark):
    df = spark.createDataFrame([("New", "A", 3.0, "abc"), (None, "A", -5.0, "abc")], "channel string, ticket_type string, resolution_hours double, combined_text string")
    described = X.with_metadata(df, codes(spark, "Chat", "Unknown"), codes(spark, "A"))
    rows = {r.channel: r for r in described.collect()}
    assert rows["New"].channel_code == 0.0 and rows[None].channel_code == 1.0 and rows[None].log_hours == 0.0
    scaled = X.standardise(described, X.meta_moments(described))
    assert {r.type_code for r in scaled.collect()} == {0.0}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert {r.label: r.class_weight for r in X.class_weights(df).collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    assert X.with_class_weights(df).count() == 4


def test_model_text(spark, table):
    text = X.model_text(table.limit(1), separator="</s>").first()
    assert text.model_text.startswith(f"[CHANNEL: {text.channel}] [TYPE: {text.ticket_type}] [RT: RESOLVED-")
    assert " s </s> " in text.model_text
    df = spark.createDataFrame([(4.0,), (24.0,), (72.0,), (72.1,)], "h double")
    assert [r[0] for r in df.select(X.resolution_token(F.col("h"))).collect()] == [
        "RESOLVED-FAST", "RESOLVED-NORMAL", "RESOLVED-SLOW", "RESOLVED-VERY-SLOW"
    ]


@pytest.fixture(scope="module")
def model(table):
    return C.fit_text_model(table)


def test_regression_equals_newton_steps(spark, table, model):
    rows = table.orderBy("ticket_id").collect()
    terms, seen = brute_vocabulary([r.combined_text for r in rows], 15000)
    x = np.hstack([brute_matrix(rows, sorted(terms), seen), brute_meta(rows), np.ones((len(rows), 1))])
    y = np.array([r.label for r in rows], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.ones(x.shape[1])
    penalty[-1] = 0.0
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        gradient = x.T @ (weight * (p - y)) + penalty * b
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        b -= np.linalg.solve(hessian, gradient)
    want = 1 / (1 + np.exp(-x @ b))
    got = [r.mismatch_probability for r in model.predict(table).orderBy("ticket_id").collect()]
    assert np.allclose(got, want, atol=5e-3)
    assert np.mean((np.array(got) >= 0.5) == (y == 1)) > 0.8


def test_models_work_after_an_observation(spark, table, model):
    from pyspark.sql import Observation

    seen = Observation("before")
    table.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == model.predict(table).count()
    fresh = C.fit_tagged_model(table, table, penalties=(0.01,), buckets=256)
    assert fresh.predict(table).count() == 160


def test_saved_model_gives_the_same(spark, table, model, tmp_path):
    path = str(tmp_path / "m")
    model.save(path)
    loaded, used, why = C.load_model(spark, path, str(tmp_path / "absent"), "advanced")
    assert used == "baseline" and "absent" in why and loaded.losses == pytest.approx(model.losses)
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        C.load_model(spark, path, str(tmp_path / "broken"), "advanced")
    a = {r.ticket_id: r.mismatch_probability for r in model.predict(table).collect()}
    b = {r.ticket_id: r.mismatch_probability for r in loaded.predict(table).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    history = C.objective_history(model).collect()
    assert history[0].value >= history[-1].value


def test_tagged_model_search_stops_and_keeps_the_best(spark, table, tmp_path):
    train, rest = table.where("ticket_id < 't120'"), table.where("ticket_id >= 't120'")
    penalties = (0.01, 100.0, 200.0, 0.001, 0.0001, 0.1)
    found = C.fit_tagged_model(train, rest, penalties=penalties, patience=2, buckets=1024)
    scores = [v for _, m, v in found.history if m == "val_f1"]
    assert found.best == max(scores)
    since_best = len(scores) - 1 - scores.index(max(scores))
    assert since_best == 2 or (since_best < 2 and len(scores) == len(penalties))
    found.save(str(tmp_path / "tagged"))
    loaded, used, why = C.load_model(spark, "unused", str(tmp_path / "tagged"), "advanced")
    assert used == "advanced" and why == "" and loaded.best == found.best and sorted(loaded.history) == sorted(found.history)
    assert loaded.predict(rest).columns[-2:] == ["mismatch_probability", "prediction"]
    assert C.training_history(spark, found).count() == 3 * len(scores)


def test_external_model(spark):
    def make():
        def predict(batch):
            p = np.array([0.9 if "down" in str(t) else 0.2 for t in batch], dtype=np.float32)
            return np.stack([1 - p, p], axis=1)

        return predict

    df = spark.createDataFrame([("server down",), ("logo",)], "model_text string")
    rows = C.predict_external(df, make).collect()
    assert [r.prediction for r in rows] == [1, 0] and rows[0].mismatch_probability == pytest.approx(0.9)


def test_decision_and_adoption(spark):
    df = spark.createDataFrame([(0.5, "Consistent"), (0.49, "Mismatch"), (0.8, "Mismatch")], "mismatch_probability double, mismatch_label string")
    rows = C.adopt_prediction(C.with_decision(df)).collect()
    assert [r.mismatch_label for r in rows] == ["Mismatch", "Consistent", "Mismatch"]
    assert [r.label_conflict for r in rows] == [True, True, False]
    assert [r.prediction_confidence for r in rows] == [0.5, 0.51, 0.8]


RAW = "`Ticket ID` string, `Ticket Subject` string, `Ticket Description` string, `Ticket Priority` string, `Ticket Channel` string, `Resolution Time` string"
RAW_ROWS = [
    ("A", "Server is down", "Production outage, all users affected", "Low", "Email", "2"),
    ("B", "Change profile picture", "I want a new avatar", "Critical", "Phone", "96"),
    ("C", "Settings", "a small suggestion", "low priority", None, "n/a"),
    ("D", "x", "y", "not specified", "Chat", "3"),
    ("E", "Crash", "The app is slow, error 503", "High", "Chat", "11.25"),
]


def test_one_ticket(spark, model):
    row = audit.audit_one(spark, {"subject": "Server down", "description": "complete outage", "priority": "Low"}).first()
    assert (row.mismatch_label, row.mismatch_type, row.severity_delta) == ("Mismatch", "Hidden Crisis", 3)
    assert row.mismatch_probability == row.rule_score == row.prediction_confidence
    assert row.dossier.ticket_id == "ADHOC-001" and row.signal_agreement == 0.67
    calm = audit.audit_one(spark, {"subject": "Hello", "description": "there", "priority": "Low"}).first()
    assert calm.dossier is None and calm.prediction_confidence == pytest.approx(1 - calm.rule_score)
    judged = audit.audit_one(spark, {"subject": "Hello", "description": "there", "priority": "Low"}, model).first()
    assert judged.mismatch_label == "Consistent" and judged.predicted_label in ("Mismatch", "Consistent")


def test_audit_of_a_file(spark, tmp_path, model):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(RAW_ROWS, RAW).write.csv(path, header=True)
    done = audit.audit_file(spark, path, out)
    rows = {r.ticket_id: r for r in done.audited.collect()}
    assert sorted(rows) == ["A", "B", "C", "E"]
    assert rows["A"].mismatch_type == "Hidden Crisis" and rows["B"].mismatch_type == "False Alarm"
    assert rows["C"].channel == "Unknown" and rows["C"].resolution_hours == 11.25
    written = spark.read.csv(f"{out}/predictions", header=True)
    assert written.columns[:3] == ["Ticket ID", "Ticket Subject", "Ticket Priority"] and len(written.columns) == 8
    assert spark.read.json(f"{out}/dossiers").count() == done.records.count() == sum(r.mismatch_label == "Mismatch" for r in rows.values())
    judged = audit.audit_file(spark, path, out, model, "baseline").audited.collect()
    assert all(r.mismatch_label == r.predicted_label and r.model_used == "baseline" for r in judged)
    assert any(r.label_conflict for r in judged) or all(not r.label_conflict for r in judged)


def test_stream_equals_batch(spark, tmp_path):
    from prioscope.operators.cleaning import clean_tickets
    from prioscope.operators.ordering import median
    from prioscope.operators.time_signal import fit_thresholds

    path = str(tmp_path / "arriving")
    spark.createDataFrame(RAW_ROWS, RAW).repartition(3).write.csv(path, header=True)
    clean = clean_tickets(files.read_ticket_csv(spark, path))
    batch = audit.audit_fast(clean)
    limits = fit_thresholds(clean)
    middle = median(clean.where("ticket_id != 'C'"), "resolution_hours").first()["median"]
    schema = spark.read.csv(path, header=True).schema
    stream = streams.read_ticket_stream(spark, path, "csv", schema, files_per_batch=1)
    scored = streams.score_stream(stream, limits, middle)
    assert scored.isStreaming
    streams.start_scoring(scored.drop("rule_features"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streams.start_evidence(scored, str(tmp_path / "records"), str(tmp_path / "state2")).awaitTermination()
    columns = ["ticket_id", "rt_severity", "rt_score", "rule_severity", "rule_score", "mismatch_label", "severity_delta"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())
    records = spark.read.json(str(tmp_path / "records"))
    assert records.count() == sum(r[5] == "Mismatch" for r in got)


def test_stream_of_texts_without_other_columns(spark, tmp_path):
    from prioscope.operators.time_signal import fit_thresholds

    path, state = str(tmp_path / "arriving"), str(tmp_path / "state")
    spark.createDataFrame([("Server down", "total outage", "Low"), ("Logo", "a suggestion", "High"), ("x", "y", "?")], "`Ticket Subject` string, `Ticket Description` string, `Ticket Priority` string").write.csv(path, header=True)
    hours = spark.createDataFrame([(1.0,), (5.0,), (30.0,), (90.0,)], "h double")
    streams.fit_scoring(hours.withColumnRenamed("h", "resolution_hours"), hours).write.parquet(state)
    scored = streams.score_stored(spark, streams.read_ticket_stream(spark, path, multi_line=False), state)
    streams.start_scoring(scored.drop("rule_features"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and len({r.ticket_id for r in rows}) == 2 and all(r.ticket_id.startswith("TKT-") for r in rows)
    assert {r.resolution_hours for r in rows} == {24.0} and {r.channel for r in rows} == {"Unknown"}
    assert fit_thresholds(hours, "h").count() == 1


def test_thresholds_published_between_two_batches_take_effect(spark, tmp_path):
    raw, state, out = str(tmp_path / "arriving"), str(tmp_path / "state"), str(tmp_path / "out")
    rows = spark.createDataFrame([(f"T{i}", "a subject", "some text", "Low", str(h)) for i, h in enumerate((1, 5, 30, 90))], "`Ticket ID` string, `Ticket Subject` string, `Ticket Description` string, `Ticket Priority` string, `Resolution Time` string")
    fitted = [
        streams.fit_scoring(hours.withColumnRenamed("h", "resolution_hours"), hours)
        for hours in (spark.createDataFrame([(x * f,) for x in (1.0, 5.0, 30.0, 90.0)], "h double") for f in (1.0, 20.0))
    ]
    assert streams.publish_scoring(fitted[0], state) == 1
    rows.write.parquet(raw)
    running = streams.start_published_scoring(streams.read_ticket_stream(spark, raw, "parquet", rows.schema), state, out, str(tmp_path / "check"), once=False)
    try:
        running.processAllAvailable()
        assert streams.publish_scoring(fitted[1], state) == 2
        fitted[1].write.parquet(f"{state}/version-3")
        (tmp_path / "state" / "version-3" / "_SUCCESS").unlink()
        rows.write.mode("append").parquet(raw)
        running.processAllAvailable()
    finally:
        running.stop()
    columns = ["ticket_id", "rt_severity", "rt_score", "inferred_severity", "mismatch_label"]
    found = spark.read.parquet(out)
    for version, limits in enumerate(fitted, 1):
        batch = streams.score_stream(rows, limits, limits.first()["median_hours"]).select(columns)
        assert sorted(map(tuple, found.where(F.col("state_version") == version).select(columns).collect())) == sorted(map(tuple, batch.collect()))
    assert len({r.rt_severity for r in found.where("ticket_id = 'T2'").collect()}) == 2


def test_numbers_survive_gaps_and_ties(spark):
    from prioscope.operators.ordering import median, number_by, number_values

    keys = [5.0, None, float("nan"), -5.0, 7.0, None, 7.0, 0.0, float("nan"), None]
    df = spark.createDataFrame([(i, k, "text") for i, k in enumerate(keys)], "i int, k double, t string")
    found = {r.i: r.nr for r in number_by(df, "k", "nr").collect()}
    assert sorted(found.values()) == list(range(1, 11))
    assert [found[i] for i in (3, 7, 0)] == [1, 2, 3] and {found[4], found[6]} == {4, 5}
    assert {found[2], found[8]} == {6, 7} and {found[1], found[5], found[9]} == {8, 9, 10}
    assert median(df, "k").scalar() is not None and median(df, "k").first()["median"] == 5.0
    assert number_by(df.where("false"), "k", "nr").count() == 0 and number_by(df.where("k IS NULL"), "k", "nr").count() == 3
    named = spark.createDataFrame([(v,) for v in "bdaacb"], "v string")
    assert {r.v: r.n for r in number_values(named, "v", "n").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_training_flow(spark, tmp_path):
    rng = random.Random(9)
    openers = [("Server down", "complete outage, revenue loss", 2.0), ("New logo", "a small suggestion and feedback", 120.0), ("Login issue", "error and crash, it is slow", 9.0)]
    rows = []
    for i in range(180):
        subject, description, hours = rng.choice(openers)
        rows.append((f"T{i}", subject, f"{description} {rng.choice(WORDS)}", rng.choice(["Low", "High", "Critical", "Medium"]), rng.choice(["Chat", "Email"]), str(hours + rng.random())))
    out = str(tmp_path / "run")
    done = audit.train(spark.createDataFrame(rows, RAW), out)
    assert done.labeled.count() == 180
    assert done.reports.count() == 8
    assert spark.read.json(f"{out}/dossiers").count() == done.records.count()
    assert spark.read.json(f"{out}/report_baseline").first().model_name == "Baseline TF-IDF+LR"
    assert spark.read.parquet(f"{out}/thresholds").count() == 1
    assert spark.read.csv(f"{out}/ablation", header=True).count() == 6
