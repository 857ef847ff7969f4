"""Work on texts is done once for copies, with the results that every row would get by itself."""

import pytest
from pyspark.sql import functions as F

from prioscope.operators import features, rule_signal, text_signal
from prioscope.plans import audit
from prioscope.sources.staging import TEXT_KEY, TEXT_ROW, distinct_texts, kept, staged_text_rows, text_rows, with_text_results

TEXTS = ["server is down and all users blocked", "change my profile", "", "not urgent, minor typo", "the outage is critical!"]


def tickets(spark, n, parts=2):
    rows = [(f"T{i}", TEXTS[i % len(TEXTS)], "Low", float(i % 90 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, combined_text string, priority string, resolution_hours double").repartition(parts, "ticket_id")


def test_rows_meet_the_results_of_their_text(spark):
    given = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a", None, "a", "b", ""])], "i int, t string").coalesce(1)
    rows = text_rows(given, "t", "odd")
    each = distinct_texts(rows, "t")
    assert {(r.t, r._copies) for r in each.collect()} == {(None, 2), ("", 2), ("a", 2), ("b", 1)}
    joined = with_text_results(rows, each.select(TEXT_KEY, F.concat_ws("-", F.lit("of"), "t").alias("of")))
    assert joined.columns == ["i", "t", "of"]
    assert sorted((r.i, r.t, r.of) for r in joined.collect()) == [(i, t, "of" if t is None else f"of-{t}") for i, t in enumerate([None, "", "a", None, "a", "b", ""])]


def test_a_text_of_most_rows_is_spread_over_buckets(spark):
    rows = text_rows(spark.range(4000, numPartitions=16).select(F.lit("the same").alias("t")), "t", "hot")
    each = distinct_texts(rows, "t").collect()
    assert len(each) == 16 and {r._copies for r in each} == {250}


def test_no_shuffle_finds_the_texts_or_joins_them_back(spark):
    rows = text_rows(tickets(spark, 100), "combined_text", "still")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = audit.once_per_text(rows, lambda t: t.withColumn("size", F.length("combined_text")))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_like_texts_stay_side_by_side_and_compress(spark):
    """Texts that differ in their openings lie in one file; dealt out by a digest of the whole text each lay by itself."""
    turn = F.concat_ws(" ", *[F.md5((F.floor(F.col("id") / 40) * 8 + i).cast("string")) for i in range(8)])
    given = spark.range(4000, numPartitions=1).select(F.concat(F.lit("opening "), (F.col("id") % 40).cast("string"), F.lit(" of "), turn).alias("t"), turn.alias("turn"))
    rows = text_rows(given, "t", "side-by-side")
    files = rows.withColumn("file", F.input_file_name()).groupBy("turn").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == 100 and all((r.files, r.n) == (1, 40) for r in files)
    assert len({r.file for r in rows.select(F.input_file_name().alias("file")).distinct().collect()}) > 1


def test_texts_with_one_end_and_blocks_of_many_rows_meet_their_own_results(spark):
    text = F.concat(F.format_string("ticket %d ", F.col("id") % 700), F.lit("kind regards, the same signature " * 5))
    rows = text_rows(spark.range(9000, numPartitions=1).select("id", F.when(F.col("id") % 11 != 0, text).alias("t")), "t", "signed")
    each = distinct_texts(rows, "t")
    assert each.agg(F.sum("_copies")).first()[0] == 9000 and 701 <= each.count() <= 3 * 701
    joined = with_text_results(rows, each.select(TEXT_KEY, F.xxhash64("t").alias("of"), "_copies"))
    assert joined.columns == ["id", "t", "of", "_copies"] and joined.count() == 9000
    assert joined.where("NOT of <=> xxhash64(t)").isEmpty() and joined.select("id").distinct().count() == 9000


def test_numbering_the_texts_moves_them_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(text_signal, "numbered_rows", lambda texts, *_: given.append(texts) or texts)
    text_signal.numbered_texts(text_rows(tickets(spark, 100), "combined_text", "once"), "combined_text")
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()


def test_stored_once_for_an_input(spark):
    built = []

    def build():
        built.append(1)
        return tickets(spark, 20)

    for _ in range(2):
        assert staged_text_rows(spark, "some input", "some-rows", build, "combined_text").count() == 20
    assert built == [1]


def test_rules_score_each_text_once(spark, monkeypatch):
    seen, score = [], rule_signal.rule_signal
    df = tickets(spark, 640)

    def noted(table, *args, **options):
        seen.append(table.count())
        return score(table, *args, **options)

    monkeypatch.setattr(audit, "rule_signal", noted)
    found = audit.audit_fast(df)
    assert len(seen) == 1 and seen[0] <= 2 * len(TEXTS)
    assert [*found.columns[:4]] == df.columns and not {TEXT_KEY, TEXT_ROW} & {*found.columns}
    got = {r.ticket_id: (r.rule_severity, r.rule_score, r.rule_features) for r in found.collect()}
    assert got == {r.ticket_id: (r.rule_severity, r.rule_score, r.rule_features) for r in score(df).collect()} and len(got) == 640


@pytest.mark.parametrize("profile", [audit.FULL, text_signal.FULL.__class__(**{**vars(audit.FULL), "text_signal": "rule"})], ids=["tfidf", "rule"])
def test_labels_have_the_same_columns_however_the_tickets_are_stored(spark, profile):
    df = tickets(spark, 60)
    plain, stored = audit.label_tickets(df, profile=profile), audit.label_tickets(text_rows(df, "combined_text", "stored"), profile=profile)
    assert plain.columns == stored.columns
    assert plain.columns[4:] == [
        *audit.RULE_COLUMNS, "rt_severity", "rt_score", "rt_log", *audit.TEXT_COLUMNS, "inferred_severity", "fusion_confidence", "signal_agreement",
        "mismatch_label", "mismatch_type", "severity_delta", "label",
    ]
    assert sorted(map(str, plain.collect())) == sorted(map(str, stored.collect())) and stored.count() == 60


def test_copies_far_apart_share_their_postings(spark, monkeypatch):
    stored = {}

    def noted(df, name):
        stored[name] = kept(df, name)
        return stored[name]

    monkeypatch.setattr(text_signal, "kept", noted)
    df = tickets(spark, 640, parts=1)
    scored = text_signal.semantic_signal(df).collect()
    assert len(scored) == 640 and len({(r.combined_text, r.semantic_severity, r.semantic_score) for r in scored}) == len(TEXTS)
    assert stored["run-terms"].count() <= 60  # 20 times as many when each run of 32 rows had its own
    assert stored["vocabulary"].where("df >= 128").count() >= 10


def test_vocabulary_of_counted_texts_equals_that_of_their_copies(spark):
    df = tickets(spark, 103)
    counted = df.groupBy("combined_text").agg(F.count(F.lit(1)).alias("n"))
    every = features.vocabulary(df, min_documents=1).collect()
    assert every == features.vocabulary(counted, min_documents=1, count_col="n").collect() and every[0].term_count > 20
