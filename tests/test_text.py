import random

import pytest
from pyspark.sql import functions as F

from brute import features, normal, starts, verdict, weighted
from prioscope import settings as S
from prioscope.functions import text as T
from prioscope.operators import rule_signal as rules

PIECES = (
    S.CRITICAL_WORDS + S.HIGH_WORDS + S.MEDIUM_WORDS + S.LOW_WORDS + S.ESCALATION_PHRASES + S.NEGATIONS
    + ["é", "no-", "x_", "don", "all", "users", "100%", "<b>", "</b>", "URGENT", "WHY", "!", "revenue drop", "entire team",
       "no one can access", "everyone is now blocked", "all the nodes are down", "customers cannot", "losing money",
       "ça", "naïve", "cannotté", "½", "२", "\t", "\n", " ", " ", "profilepicture", "hackathon", "reported"]
)


def random_texts(n, seed):
    rng = random.Random(seed)
    return [
        rng.choice(["", " ", "  "]).join(rng.choice(PIECES) + rng.choice(["", " ", " ", ", ", "."]) for _ in range(rng.randint(0, 25)))
        for _ in range(n)
    ]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, raw string")


def test_keyword_groups_keep_prefixes_apart():
    groups = T.keyword_groups(["profile", "profile picture", "pro", "settings", "profile"])
    for group in groups:
        assert not any(a != b and b.startswith(a) for a in group for b in group)
    assert sorted(k for g in groups for k in g) == sorted(["profile", "profile picture", "pro", "settings", "profile"])


def test_weighted_hits_equal_brute_force(spark):
    texts = [normal(t) for t in random_texts(600, 1)]
    lexicons = {"c": S.CRITICAL_WORDS, "h": S.HIGH_WORDS, "m": S.MEDIUM_WORDS, "l": S.LOW_WORDS}
    got = rules.weighted_hits(frame(spark, texts), "raw", lexicons).collect()
    assert sum(r.c + r.l for r in got) > 100
    for row in got:
        for name, words in lexicons.items():
            assert row[name] == pytest.approx(weighted(texts[row.id], words)), (texts[row.id], name)


def test_whole_signal_equals_brute_force_on_raw_text(spark):
    texts = random_texts(400, 2)
    for row in rules.rule_signal(frame(spark, texts), "raw").collect():
        wanted = features(texts[row.id])
        got = row.rule_features.asDict()
        for name, value in wanted.items():
            assert got[name] == pytest.approx(value), (name, texts[row.id])
        assert row.rule_severity == verdict(wanted)[0]
        assert row.rule_score == pytest.approx(verdict(wanted)[1], abs=1e-4)


@pytest.mark.parametrize(
    "gap, counts",
    [(36, 0.2), (37, 0.2), (38, 1.0), (39, 1.0)],
)
def test_negation_window_is_forty_characters(spark, gap, counts):
    text = "not" + " " * 1 + "x" * (gap - 2) + " " + "emergency"
    assert text.index("emergency") - 3 == gap
    row = rules.weighted_hits(frame(spark, [text]), "raw", {"c": ["emergency"]}).first()
    assert row.c == counts == weighted(text, ["emergency"])


def test_word_cut_by_the_window_negates(spark):
    text = "cannot" + " " + "y" * 35 + " " + "emergency"  # the window starts inside "cannot"
    for pad in range(30, 45):
        text = "cannot " + "y" * pad + " emergency"
        row = rules.weighted_hits(frame(spark, [text]), "raw", {"c": ["emergency"]}).first()
        assert row.c == weighted(text, ["emergency"]), pad


def test_known_quirks(spark):
    texts = ["100% of users", "my profile picture", "login issue", "the 100%x case", "plain words only"]
    found = {r.id: r.rule_features for r in rules.rule_signal(frame(spark, texts), "raw").collect()}
    assert found[0].quantifier_hits == 0 and found[3].quantifier_hits == 1
    assert found[1].low_kw_hits == 2.0
    assert found[2].high_kw_hits == 1.0 and found[2].medium_kw_hits == 1.0


def test_ties_go_to_the_more_severe_level(spark):
    row = rules.rule_signal(frame(spark, ["error profile"]), "raw").first()
    assert row.rule_severity == "High"


def test_lower_cased_text_has_no_capitals(spark):
    raw = rules.rule_signal(frame(spark, ["HELP ME NOW"]), "raw").first()
    lowered = rules.rule_signal(frame(spark, ["help me now"]), "raw").first()
    assert raw.rule_features.caps_word_count == 2 and lowered.rule_features.caps_word_count == 0


def test_negated_scores_below_plain(spark):
    rows = rules.rule_signal(frame(spark, ["there is an emergency", "there is no emergency"]), "raw").collect()
    assert rows[1].rule_features.critical_kw_hits < rows[0].rule_features.critical_kw_hits


def test_strip_and_capitalize(spark):
    df = spark.createDataFrame([("\t  VERY HIGH \n",), ("",), (None,), ("x",)], "p string")
    rows = df.select(T.capitalize(T.strip(F.col("p"))).alias("p")).collect()
    assert [r.p for r in rows] == ["Very high", "", None, "X"]


def test_grams(spark):
    df = spark.createDataFrame([("a b c d",), ("one",), ("",), ("été 1 x_y",)], "t string")
    rows = [r.g for r in df.select(T.word_ngrams(T.word_tokens(F.col("t")), 3).alias("g")).collect()]
    assert rows[0] == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]
    assert rows[1] == ["one"] and rows[2] == []
    assert rows[3] == ["été", "1", "x_y", "été 1", "1 x_y", "été 1 x_y"]


def test_fixed_point_follows_the_binary_value(spark):
    values = [0.25, 0.15, 3.35, 12.25, 1234567.05, -3.0, 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in df.select(T.fixed_point(F.col("v"), 1).alias("s")).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_present_patterns_use_unicode_edges(spark):
    texts = ["éno one can access", "no one can access", "small down", "all is down", "everyones blocked", "everyone blocked"]
    rows = frame(spark, texts).select("id", T.count_present_patterns(F.col("raw"), S.QUANTIFIER_PATTERNS).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 0, 1, 0, 1]
    assert starts("éno", "no") == []


def test_mean_features(spark):
    scored = rules.rule_signal(frame(spark, ["emergency", "emergency urgent", "hello"]), "raw")
    rows = {r.rule_severity: r for r in rules.mean_features(scored).collect()}
    assert rows["Critical"].critical_kw_hits == 1.5 and rows["Low"].critical_kw_hits == 0.0


def test_compact_profile_differs(spark):
    text = "intermittent outage, managers all angry"
    full = rules.rule_signal(frame(spark, [text]), "raw").first()
    compact = rules.rule_signal(frame(spark, [text]), "raw", S.COMPACT).first()
    assert full.rule_features.high_kw_hits == 1.0 and compact.rule_features.high_kw_hits == 0.0
    assert full.rule_features.escalation_hits == 0 and compact.rule_features.escalation_hits == 1


def test_white_space_is_squeezed_whatever_its_kind(spark):
    texts = ["a  b", "a\tb", "a \tb", "a b", " a b ", "　a  b\n", "a\n b", "a b"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalise(F.col("t")).alias("t")).collect()
    assert [r.t for r in found] == ["a b"] * len(texts)
