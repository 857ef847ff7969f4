"""Words counted in slices of rows: the same terms as row by row, added up before anything is shuffled."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import pytest
from pyspark.sql import functions as F

from prioscope.functions.text import plain_words, word_ngrams, word_tokens
from prioscope.functions.vectors import sparse_vector
from prioscope.operators import features, grams, text_signal
from prioscope.plans import catalog
from prioscope.settings import COMPACT, FULL
from prioscope.sources.staging import kept

ODD = [
    "Server DOWN, it's a_b 3x!", "été À côté; naïve—x", "", "  ", None, "日本 語 x²½ Ünï", "İstanbul ſ K", "a\x00b\tc\nd 'quoted'", "x", "😀 smile𝒳math",
    "ab ab ab b", "it's ab a_b: a_b 3x",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*enumerate(ODD)], "i int, combined_text string").coalesce(1)


@pytest.mark.parametrize("shortest", [1, 2])
def test_words_are_those_of_the_token_pattern(odd, shortest):
    rows = odd.orderBy("i").select(plain_words(F.col("combined_text")).alias("p"), word_tokens(F.col("combined_text"), shortest).alias("w")).collect()
    got = [[] for _ in rows]
    for first, texts in grams.slices(pa.array([None, *[r.p for r in rows]]).slice(1)):
        words, word, row = grams.words_of(texts, shortest)
        for w, r in zip(word, row):
            got[first + r].append(words[int(w)].as_py())
    assert got == [r.w or [] for r in rows]


def test_slices_hold_each_row_once(monkeypatch):
    monkeypatch.setattr(grams, "SLICE_BYTES", 10)
    texts = pa.array(["aa bb", None, "c" * 50, "", "dd", "e f g h", "ii"])
    parts = [*grams.slices(texts)]
    assert len(parts) > 2 and [t for first, p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert [first for first, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts]])[:-1].tolist()


def test_terms_of_a_slice_are_added_up(spark, odd):
    want = Counter(r.t for r in odd.select(F.explode(F.array_distinct(word_ngrams(word_tokens(F.col("combined_text")), 3))).alias("t")).collect())
    named = grams.named_terms(odd, "combined_text", 3, 1).collect()
    assert {r.term: r.documents for r in named} == want and len(named) == len(want) == len({r.hash for r in named})
    many = spark.range(500, numPartitions=1).select(F.lit("one two two").alias("t"))
    found = grams.hashed_counts(many, "t", 2, 1, F.lit(2)).collect()
    assert sorted((r.term_count, r.document_count) for r in found) == [(1000, 1000)] * 3 + [(2000, 1000)]
    postings = grams.run_postings(spark.range(64, numPartitions=1).withColumn("t", F.lit("one two two")), F.shiftright("id", 5), F.col("id") % 32, F.lit(3), "t", 1, 1)
    assert sorted((r.run, r.tf, r.rows, r.documents) for r in postings.collect()) == [(run, tf, 2**32 - 1, 96) for run in (0, 1) for tf in (1, 2)]


@pytest.mark.parametrize("profile", [FULL, COMPACT], ids=["full", "compact"])
def test_weights_of_a_given_vocabulary(odd, profile):
    """Terms of one to three words, one of them only as part of a longer one, and one that never occurs."""
    terms = ["a_b", "ab ab", "ab ab ab", "it s", "it a_b", "absent", "x", "été"]
    idf = [1.0 + i / 7 for i in range(len(terms))]
    factor = [0.5 - i for i in range(len(terms))]
    tokens = {r.i: r.w or [] for r in odd.select("i", word_tokens(F.col("combined_text"), profile.shortest_token).alias("w")).collect()}
    for r in features.text_weights(odd, terms, idf, profile=profile, coefficients=factor).collect():
        w = tokens[r.i]
        counts = Counter(" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        held = [i for i, t in enumerate(terms) if counts[t]]
        values = np.array([(1 + math.log(counts[terms[i]])) * idf[i] for i in held])
        values = values / np.linalg.norm(values) if held else values
        assert r.text_indices == held and np.allclose(r.text_values, values)
        assert r.text_score == pytest.approx(sum(v * factor[i] for v, i in zip(values, held)))


def test_texts_are_weighed_in_slices_and_vectors_are_not_printed(odd):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scored = plan(features.text_weights(odd, ["ab", "x"], [1.0, 1.0], coefficients=[1.0, 2.0]).select("text_score"))
    assert scored.count("ArrowEvalPython") == 1 and "concat_ws" not in scored and "weights(" not in scored
    made = odd.select(sparse_vector(F.lit(3), F.array(F.lit(1)), F.array(F.lit(0.5))).alias("v"))
    assert "json" not in plan(made) and made.first().v.toArray().tolist() == [0.0, 0.5, 0.0]


def test_vocabulary_stores_terms_per_slice_and_not_per_row(spark, monkeypatch):
    stored = {}

    def noted(df, name):
        stored[name] = kept(df, name)
        return stored[name]

    monkeypatch.setattr(features, "kept", noted)
    df = spark.range(400, numPartitions=2).select(F.lit("the printer is slow").alias("combined_text"))
    assert {(r.term_count, r.document_count) for r in features.vocabulary(df).collect()} == {(400, 400)}
    assert stored["term-counts"].count() == 2 * 9


def test_anchor_terms_are_picked_before_terms_are_shuffled(spark, odd, monkeypatch):
    given = []
    monkeypatch.setattr(catalog, "clean", lambda *_: odd)
    frequency = text_signal.document_frequency
    monkeypatch.setattr(text_signal, "document_frequency", lambda terms, *a: given.append(terms) or frequency(terms, *a))
    found = catalog.se1_anchor_terms(spark, "unused").collect()
    anchors = {r.term for r in text_signal.anchor_counts(spark).select("term").collect()}
    assert {r.term for r in found} == anchors and {r.term for r in given[0].collect()} <= anchors
