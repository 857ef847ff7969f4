"""Ids above 2 ** 53 stay what they are beside null ids, and null ids do not make different texts alike."""

import pytest
import xxhash
from pyspark.sql import functions as F

from prioscope.llm import benchmark, exact, html, mixing, near, passages, quality, sharding, toxicity, urls

IDS = [2**53 + 1, None, 2**53 + 3, 2**63 - 1, None, 5]
WORDS = "a text of some words about the river and the town number {} that goes on for a while so that it has shingles "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, WORDS.format(n) * 2, "en", "s") for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted([r[0] for r in df.select(name).collect()], key=lambda i: (i is None, i or 0))


WANT = sorted(IDS, key=lambda i: (i is None, i or 0))


def test_ids_of_documents(spark, docs):
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    items = spark.createDataFrame([(1, "other words that stand nowhere in the documents at all")], "item_id long, text string")
    assert ids(passages.remove_repeats(docs)) == WANT
    assert ids(benchmark.contamination(docs, items)) == WANT
    assert ids(toxicity.score(docs, toxicity.fit(docs, labels))) == WANT
    assert ids(sharding.assign(docs, 10**6)) == WANT
    assert ids(near.near_classes(docs)) == WANT
    assert ids(quality.classify(docs, labels)) == WANT
    assert ids(exact.decide(docs, exact.fresh_index(spark))) == WANT
    assert ids(mixing.mix(docs).rows) == WANT


def test_ids_of_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://example.com/en/x").alias("url"), F.col("text").alias("html"))
    rules = urls.rule_table(pages.sparkSession, urls.RULES)
    assert ids(urls.judge_urls(pages, rules), "page_id") == WANT
    assert ids(html.extract(pages), "page_id") == WANT


def test_class_ids(spark):
    rows = [(2**53 + 1, WORDS), (None, WORDS + " "), (2**53 + 3, "nothing like the others")]
    found = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.class_id) for r in found} == {(2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (2**53 + 3, 2**53 + 3)}


def test_null_ids_with_equal_short_hashes(spark):
    seen, pair = {}, None
    for i in range(400_000):
        text = f"start {i} " + "y" * (300 - len(str(i)))
        short = xxhash.xxh64_intdigest(text.encode(), 42) & 0x7FFFFFFF
        if short in seen:
            pair = (seen[short], text)
            break
        seen[short] = text
    docs = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    assert docs.select(F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).distinct().count() == 1
    found = sorted(r.n_removed for r in passages.remove_repeats(docs).collect())
    # Both texts hold long runs of one letter; what is covered follows from the texts in either order.
    def removed(first, second):
        windows, out = set(), []
        for t in (first, second):
            gone = set()
            for s in range(len(t) - 99):
                w = t[s : s + 100]
                if w in windows:
                    gone |= set(range(s, s + 100))
                windows.add(w)
            out.append(len(gone))
        return sorted(out)

    assert found in (removed(*pair), removed(*pair[::-1]))
