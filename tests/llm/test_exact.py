from collections import defaultdict

from prioscope.llm.exact import decide, fresh_index, unique_rows
from prioscope.llm.exact import DigestIndex


def test_tricky_rows(spark, tricky, nothing):
    found = decide(tricky, fresh_index(spark)).collect()
    assert len(found) == tricky.count()
    groups = defaultdict(list)
    for r in tricky.collect():
        groups[r.text or ""].append(r.doc_id)
    by_digest = defaultdict(list)
    for r in found:
        by_digest[r.text_sha256].append(r)
    assert len(by_digest) == len(groups)
    for rows in by_digest.values():
        assert sum(r.kept for r in rows) == 1
        assert {r.group_size for r in rows} == {len(rows)}
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.keep_id for r in rows} == {max(ids, default=None)}
    stay = unique_rows(tricky, fresh_index(spark))
    assert stay.columns == tricky.columns
    assert sorted(r.text or "" for r in stay.collect()) == sorted(groups)
    assert decide(nothing, fresh_index(spark)).count() == 0


def test_later_batches_meet_the_index(spark):
    index = fresh_index(spark, 4)
    shape = "doc_id long, text string"
    first = {r.doc_id: r for r in decide(spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], shape), index).collect()}
    assert [first[i].kept for i in (1, 2, 5)] == [False, True, True]
    again = DigestIndex(spark, index.path, 4)
    second = {r.doc_id: r for r in decide(spark.createDataFrame([(9, "a"), (7, "c"), (8, "c")], shape), again).collect()}
    assert not second[9].kept and second[9].keep_id == 5 and second[9].group_size == 3
    assert second[8].kept and not second[7].kept and second[7].keep_id == 8
    assert index.read().count() == 3


def test_index_side_is_not_shuffled(spark):
    index = fresh_index(spark, 4)
    decide(spark.createDataFrame([(i, str(i % 50)) for i in range(200)], "doc_id long, text string"), index)
    entries = index.read().selectExpr("digest", "1 AS x")
    plan = index.missing(entries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_named_batch_can_be_repeated(spark, tricky):
    index = fresh_index(spark, 4)
    shape = "doc_id long, text string"
    earlier = spark.createDataFrame([(1, "x"), (2, "empty or not"), (3, None)], shape)
    decide(earlier, index, "monday").collect()

    def verdicts():
        return sorted(map(str, decide(tricky, index, "tuesday").collect()))

    first, entered = verdicts(), index.read().count()
    assert verdicts() == first and index.read().count() == entered
    again = DigestIndex(spark, index.path, 4)
    assert unique_rows(tricky, again, "tuesday").count() == sum("kept=True" in v for v in first)
    assert not any(r.kept for r in decide(tricky, index, "wednesday").collect())
    assert unique_rows(earlier, index, "monday").count() == 3


def test_a_batch_that_died_while_it_was_entered(spark):
    shape = "doc_id long, text string"
    rows = [(i, f"text {i % 7}") for i in range(20)]
    index, plain = fresh_index(spark, 4), fresh_index(spark, 4)
    decide(spark.createDataFrame(rows[:5], shape), index, "b").collect()
    found = decide(spark.createDataFrame(rows, shape), index, "b").collect()
    assert sorted(map(str, found)) == sorted(map(str, decide(spark.createDataFrame(rows, shape), plain, "b").collect()))
