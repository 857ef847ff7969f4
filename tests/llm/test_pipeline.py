import corpus_pipeline
from prioscope.llm import benchmark, toxicity
from prioscope.llm.common import keep_rows
from prioscope.sources.staging import fresh_path

from test_near import plain as plain_near


def written(spark, df):
    path = fresh_path(spark, "test-stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def through(spark, docs, folder):
    """Documents after every stage."""
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(written(spark, stage(spark, found[-1], folder)))
    return found


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    start, clean, unique, apart, free, encoded = through(spark, docs, folder)
    for a, b in zip((start, clean, unique, apart), (clean, unique, apart, free)):
        assert a.columns == b.columns and b.count() <= a.count()
    scores = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scores if r.score < toxicity.CUT)
    last = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        last[r.text] = r.doc_id
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c, _ in plain_near(rows)})
    hit = {r.doc_id for r in benchmark.contamination(apart, bench).collect() if r.contaminated}
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in apart.collect()} - hit
    assert {r.doc_id for r in encoded.collect() if r.round_trip} == {r.doc_id for r in free.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r.doc_id for r in encoded.collect())


def test_tricky_rows(spark, tricky, nothing, folder):
    found = through(spark, written(spark, tricky), folder)
    assert all(f.columns == tricky.columns for f in found[:-1])
    texts = [r.text or "" for r in found[2].collect()]
    assert len(texts) == len(set(texts))
    assert all(f.count() == 0 for f in through(spark, written(spark, nothing), folder))


def test_rows_are_told_apart_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "a", 0), (None, "a", 0)], "doc_id long, text string, _row_key int")
    from prioscope.llm.common import row_key

    keys = docs.where("text = 'a'").select(row_key().alias("key"))
    assert sorted(map(str, keep_rows(docs, keys, "key").collect())) == ["Row(doc_id=1, text='a', _row_key=0)", "Row(doc_id=None, text='a', _row_key=0)"]
