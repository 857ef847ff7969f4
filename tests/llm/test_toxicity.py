import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prioscope.llm.toxicity import Model, _judge, buckets_of, clean_rows, fit, fit_noisy_or, locate, score, sentences


def made_up(spark, n=600):
    """Every third document has one rude sentence among clean ones; only documents are labelled."""
    pick = np.random.default_rng(1)
    plain, rude = [f"word{i}" for i in range(200)], ["grobian", "schuft", "lump"]
    docs, labels = [], []
    for i in range(n):
        parts = [" ".join(pick.choice(plain, 8)) for _ in range(pick.integers(2, 12))]
        if i % 3 == 0:
            parts[pick.integers(len(parts))] += " " + str(pick.choice(rude))
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, None, int(i % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sentences_cover_the_text():
    text = "One. Two!? three\nfour"
    assert [t for _, t in sentences(text)] == ["One.", " Two!?", " three\n", "four"] and sentences("") == [(0, "")]
    assert all(text[a : a + len(t)] == t for a, t in sentences(text))


def test_noisy_or_learns_instances_from_bags():
    bags = pd.DataFrame([(1, 3, [1, 1], [5, 9])] * 30 + [(0, 3, [1], [9])] * 30 + [(1, 2, [2], [5, 7])] * 10, columns=["label", "n", "sizes", "buckets"])
    model = fit_noisy_or(bags, [5, 7, 9])
    assert model.weights[5] > 4 and model.weights[9] < 1 and model.bias < -3


def test_held_out_documents_and_sentences(spark):
    docs, labels = made_up(spark)
    model = fit(docs, labels)
    found = score(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    located = locate(docs, model).collect()
    assert {r.doc_id for r in located} >= {r.doc_id for r in found if r.doc_id % 3 == 0 and r.predicted}
    assert np.mean([any(w in r.sentence for w in ("grobian", "schuft", "lump")) for r in located]) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start :].startswith(r.sentence) for r in located)


def test_held_out_labels_are_never_read(spark):
    docs, labels = made_up(spark, 200)
    held = {r.doc_id for r in score(docs, Model()).collect() if r.held_out}
    turned = labels.rdd.map(lambda r: (r.doc_id, None, 1 - r.toxic if r.doc_id in held else r.toxic))
    other = spark.createDataFrame(turned, labels.schema)
    assert fit(docs, labels) == fit(docs, other)


def test_tricky_rows(spark, tricky, nothing):
    docs, labels = made_up(spark, 200)
    model = fit(docs, labels)
    assert score(tricky, model).count() == tricky.count() and score(nothing, model).count() == 0
    assert locate(nothing, model).count() == 0
    kept = clean_rows(tricky, model)
    assert kept.columns == tricky.columns and kept.count() == tricky.count()
    assert {r.score for r in score(tricky, fit(tricky, labels.where("false"))).collect()} <= {r.score for r in score(tricky, Model()).collect()}
    assert max(r.score for r in score(tricky, Model()).collect()) < 1e-9


def test_length_alone_is_not_toxic(spark):
    docs, labels = made_up(spark)
    model = fit(docs, labels)
    plain = "".join(f"word{i % 200} word{i % 7} and so on. " for i in range(10_000))
    rows = [(1, plain), (2, "nothing. " * 10_000), (3, plain + "you grobian."), (4, None)]
    found = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found[1].score < 0.01 and found[2].score == 0 and found[4].score == 0 and found[3].predicted == 1


def test_sentences_with_harmless_features_add_nothing():
    model = Model({buckets_of("calm")[0]: -2.0, buckets_of("plain")[0]: 0.0, buckets_of("lump")[0]: 8.0}, -5.0)
    text = "all calm. a plain word. " * 5000
    assert _judge(model, text, {})[0] == 0 and _judge(model, text + "lump.", {})[0] > 0.9
    assert len(_judge(model, text, {})[1]) == 10_000


def test_the_driver_holds_no_object_per_feature(spark):
    """As rows the counts of features and the bags of the sample took 98 MB of the driver's Python here."""
    import tracemalloc

    docs, labels = made_up(spark)
    many = docs.withColumn("text", F.concat_ws(" ", "text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.hash("doc_id", i).cast("string")), " ")))
    tracemalloc.start()
    fit(many, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
