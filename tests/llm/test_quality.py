import numpy as np

from prioscope.llm.quality import WIDTH, classify, index_vectors, pooled, token_buckets, train, word_vectors


def test_index_vectors_are_sparse_and_signed():
    place, sign = index_vectors()
    assert place.min() == 0 and place.max() == WIDTH - 1 and abs(sign.mean()) < 0.01


def test_word_vectors_equal_a_plain_sum(spark):
    texts = ["a b c a!", "b b", "", "c"]
    vectors, share = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    place, sign = index_vectors()
    want = {}
    for t in texts:
        _, code = token_buckets([t])
        for i, own in enumerate(code):
            total = want.setdefault(int(own), np.zeros(WIDTH))
            for j in range(max(0, i - 2), min(len(code), i + 3)):
                if j != i:
                    np.add.at(total, place[code[j]], sign[code[j]])
    for b, v in want.items():
        assert np.allclose(vectors[b], v / max(np.linalg.norm(v), 1e-9), atol=1e-6)
    assert abs(share.sum() - 1) < 1e-9 and (share > 0).sum() == len(want)


def test_pooling_and_empty_texts():
    vectors, share = np.ones((1 << 16, WIDTH), np.float32), np.zeros(1 << 16)
    x = pooled(["", "one two", "   "], vectors, share)
    assert not x[0].any() and not x[2].any() and np.allclose(x[1][:WIDTH], 1) and np.allclose(x[1][WIDTH : 2 * WIDTH], 0)
    assert np.allclose(x[1][2 * WIDTH :], 0.5)


def test_temperature_calibrates():
    pick = np.random.default_rng(2)
    x = pick.normal(size=(6000, 4))
    y = (pick.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = train(x[:5000], y[:5000]).probability(x[5000:])
    for low in (0.1, 0.4, 0.7):
        own = (p >= low) & (p < low + 0.2)
        assert abs(p[own].mean() - y[5000:][own].mean()) < 0.1


def test_held_out_accuracy(spark):
    pick = np.random.default_rng(4)
    good, bad = [f"word{i}" for i in range(80)], ["|", "!!", "###", "BUY", "NOW"]
    docs = [(i, " ".join(pick.choice(good if i % 4 else good[:20] + bad * 6, 40))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    found = classify(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.95


def test_tricky_rows(spark, tricky, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (9, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    found = classify(tricky, labels).collect()
    assert len(found) == tricky.count() and all(0 <= r.score <= 1 for r in found)
    assert classify(nothing, labels).count() == 0
    assert {r.score for r in classify(tricky, labels.where("false")).collect()} == {0.5}
