import os
import random

import numpy as np
import pytest

from prioscope.llm import pieces
from prioscope.llm.pieces import PieceModel, decode, encode, encoded_units, load_model, merge_ids, occurrences, viterbi_ids

PATH = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public model here")
TEXTS = [
    "Hello  world\n\n a é 😀  x", " lead", "trail ", "", "   ", "\t\r\n", "internationalization's antidisestablishmentarianism", "--------------------" * 9, "aaaa" * 500,
    "梦 벨 ゼ 漢字かな", "<s> <0x0A> </s> <unk>", "3.14159 2,718", "ñandú Émile straße", "x" * 70 + " y", "\x00\x7f", "ﬁ ½ é",
]


@pytest.fixture(scope="module")
def model():
    return load_model(PATH)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def unigram(model):
    return PieceModel(**{**vars(model), "merges": False})


def ids_of(spark, units, model):
    rows = encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), spark, model).collect()
    return {r.unit: [x for p in r.pieces for x in ([p.id] if p.id is not None else model.spelled(p.text))] for r in rows}


def units(model):
    found = {u for t in TEXTS for u in model.units(model.marked(t)) if len(u) <= 64}
    pick = random.Random(2)
    return sorted(found | {"".join(pick.choice("▁etaoinshr") for _ in range(pick.randrange(1, 14))) for _ in range(150)})


def test_encoding_is_the_librarys(spark, model, library, folder):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    want = sorted((r.doc_id, library.encode(r.text)) for r in docs.collect())
    for most in (5, 1 << 18):
        found = encode(docs, model, most).collect()
        assert sorted((r.doc_id, list(r.ids)) for r in found) == want
        assert all(r.round_trip and r.n_ids == len(r.ids) for r in found)


def listed(texts, model, most):
    found = [[] for _ in texts]
    for units_, number, row in occurrences(texts, model, most):
        for i, r in zip(number.tolist(), row.tolist()):
            found[r].append(units_[i])
    return found


def test_occurrences_are_the_units_in_order(model):
    pick = random.Random(4)
    texts = TEXTS + ["".join(pick.choice("ab e▁漢1.") for _ in range(pick.randrange(0, 90))) for _ in range(60)]
    want = [model.units(model.marked(t)) for t in texts]
    for most in (1, 7, 50, 10**6):
        assert listed(texts, model, most) == want


def test_units_of_one_hash_stay_apart(model, monkeypatch):
    texts = ["one two", "three one", "two neo"]
    want = [model.units(model.marked(t)) for t in texts]
    monkeypatch.setattr(pieces, "_BASE", np.uint64(1))
    monkeypatch.setattr(pieces, "_UNBASE", np.uint64(1))
    assert listed(texts, model, 10**6) == want


def test_a_text_with_an_unknown_letter_does_not_come_back(spark, model):
    bare = PieceModel(**{**vars(model), "byte_ids": []})
    assert "𓀀" not in model.scores
    docs = spark.createDataFrame([(1, "plain text"), (2, "plain 𓀀 text"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in encode(docs, bare).collect()} == {1: True, 2: False, 3: True}


def test_lattice_folds_equal_the_plain_rules(spark, model, unigram):
    wanted = units(model)
    assert ids_of(spark, wanted, model) == {u: merge_ids(u, model) for u in wanted}
    cost = lambda ids: round(sum(-s for s, i in model.scores.values() for x in ids if x == i), 3)
    found = ids_of(spark, wanted, unigram)
    assert {u: cost(i) for u, i in found.items()} == {u: cost(viterbi_ids(u, unigram)) for u in wanted}


def test_viterbi_finds_the_best_of_all_ways(spark, unigram):
    def ways(unit):
        if not unit:
            yield 0.0, []
        for end in range(1, len(unit) + 1):
            if unit[:end] in unigram.scores:
                own, piece = unigram.scores[unit[:end]]
                for cost, rest in ways(unit[end:]):
                    yield cost - own, [piece, *rest]

    words = ["▁the", "▁understand", "▁hello", "▁straight", "estion"]
    found = ids_of(spark, words, unigram)
    for w in words:
        assert (min(ways(w))[0], found[w]) in list(ways(w))


def test_decoding(spark, model, library):
    rows = [(i, library.encode(t)) for i, t in enumerate(TEXTS)] + [(None, None), (None, [])]
    found = {(r.doc_id, r.text) for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), model).collect()}
    assert found == {(i, t) for i, t in enumerate(TEXTS)} | {(None, "")}


def test_tricky_rows(spark, model, tricky, nothing):
    found = encode(tricky, model).collect()
    assert len(found) == tricky.count() and all(r.round_trip for r in found)
    assert encode(nothing, model).count() == 0


def test_a_task_holds_blocks_of_bounded_size(model):
    """A block of two million characters took 102 MB of a Python worker."""
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(50_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(1500)]
    assert sum(map(len, texts)) > 3_000_000
    tracemalloc.start()
    total = sum(len(number) for _, number, _ in occurrences(texts, model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 500_000 and peak < 80e6


def test_the_driver_holds_no_object_per_unit(spark, model):
    """As rows and a dictionary 20,000 units took 13 MB of the driver's Python; 6 MB of what is left is the piece table."""
    import pickle
    import tracemalloc

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(7)) for _ in range(20_000)})
    docs = spark.createDataFrame([(i, " ".join(words[i::50])) for i in range(50)], "doc_id long, text string")
    shared = spark.sparkContext.broadcast(model)
    tracemalloc.start()
    found = pieces.dictionary(docs, model, shared)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = pickle.loads(pickle.dumps(found))
    assert len(table) == len(found) > 15_000 and peak < 400 * len(found)
    assert all(np.frombuffer(table[u], np.int32).tolist() == merge_ids(u, model) for u in sorted(table)[::97])
