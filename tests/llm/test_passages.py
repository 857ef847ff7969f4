import random
from hashlib import sha256

import numpy as np
import pytest

from prioscope.llm import passages
from prioscope.llm.passages import ANCHOR, LENGTH, SPAN, _BASES, _Hashes, remove_repeats, segments
from prioscope.llm.suffixes import suffix_arrays


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a set of all windows; rows in the operator's order."""
    seen, found = set(), []
    for doc_id, data in rows:
        mark = np.zeros(len(data), bool)
        for i in range(len(data) - LENGTH + 1):
            window = data[i : i + LENGTH]
            if window in seen:
                mark[i : i + LENGTH] = True
            seen.add(window)
        rest = bytes(np.frombuffer(data, np.uint8)[~mark])
        spans = int((mark & ~np.append(False, mark[:-1])).sum()) if len(mark) else 0
        found.append((doc_id, len(data), int(mark.sum()), spans, sha256(rest).hexdigest()))
    return sorted(found, key=str)


def check(docs):
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    found = remove_repeats(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_arrays_equal_sorting(letters):
    pick = np.random.default_rng(letters)
    texts = [[*pick.integers(1, letters + 1, n), 0] for n in (0, 1, 2, 7, 60, 200)] + [[1, 2] * 30 + [0], [2, 1] * 30 + [0]]
    symbols, first, last = [], [], []
    for t in texts:
        symbols.append(-9)
        first.append(len(symbols))
        symbols += t
        last.append(len(symbols) - 1)
    found = suffix_arrays(np.array(symbols), np.array(first), np.array(last))
    for a, b, t in zip(first, last, texts):
        assert (found[a : b + 1] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_every_window_has_its_leftmost_anchor():
    pick = random.Random(1)
    texts = [bytes(pick.choice(b"abc ") for _ in range(n)) for n in (0, 5, 99, 100, 101, 150, 900)] + [b"a" * 300, b"hello " * 60]
    s = segments(texts)
    found = {(t, a + k): p for t, a, p, n in zip(s["text"], s["start"], s["anchor_at"], s["windows"]) for k in range(n)}
    assert len(found) == s["windows"].sum() == sum(max(0, len(t) - LENGTH + 1) for t in texts)
    for (t, at), anchor in found.items():
        h = _Hashes(np.frombuffer(texts[t], np.uint8), _BASES[0]).of_all(ANCHOR)
        assert anchor == at + int(np.argmin(h[at : at + SPAN]))


def test_generated_documents(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_tricky_rows(tricky, nothing):
    check(tricky)
    assert remove_repeats(nothing).count() == 0


def edited(pick):
    """Copies of one text, each edited somewhere else, so that anchors have many different segments."""
    base = "".join(pick.choice("abcdefgh ") for _ in range(700))
    rows = []
    for i in range(90):
        at = pick.randrange(len(base))
        rows.append((i, base[:at] + str(i) + base[at + pick.randrange(4) :]))
    return rows


@pytest.mark.parametrize("large", [2, 48, 1000])
def test_anchors_with_many_segments(spark, monkeypatch, large):
    monkeypatch.setattr(passages, "LARGE", large)
    check(spark.createDataFrame(edited(random.Random(3)), "doc_id long, text string"))


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 256)
    pick = random.Random(4)
    base = "".join(pick.choice("abcdé") for _ in range(2000))
    check(spark.createDataFrame([(1, base), (2, "x" + base), (3, base[500:] + base[:700])], "doc_id long, text string"))


def test_remaining_bytes(spark):
    pick = random.Random(5)
    text = "".join(pick.choice("abcdefgh") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, "before" + text + "after")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept_bytes) for r in remove_repeats(docs, with_bytes=True).collect()} == {1: text.encode(), 2: b"beforeafter"}
