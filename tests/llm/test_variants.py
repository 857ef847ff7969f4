import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from prioscope.llm import variants as V


def plain_words(rows, length, least):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]


def plain_variants(rows, length=6, least=5):
    n = plain_words(rows, length, least)
    letters = sorted({c for w in n for c in w})
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_plain_version(spark, folder, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "LEAST_SHARED", 8)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 500 and any(w[1] for w in want) and any(w[4] > 3 for w in want)
    assert found(V.variants(docs)) == want


def test_tricky_rows(spark, tricky, nothing):
    want = plain_variants([(r.doc_id, r.text) for r in tricky.collect()], 4, 2)
    assert found(V.variants(tricky, 4, 2)) == want and want
    assert V.variants(nothing).count() == 0


def test_chains_ties_and_case(spark):
    text = "aaaaaab " * 5 + "Aaaaaac " * 25 + "aaaaad " * 125 + "zzzzzzx zzzzzzy " * 30 + "zzzzzz " * 6 + "ÉCOLES écoles Écoles " * 5
    rows = [(n, part) for n, part in enumerate(text.split(" "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(V.variants(docs)) == plain_variants(rows)


words = st.text(alphabet="abcé", min_size=6, max_size=16)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(0, 16), st.sampled_from("abcé"), st.sets(st.text(alphabet="abcé", min_size=2, max_size=5)))
def test_any_edit_leaves_one_of_the_two_grams(word, place, letter, shared):
    shared = {g: 40 + len(g) for g in shared}
    place = min(place, len(word))
    for other in (word[:place] + letter + word[place:], word[:place] + letter + word[place + 1 :]):
        short, long = sorted((word, other), key=len)
        limit = V.gram_limit(len(short))
        two = V.rarest_two(V.decompose(short, limit, shared), shared)
        held = {(p, g) for p, g, _, _ in V.decompose(long, limit, shared)}
        shifts = (0, 1) if len(long) > len(short) else (0,)
        assert len(two) == 2 and any((p + s, g) in held for p, g in two for s in shifts)


def test_dictionary_bound(spark):
    words = spark.range(2000).selectExpr("concat('common', conv(cast(id as string), 10, 4)) AS word", "9L AS n")
    shared = V.gram_dictionary(words)
    assert "co" in shared and "commo" in shared and min(shared.values()) > V.LEAST_SHARED
