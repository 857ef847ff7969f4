import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from prioscope.llm import phrases as P


def lower(text):
    return text.encode().lower().decode()


def plain(rows, longest=4, least=30, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            inside = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_equals_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(7)
    want = plain([(r.lang, r.text) for r in docs.collect()], least=12)
    assert len(want) > 100 and len({len(r[2].split(" ")) for r in want}) == 3
    assert rows_of(P.collocations(docs, least=12)) == want
    assert rows_of(P.collocations(docs, least=12, top=3)) == [r for r in want if r[1] <= 3]


def test_tricky_rows(spark, tricky, nothing):
    want = plain([(r.lang, r.text) for r in tricky.collect()], least=2)
    assert want and {r[0] for r in want} == {"und"}
    assert rows_of(P.collocations(tricky, least=2)) == want
    assert P.collocations(nothing).count() == 0


def test_pieces_languages_and_overlaps(spark):
    rows = [("x", "a a a a a a"), ("x", "A a.a A\x0ba\x0ca"), (None, "ü\xa0b ü\xa0b, c\td c d"), ("und", "C D! c\x1cd c\x1cd"), ("", "c d"), ("x", ". , ;"), ("x", None)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(P.collocations(docs, least=2)) == plain(rows, least=2)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**15
    rows = [(big, big + 1, big), (30, 30, 31), (7 * 10**15 + 1, 10**16 + 3, 8 * 10**15)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select(P.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in found] == [2000000 * a // (l + r) for a, l, r in rows]


def test_filters_that_let_everything_through_change_nothing(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    want = rows_of(P.collocations(docs, least=5))
    monkeypatch.setattr(P, "bit_filter", lambda numbers, column: np.full(16, -1, np.int64))
    assert want and rows_of(P.collocations(docs, least=5)) == want
