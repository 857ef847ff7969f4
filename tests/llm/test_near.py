import random
from collections import Counter

import numpy as np
import pytest

from prioscope.llm import near
from prioscope.llm.components import components
from prioscope.llm.near import near_classes, prob_minhash
from prioscope.llm.shingles import distinct_counts, shingle_hashes, words_of


def shingles(text):
    words = words_of(text or "")
    words = words + ["\0"] * (5 - len(words)) if words else words
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    """Class of every row by comparing all pairs; rows are (doc_id, text)."""
    sets, head = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i] == rows[j] or a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [(r[0], min(groups[find(i)], key=order)[0], len(groups[find(i)])) for i, r in enumerate(rows)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_classes(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found if r.doc_id is not None) == sorted(x for x in plain(rows) if x[0] is not None)
    assert len(found) == len(rows)
    return found


def test_estimate_of_the_probability_jaccard():
    weights = [{f"e{i}": 1.0 + i % 3 for i in range(60)}, {f"e{i}": 1.0 + i % 4 for i in range(20, 80)}]
    names = sorted(weights[0].keys() | weights[1].keys())
    hashes = np.random.default_rng(0).integers(0, 2**64, len(names), dtype=np.uint64, endpoint=False)
    rows = [(t, hashes[names.index(e)], w) for t in (0, 1) for e, w in weights[t].items()]
    signature = prob_minhash(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]), 2, 4096)
    both = [e for e in names if e in weights[0] and e in weights[1]]
    want = sum(1 / sum(max(weights[0].get(f, 0) / weights[0][e], weights[1].get(f, 0) / weights[1][e]) for f in names) for e in both)
    assert abs((signature[0] == signature[1]).mean() - want) < 0.03


def test_shingles_are_counted_per_text():
    lists = [[], ["a"], "a b c d e a b c d e a b c d e".split(), "a b c d e".split()]
    text, h, n = distinct_counts(*shingle_hashes(lists, 5))
    assert Counter(text.tolist()) == {1: 1, 2: 5, 3: 1} and n.max() == 3 and h[-1] in h[text == 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_generated_documents(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_tricky_rows(tricky, nothing):
    found = check(tricky)
    assert all(r.kept for r in found if r.doc_id in (1, 2, 3, 4)) and near_classes(nothing).count() == 0


@pytest.mark.parametrize("large", [4, 4096])
def test_a_large_family_keeps_every_link(spark, monkeypatch, large):
    """Chains of edits: neighbours are alike, far ones are not, and all share most of their words."""
    monkeypatch.setattr(near, "LARGE_BUCKET", large)
    pick = random.Random(8)
    base = [f"w{pick.randrange(400)}" for _ in range(200)]
    rows = []
    for family in range(6):
        words = list(base)
        for k in range(12):
            words[(family * 31 + k * 13) % 200] = f"f{family}k{k}"
            words[(family * 17 + k * 29) % 200] = f"g{family}k{k}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(base)) for i in range(60)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.class_id for r in found if r.kept) == {r.class_id: 1 for r in found}


def test_repeated_shingles_do_not_hide_a_link(spark):
    """Sets just alike enough, one text with half of its shingles repeated many times."""
    rows = []
    for pair in range(40):
        words = [f"p{pair}w{i}" for i in range(204)]
        edited = [f"p{pair}e{i}" if i in (120, 140, 160, 180) else w for i, w in enumerate(words)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(edited[:104] * 20 + edited[104:]))]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found if r.kept) == list(range(0, 80, 2))


def test_what_many_unlike_texts_share_makes_no_large_bucket(spark, monkeypatch):
    """Eighty texts of half a common passage share bands but no links; few of them may ever be compared."""
    monkeypatch.setattr(near, "LARGE_BUCKET", 8)
    monkeypatch.setattr(near, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near, "_block_pairs", lambda large: pytest.fail("all pairs of a bucket"))
    met = []
    in_buckets = near._links_in_buckets
    monkeypatch.setattr(near, "_links_in_buckets", lambda rows, *rest: met.append(rows.groupBy("bucket").count().collect()) or in_buckets(rows, *rest))
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(common + [f"t{i}w{k}" for k in range(110)])) for i in range(80)]
    rows += [(80 + i, rows[i][1] + " end") for i in range(20)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found} == {i: i % 80 for i in range(100)}
    pairs = sum(r["count"] ** 2 // 2 for rows_ in met for r in rows_)
    assert met and pairs <= 32 * 8 * 100, pairs


def test_rare_shingles_meet_for_every_link(spark):
    pick = random.Random(5)
    sets = {i: set(pick.sample(range(60), pick.randrange(1, 40))) for i in range(60)}
    sets |= {100 + i: {*list(s)[1:], 1000 + i} if len(s) > 12 else set(s) for i, s in sets.items()}
    pack = lambda s: np.array(sorted(x << 24 for x in s), "<u8").view(np.uint8).reshape(-1, 8)[:, 3:8].tobytes()
    table = spark.createDataFrame([(i, bytearray(pack(s))) for i, s in sets.items()], "id long, shingles binary")
    buckets = {}
    for r in near._rare_shingles(table.select("id"), table, 0.8).collect():
        buckets.setdefault(r.bucket, set()).add(r.id)
    links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(links) > 30 and all(any({a, b} <= m for m in buckets.values()) for a, b in links)


def test_blocks_let_every_pair_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "LARGE_BUCKET", 10)
    large = spark.createDataFrame([(7, i, 25, i) for i in range(25)], "bucket long, id long, size long, label long")
    groups = {}
    for r in near._block_pairs(large).collect():
        groups.setdefault(r.bucket, set()).add(r.id)
    assert all(any({a, b} <= g for g in groups.values()) for a in range(25) for b in range(a))
    assert max(map(len, groups.values())) < 25
