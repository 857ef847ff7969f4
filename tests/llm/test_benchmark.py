import random

import numpy as np

from prioscope.llm.benchmark import SCORE_SHARE, _shard, clean_rows, contamination, item_words, postings, split_item, wand
from prioscope.llm.shingles import words_of


def test_items_are_split():
    assert split_item("What is it? It is this.") == (["what", "is", "it"], ["it", "is", "this"])
    assert split_item("one two three four five six")[1] == ["six"] and split_item("") == ([], [])


def test_wand_finds_all_over_the_threshold(spark):
    pick = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(pick.choice(words, 12)) + ". " + " ".join(pick.choice(words, 5))) for i in range(300)]
    items = item_words(spark.createDataFrame(rows, "item_id long, text string"))
    table, all_items = postings(items).drop("shard").toPandas(), items.toPandas()
    shard = _shard(all_items, table, 64)
    assert shard.block > 1
    weights = {(r.nr, r.term): r.impact for r in table.itertuples()}
    order = list(all_items.sort_values("nr")["nr"])
    for _ in range(40):
        query = set(pick.choice(words, 25).tolist())
        got = {i: round(s, 9) for i, s in wand(sorted(shard.terms[q] for q in query if q in shard.terms), shard)}
        scores = {i: sum(weights.get((nr, t), 0.0) for t in query) for i, nr in enumerate(order)}
        assert got == {i: round(s, 9) for i, s in scores.items() if s >= SCORE_SHARE}


def test_planted_items_are_found(spark, folder, tricky, nothing):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [r for r in bench.collect() if len(words_of(r.text)) >= 20]
    filler = "nothing of any interest is said in these words of filler "
    rows = [(1, items[0].text), (2, filler * 30 + items[1].text.upper() + " " + filler * 40), (3, filler * 200), (4, " ".join(words_of(items[2].text)[:5])), (5, None)]
    rows += [(6, filler * 13 + items[3].text + filler + items[4].text)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    found = {r.doc_id: r.item_ids for r in contamination(docs, bench).collect()}
    assert found == {1: [items[0].item_id], 2: [items[1].item_id], 3: [], 4: [], 5: [], 6: sorted([items[3].item_id, items[4].item_id])}
    assert sorted(r.doc_id for r in clean_rows(docs, bench).collect()) == [3, 4, 5]
    assert contamination(tricky, bench).count() == tricky.count()
    assert contamination(nothing, bench).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "item_id long, text string")
    assert not any(r.contaminated for r in contamination(tricky, bench.where("false")).collect())
    assert [r.doc_id for r in contamination(tricky, odd).collect() if r.contaminated] == [5]


def test_question_and_answer_columns(spark):
    bench = spark.createDataFrame([(1, "which animal says moo in the morning", "the brown cow of the old farmer")], "item_id long, question string, answer string")
    docs = spark.createDataFrame(
        [(1, "which animal says moo in the morning the brown cow of the old farmer"), (2, "which animal says moo in the morning is unknown"), (3, "the brown cow of the old farmer")],
        "doc_id long, text string",
    )
    assert [r.doc_id for r in contamination(docs, bench).collect() if r.contaminated] == [1]


def test_small_shards_give_the_same(spark, folder, monkeypatch):
    from prioscope.llm import benchmark

    bench, docs = spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(contamination(docs, bench).collect(), key=str)
    monkeypatch.setattr(benchmark, "MAX_POSTINGS", max(1, postings(item_words(bench)).count() // 2))
    assert sorted(contamination(docs, bench).collect(), key=str) == whole
    assert any(r.contaminated for r in whole)


def test_an_edit_at_any_place_is_found(spark):
    """One text per item; its last sentence is one word, which must not decide."""
    head = [f"w{i}" for i in range(17)]
    bench = spark.createDataFrame([(7, " ".join(head) + ". End."), (8, " ".join(f"v{i}" for i in range(14)))], "item_id long, text string")
    rows = [(k, " ".join([*head[:k], "other", *head[k + 1 :], "end"])) for k in range(17)]
    rows += [(17, " ".join(head)), (18, " ".join(head) + " start"), (19, " ".join(head[:11]) + " rest"), (20, " ".join(head[:5]) + " end"), (21, " ".join(["x"] * 20 + ["end"]))]
    rows += [(30 + k, " ".join("other" if i == k else f"v{i}" for i in range(14))) for k in range(14)]
    found = {r.doc_id: r.item_ids for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {**{k: [7] for k in range(20)}, 20: [], 21: [], **{30 + k: [8] for k in range(14)}}


def test_retrieval_reaches_whatever_counts(spark, folder):
    """For every item the parts that hold just enough shingles: the least, the last and the lightest words of it."""
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows, want = [], {}
    for item in bench.collect():
        words = words_of(item.text)
        some = -(-len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) // 2) + 4
        for start in range(len(words) - some + 1):
            part = words[start : start + some]
            if len({tuple(part[i : i + 5]) for i in range(some - 4)}) == some - 4:
                want[len(rows)] = item.item_id
                rows.append((len(rows), "aa bb cc dd " * start + " ".join(part) + " ee ff" * 50))
    found = {r.doc_id: r.item_ids for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want) > 300 and [k for k, v in want.items() if v not in found[k]] == []


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "red"), (2, "blue sky"), (3, "one two three four five")], "item_id long, text string")
    rows = [(1, "a red car"), (2, "the sky blue"), (3, "a blue sky " * 100), (4, "x " * 63 + "one two three four five"), (5, "one two three four six")]
    found = {r.doc_id: r.item_ids for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {1: [1], 2: [], 3: [2], 4: [3], 5: []}


def plain_verdict(text, item):
    """Any window of twice the item's length that holds half of its shingles."""
    words, own = words_of(text), words_of(item)
    width = min(5, len(own))
    wanted = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
    window = 2 * max(32, len(own))
    for start in range(max(1, len(words) - window + 1)):
        part = words[start : start + window]
        have = {tuple(part[i : i + width]) for i in range(len(part) - width + 1)}
        if own and 2 * len(wanted & have) >= len(wanted):
            return True
    return False


def test_verdicts_equal_brute_force_and_do_not_depend_on_other_items(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(pool, k=k)) for k in (3, 5, 10, 10, 24, 40, 60, 90)]
    rows = []
    for n in range(60):
        words = rng.choices(pool, k=rng.choice([0, 4, 30, 400]))
        own = rng.choice(items).split()
        cut = sorted(rng.sample(range(len(own) + 1), 2))
        for part in (own[: cut[0]], own[cut[0] : cut[1]], own[cut[1] :]):
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((n, " ".join(words)))
    own = items[2].split()
    rows.append((60, " ".join([*own[:5], *rng.choices(pool, k=150), *own[5:]])))
    rows += [(61 + n, " ".join(rng.choices(pool, k=50)) + " " + item) for n, item in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = list(enumerate(items))
    for more in ([], [(100, " ".join(rng.choices([f"v{i}" for i in range(900)], k=400)))]):
        found = {r.doc_id: r.item_ids for r in contamination(docs, spark.createDataFrame(given + more, "item_id long, text string")).collect()}
        assert found == {n: [i for i, item in given if plain_verdict(text, item)] for n, text in rows}
    assert not found[60]
