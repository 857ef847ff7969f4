import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import Row

from prioscope.llm import mixing as M
from prioscope.sources.staging import fresh_path


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Share, hold the full ones at their limit, share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= full
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
    return names, target


def plain_apportion(targets, seats):
    given = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (given[i] + 0.5), -i))
        given[best] += 1
    return given


def sizes_of(rows):
    out = defaultdict(int)
    for source, text in rows:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


CASES = [
    {"a": 10, "b": 1000, "c": 700, "d": 3, None: 50, "e": 0}, {"a": 100}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1},
    {f"s{i:02d}": 7 * i * i + 1 for i in range(40)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_and_quotas_equal_plain_versions(spark, sizes):
    names, want = plain_targets(sizes)
    rows = [Row(mark=str(s), source=s, words=n, key=b"k") for s, n in sizes.items()]
    sources = M.with_targets(M.source_table(spark.createDataFrame(rows, "mark string, source string, words long, key binary"))).cache()
    got = {r.source: r for r in sources.collect()}
    assert [got[s].place for s in names] == list(range(len(names)))
    assert all(abs(got[s].target - float(want[s])) <= 1e-9 * (1 + float(want[s])) for s in names)
    total = sum(sizes.values())
    block, per_shard = max(4, total // 200), 23
    quotas = {(r.shard, r.place): r for r in M.apportion(sources, block, per_shard).collect()}
    seats, before = -(-total // block), [0] * len(names)
    for shard in range(1, -(-seats // per_shard) + 1):
        after = plain_apportion([got[s].target for s in names], min(shard * per_shard, seats))
        for i, s in enumerate(names):
            if got[s].target > 0:
                assert quotas[(shard, i)].seats == after[i] and quotas[(shard, i)].blocks == after[i] - before[i] >= 0
        before = after


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = M.mix(docs, shard_blocks=300)
    rows = mixed.rows.collect()
    names, target = plain_targets(sizes_of([(r.source, r.text) for r in docs.collect()]))
    taken, size = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.mark] += r.taken
    for r in mixed.sources.collect():
        assert abs(taken[r.mark] - float(target[r.source])) <= M.BLOCK_WORDS
    again = M.mix(docs.repartition(5), shard_blocks=300).rows
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in rows)
    other = M.mix(docs, seed=5).rows
    assert sorted((r.doc_id, r.taken) for r in other.collect()) != sorted((r.doc_id, r.taken) for r in rows)
    plan = mixed.rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pieces_are_what_is_taken(spark, folder, monkeypatch):
    monkeypatch.setattr(M, "_CELL_WORDS", 500)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = fresh_path(spark, "mix")
    mixed = M.write_mix(docs, path, shard_blocks=400)
    parts = M.pieces(mixed)
    per_row = {(bytes(r.key), r.copy): r.n for r in parts.groupBy("key", "copy").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "n").collect()}
    assert per_row == {(bytes(r.key), r.copy): r.taken for r in mixed.rows.collect() if r.taken}
    shards = Counter()
    texts = defaultdict(list)
    for r in spark.read.parquet(path).collect():
        shards[r.shard] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        texts[r.doc_id].append(r.text)
    assert len(shards) > 5 and all(abs(n - 400 * 16) <= 16 * 20 for s, n in shards.items() if s < max(shards))
    whole = {r.doc_id: r.text for r in docs.collect()}
    squeezed = {i: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in whole.items()}
    assert all(t == whole[i] or t in squeezed[i] for i, ts in texts.items() for t in ts)
    assert sum(t == whole[i] for i, ts in texts.items() for t in ts) > 50


def test_tricky_rows(spark, tricky, nothing):
    found = M.mix(tricky).rows.collect()
    assert sorted(r.size for r in found) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in tricky.collect())
    assert sum(r.taken for r in found) == -(-sum(r.size for r in found) // 16) * 16
    assert M.mix(nothing).rows.count() == 0
    path = fresh_path(spark, "mix")
    M.write_mix(tricky, path)
    assert spark.read.parquet(path).count() >= sum(r.taken > 0 for r in found)


def test_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(M, "_COPIES", 10)
    docs = spark.range(200).selectExpr("if(id < 150, null, id) AS doc_id", "if(id < 150, 'the same text', 'another text here') AS text", "if(id < 100, null, 'x') AS source")
    found = M.mix(docs).rows.collect()
    assert len(found) == 200 and len({(r.mark, bytes(r.key), r.copy) for r in found}) == 200
    assert abs(sum(r.taken for r in found) - 600) <= 32 and max(r.taken for r in found) <= 9
