"""Benchmark decontamination with a BM25 index of the test items (operator 4).

Spark builds an inverted index of the items: (term, item, impact), where the impact is the BM25
weight of the term in the item as a share of the least score that a passage can have which holds
enough of the item's shingles, so one threshold serves all items and loses nothing that would
count. Every document is cut into passages that overlap by half, and every passage that has a
shingle of some item at all queries the index by block-max WAND: sums of the
largest impacts per block of items rule out nearly all passages, the rest walk the posting lists
with a pivot, and every item over the threshold is retrieved. A retrieved item is verified in a window of
twice its own length, wherever it stands: with a question and an answer it counts only if
the window holds enough of the five-word shingles of both; given as one text, if the
window holds enough of all its shingles. Passages are long enough to hold every window of every
item, so a verdict on a document and an item does not depend on what else the benchmark holds.

The index is split by item into shards of a bounded number of postings; each shard is broadcast
in a pass of its own, so a driver or task never holds more than one bounded shard.

Defined results: null texts count as empty; items without words match nothing; repeated items
match each on their own; an empty benchmark leaves every document clean. For an item given as one
text the columns of ``item_words`` show its last sentence as the answer (the last fifth of the
words, if there is one sentence only); no verdict depends on that. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from prioscope.llm.common import free_name, kept, row_key, text_of
from prioscope.llm.shingles import chunks, mixed, words_of

K1, B = 1.2, 0.75
WIDTH = 5
#: A passage must reach this share of the least score that verification can accept for an item.
SCORE_SHARE = 1.0
#: Shares of the five-word shingles of the question and of the answer that a passage must hold.
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.5
#: Share of all its shingles that a passage must hold of an item that is given as one text.
WHOLE_SHARE = 0.5
LEAST_PASSAGE = 64
#: A shard's items are cut into at most so many blocks, and a shard has about so many postings.
MAX_BLOCKS = 128
MAX_POSTINGS = 200_000
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item given as one text."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))]


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(nr, item_id, question, answer, whole, covered): word lists, from the columns question and answer if there are any, else of one text (whole).

    ``covered`` is how many words of the item a passage holds at least, counted by place, if it holds enough of its shingles.
    """
    two = {"question", "answer"} <= set(items.columns)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [(words_of(q), words_of(a)) for q, a in zip(frame["q"], frame["a"])] if two else [split_item(q) for q in frame["q"]]
            yield pd.DataFrame(
                {
                    "nr": frame["nr"], "item_id": frame["item_id"], "question": [p[0] for p in pairs], "answer": [p[1] for p in pairs],
                    "whole": not two, "covered": [_covered(*p, not two) for p in pairs],
                }
            )

    given = items.select(
        F.monotonically_increasing_id().alias("nr"), F.col(id_col).cast("long").alias("item_id"),
        text_of("question" if two else text_col).alias("q"), (text_of("answer") if two else F.lit("")).alias("a"),
    )
    shape = "nr long, item_id long, question array<string>, answer array<string>, whole boolean, covered int"
    return kept(given.mapInPandas(split, shape).where("size(question) + size(answer) > 0"), "items")


def postings(items: DataFrame) -> DataFrame:
    """(shard, nr, term, impact, least): BM25 impacts divided by the least score of a passage that counts.

    ``least`` is that score as a share of the item's score against itself: such a passage holds ``covered``
    words of the item, so it scores no less than the ``covered`` lightest ones, a term's impact dealt to its occurrences.
    """
    terms = items.select("nr", F.explode(F.concat("question", "answer")).alias("term"))
    tf = terms.groupBy("nr", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = items.select("nr", (F.size("question") + F.size("answer")).alias("length"))
    whole = length.agg(F.count(F.lit(1)).alias("items"), F.avg("length").alias("mean_length"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    )
    weighted = tf.join(df, "term").join(length, "nr").crossJoin(F.broadcast(whole)).select("nr", "term", "tf", weight.alias("weight"))
    found = weighted.withColumn("impact", F.col("weight") / F.sum("weight").over(Window.partitionBy("nr"))).drop("weight")
    lightest = found.groupBy("nr").agg(F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(impact / tf, int(tf))")))).alias("each"))
    least = lightest.join(items, "nr").select("nr", F.expr("aggregate(slice(each, 1, covered), 0D, (a, x) -> a + x)").alias("least"))
    found = kept(found.join(least, "nr").select("nr", "term", (F.col("impact") / F.col("least")).alias("impact"), "least"), "postings")
    shards = max(1, math.ceil(found.count() / MAX_POSTINGS))
    return found.withColumn("shard", F.pmod(F.xxhash64("nr"), F.lit(shards)))


def _parts(question: list[str], answer: list[str], one: bool) -> list[tuple[frozenset, float]]:
    """Sets of shingles of an item, and the share that a passage must hold of each."""
    whole = frozenset(_shingles(question + answer))
    if one:
        return [(whole, WHOLE_SHARE)]
    early = frozenset(_shingles(question) if len(question) >= WIDTH else [])
    return [(early, QUESTION_SHARE), (whole - early, ANSWER_SHARE)]


def _covered(question: list[str], answer: list[str], one: bool) -> int:
    """So many shingles begin at as many places, and the last of them goes on to its end."""
    length = len(question) + len(answer)
    needed = sum(math.ceil(share * len(part)) for part, share in _parts(question, answer, one))
    return min(length, needed + min(WIDTH, length) - 1)


@dataclass
class Shard:
    """One bounded part of the index, as tasks use it."""

    ids: list[int | None]
    parts: list[list[tuple[frozenset, float]]]
    terms: dict[str, int]
    lists: list[tuple[list[int], list[float], float, dict[int, float]]]
    block_max: np.ndarray
    passage: int
    block: int
    least: list[float]
    runs: dict[int, np.ndarray]
    windows: list[int]


def _runs(term: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` term numbers that begin at each place."""
    n = max(0, len(term) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mixed(h * np.uint64(31) + term[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


def _shard(items: pd.DataFrame, rows: pd.DataFrame, passage: int) -> Shard:
    items = items.sort_values("nr").reset_index(drop=True)
    place = {nr: i for i, nr in enumerate(items["nr"])}
    parts = [_parts(list(q), list(a), one) for q, a, one in zip(items["question"], items["answer"], items["whole"])]
    terms: dict[str, int] = {}
    lists = []
    block = max(1, math.ceil(len(items) / MAX_BLOCKS))
    block_max = np.zeros((rows["term"].nunique(), len(items) // block + 1), np.float32)
    for term, own in rows.groupby("term"):
        pairs = sorted((place[nr], x) for nr, x in zip(own["nr"], own["impact"]))
        blocks: dict[int, float] = {}
        for i, x in pairs:
            blocks[i // block] = max(blocks.get(i // block, 0.0), x)
        for k, x in blocks.items():
            block_max[len(terms), k] = x
        terms[term] = len(terms)
        lists.append(([i for i, _ in pairs], [x for _, x in pairs], max(x for _, x in pairs), blocks))
    runs: dict[int, list[np.ndarray]] = {}
    for q, a in zip(items["question"], items["answer"]):
        own = np.array([terms[w] for w in [*q, *a]], np.int64)
        runs.setdefault(min(WIDTH, len(own)), []).append(_runs(own, min(WIDTH, len(own))))
    by_nr = dict(zip(rows["nr"], rows["least"]))
    least = [float(by_nr[nr]) for nr in items["nr"]]
    windows = [window_of(len(q) + len(a)) for q, a in zip(items["question"], items["answer"])]
    return Shard(
        list(items["item_id"]), parts, terms, lists, block_max, passage, block, least, {k: np.unique(np.concatenate(x)) for k, x in runs.items()}, windows
    )


def wand(query: list[int], shard: Shard) -> list[tuple[int, float]]:
    """Every item whose impacts over the query's terms reach the threshold, by block-max WAND."""
    cursors = [[0, shard.lists[t]] for t in query]
    found, limit = [], SCORE_SHARE - 1e-9
    while cursors:
        cursors.sort(key=lambda c: c[1][0][c[0]])
        total, pivot = 0.0, -1
        for k, (_, (_, _, most, _)) in enumerate(cursors):
            total += most
            if total >= limit:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][1][0][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
            pivot += 1
        block = item // shard.block
        if sum([c[1][3].get(block, 0.0) for c in cursors[: pivot + 1]]) < limit:
            target = (block + 1) * shard.block
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][1][0][cursors[pivot + 1][0]])
        elif cursors[0][1][0][cursors[0][0]] == item:
            score = sum(c[1][1][c[0]] for c in cursors[: pivot + 1])
            if score >= limit:
                found.append((item, score))
            target = item + 1
        else:
            target = item
        for c in cursors[: pivot + 1]:
            c[0] = bisect_left(c[1][0], target, c[0])
        cursors = [c for c in cursors if c[0] < len(c[1][0])]
    return found


def window_of(words: int) -> int:
    """How many neighbouring words of a document an item of so many words is looked for in: twice its own length."""
    return 2 * max(LEAST_PASSAGE // 2, words)


def _verified(words: list[str], item: int, shard: Shard) -> bool:
    """Whether some window of the item's own size holds enough shingles of each part of the item."""
    parts, window = shard.parts[item], shard.windows[item]
    spots = []
    for nr, (part, _) in enumerate(parts):
        for width in {len(x) for x in part}:
            found = ((i, tuple(words[i : i + width])) for i in range(len(words) - width + 1))
            spots += [(i, i + width, nr, x) for i, x in found if x in part]
    spots.sort()
    inside: dict[tuple, int] = {}
    distinct, left = [0] * len(parts), 0
    for _, end, nr, x in spots:
        inside[nr, x] = inside.get((nr, x), 0) + 1
        distinct[nr] += inside[nr, x] == 1
        while end - spots[left][0] > window:
            gone = spots[left][2:]
            inside[gone] -= 1
            distinct[gone[0]] -= inside[gone] == 0
            left += 1
        if all(n >= share * len(part) for n, (part, share) in zip(distinct, parts)):
            return True
    return False


def _passages(texts: list[str], shard: Shard) -> Iterator[tuple[int, int, float]]:
    """(text number, item, score) of verified hits."""
    half = shard.passage // 2
    get = shard.terms.get
    words = [words_of(t) for t in texts]
    steps = np.array([max(1, math.ceil(len(w) / half)) for w in words])
    first = np.concatenate([[0], np.cumsum(steps)])
    term = np.fromiter((get(x, -1) for w in words for x in w), np.int64)
    sizes = np.array([len(w) for w in words])
    inside = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = np.repeat(first[:-1], sizes) + inside // half
    # A passage that has no run of words of any item cannot count; its runs begin in its two pieces.
    begins = np.zeros(first[-1] + 1, bool)
    begins[first] = True
    marked = np.zeros(first[-1] + 1, bool)
    text = np.repeat(np.arange(len(words)), sizes)
    for width, wanted in shard.runs.items():
        run = _runs(term, width)
        at = np.flatnonzero((term[: len(run)] >= 0) & (text[: len(run)] == text[width - 1 :]))
        marked[piece[at[np.isin(run[at], wanted)]]] = True
    open_ = marked[:-1] | (~begins[1:] & marked[1:])
    used = np.append(open_, False)
    used[1:] |= open_ & ~begins[1:]
    known = (term >= 0) & used[piece]
    pairs = np.unique(piece[known] * len(shard.terms) + term[known])
    piece, term = np.divmod(pairs, max(1, len(shard.terms)))
    if not len(pairs):
        return
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    bound = np.zeros((first[-1] + 1, shard.block_max.shape[1]), np.float32)
    bound[piece[starts]] = np.add.reduceat(shard.block_max[term], starts, axis=0)
    # A passage is a piece and the next one; a piece that begins a text is not a passage's end.
    two = bound[:-1] + np.where(begins[1:, None], 0, bound[1:])
    at = np.searchsorted(piece, np.arange(first[-1] + 2))
    for p in np.flatnonzero(open_ & (two.max(axis=1) >= SCORE_SHARE - 1e-4)):
        end = p + 1 if begins[p + 1] else p + 2
        query = sorted(set(term[at[p] : at[end]].tolist()))
        nr = int(np.searchsorted(first, p, side="right")) - 1
        offset = (int(p) - int(first[nr])) * half
        for item, score in wand(query, shard):
            if _verified(words[nr][offset : offset + shard.passage], item, shard):
                yield nr, item, score * shard.least[item]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, score) of every document and item that match; the key tells rows apart by id and text."""
    spark = docs.sparkSession
    items = item_words(benchmark)
    rows = postings(items)
    longest = items.agg(F.max(F.size("question") + F.size("answer"))).first()[0] or 0
    passage = 2 * window_of(longest)  # passages overlap by half, so every window of every item lies in one
    shape = "key binary, item_id long, score double"
    passes = [spark.createDataFrame([], shape)]
    for shard_nr in [r.shard for r in rows.select("shard").distinct().collect()]:
        own = rows.where(F.col("shard") == shard_nr).drop("shard")
        chosen = items.join(own.select("nr").distinct(), "nr", "left_semi")
        shard = spark.sparkContext.broadcast(_shard(chosen.toPandas(), own.toPandas(), passage))

        def search(frames: Iterator[pd.DataFrame], shard=shard) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part in chunks(frame, "text"):
                    best: dict[tuple[int, int], float] = {}
                    for nr, item, score in _passages(list(part["text"]), shard.value):
                        best[nr, item] = max(score, best.get((nr, item), 0.0))
                    keys = part["key"].tolist()
                    if best:
                        yield pd.DataFrame(
                            [(keys[nr], shard.value.ids[item], score) for (nr, item), score in best.items()], columns=["key", "item_id", "score"]
                        )

        passes.append(kept(docs.select(row_key().alias("key"), text_of().alias("text")).mapInPandas(search, shape), "hits"))
        shard.unpersist()
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, best_score) per row of ``docs``."""
    found = hits(docs, benchmark).groupBy("key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.round(F.max("score"), 6).alias("best_score")
    )
    return docs.select("doc_id", row_key().alias("key")).join(found, "key", "left").select(
        "doc_id", F.col("best_score").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(T.ArrayType(T.LongType()))).alias("item_ids"), "best_score"
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that match no item, with all their columns."""
    name = free_name(docs, "_struck")
    struck = hits(docs, benchmark).select(F.col("key").alias(name)).distinct()
    return docs.join(struck, row_key() == F.col(name), "left_anti")
