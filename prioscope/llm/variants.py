"""Grouping of spelling variants by an index of variable-length grams (operator 12).

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code
point turns one into the other. To find near words without comparing all of them, a dictionary
keeps the grams that many words share; a gram of a word is lengthened as long as the dictionary
holds it, so lists of frequent short grams are never needed. Grams covered by an earlier one are
left out. For every gram of a word it is known which places of the word were read to form it,
and so which edits can affect it. Of a word's grams the two rarest are taken that no single edit
affects together: a near word keeps at least one of them, so the word's list merge needs these two
lists only. Candidates of a list are verified by edit distance inside the join.

A gram is at most half as long as the shorter of two compared words, so such two grams always
exist. Words are therefore indexed for shorter partners under the grams of that length. List
keys hold the length, the place and the gram, hashed to 64 bits; a clash only adds a candidate.
Lists of over ``BLOCK`` words are cut into blocks, which different tasks compare.

Defined results: a null or empty text has no words; a null id counts as empty text in the rule that
damages runs; repeated rows count as often as they come; words equal in count tie to the smallest
in code-point order. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prioscope.llm.common import kept, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
DAMAGE_EVERY = 199
FORM_RATIO = 5
SHORTEST_GRAM, LONGEST_GRAM = 2, 6
#: The dictionary holds at most this many grams of each length.
GRAMS_PER_LENGTH, LEAST_SHARED = 50_000, 32
BLOCK = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words ------------------------------------------------------------------------------


def damaged(doc_id: Column, run: Column, every: int = DAMAGE_EVERY) -> Column:
    """The run, less one code point where the hash of id and run is a multiple of ``every``."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (hashed % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(hashed % every == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, stored."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run"))
    # Runs too short for a word even before the damage need not be looked at further.
    long = runs.where(F.char_length("run") >= least_length)
    lowered = long.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")))
    words = lowered.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return kept(counted, "words")


# --- grams ------------------------------------------------------------------------------


def gram_limit(length: int) -> int:
    """The longest gram used where the shorter of two words has this length."""
    return max(SHORTEST_GRAM, min(length // 2, LONGEST_GRAM))


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Grams that many words share, with their count.

    A gram must be counted more often than the ``GRAMS_PER_LENGTH``-th part of all places of words, so
    there are at most ``GRAMS_PER_LENGTH`` of each of the four lengths, however many words come.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: Counter = Counter()
            for w in frame["word"]:
                for size in range(SHORTEST_GRAM, LONGEST_GRAM):
                    found.update([w[i : i + size] for i in range(len(w) - size + 1)])
            yield pd.DataFrame({"gram": list(found.keys()), "n": list(found.values())})

    places = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0)).alias("n")).first().n
    least = max(LEAST_SHARED, places // GRAMS_PER_LENGTH)
    counted = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counted.where(F.col("n") > least).collect()}


def decompose(word: str, limit: int, shared: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """(place, gram, low, high) of the grams of a word that no earlier gram covers.

    Only edits of the places ``low`` to ``high - 1``, or between two of them, can affect a gram. A
    range that starts below 0 or ends beyond the word also depends on where the word starts or ends.
    """
    ends, reads = [], []
    for start in range(len(word) - SHORTEST_GRAM + 1):
        end = start + SHORTEST_GRAM
        while end - start < limit and word[start:end] in shared:
            if end == len(word):
                end += 1
                break
            end += 1
        reads.append(end)
        ends.append(min(end, len(word)))
    grams, furthest = [], 0
    for start, end in enumerate(ends):
        if end > furthest:
            low = end - limit  # no gram that starts earlier can cover this one
            grams.append((start, word[start:end], low, max(reads[max(low, 0) : start + 1])))
            furthest = end
    return grams


def rarest_two(grams: list[tuple[int, str, int, int]], shared: dict[str, int]) -> list[tuple[int, str]]:
    """The two grams with the shortest lists that no single edit affects together."""
    rare = min(shared.values(), default=2) // 2
    best, chosen = None, None
    for at, (_, gram, _, high) in enumerate(grams):
        for other in grams[at + 1 :]:
            if high <= other[2]:
                cost = shared.get(gram, rare) + shared.get(other[1], rare)
                if best is None or cost < best:
                    best, chosen = cost, (grams[at], other)
    return [(g[0], g[1]) for g in chosen]


def _lists(words: DataFrame, shared: dict[str, int], least_length: int) -> DataFrame:
    """(word, n, asks, holds): the list keys in which a word looks for partners, and those in which it stands."""
    known = words.sparkSession.sparkContext.broadcast(shared)

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = known.value
        for frame in frames:
            asks, holds = [], []
            for w in frame["word"]:
                size = len(w)
                own = decompose(w, gram_limit(size), grams)
                two = rarest_two(own, grams)
                asks.append([f"{size}={p}{g}" for p, g in two] + [f"{size}+{p + s}{g}" for p, g in two for s in (0, 1)])
                held = [f"{size}={p}{g}" for p, g, _, _ in own]
                if size > least_length:
                    held += [f"{size - 1}+{p}{g}" for p, g, _, _ in decompose(w, gram_limit(size - 1), grams)]
                holds.append(held)
            yield pd.DataFrame({"word": frame["word"].values, "n": frame["n"].values, "asks": asks, "holds": holds})

    return words.select("word", "n").mapInPandas(keys, "word string, n long, asks array<string>, holds array<string>")


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(a, a_n, b, b_n) for near words, each pair in one order, some more than once."""
    lists = kept(_lists(words, gram_dictionary(words), least_length), "grams", batch=10_000)
    asks = lists.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode("asks").alias("k")).withColumn("key", F.xxhash64("k")).drop("k")
    holds = lists.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode("holds").alias("k")).withColumn("key", F.xxhash64("k")).drop("k")
    # A long list is cut into blocks; whoever asks for it asks for all of its blocks.
    long = kept(
        holds.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).alias("blocks")),
        "long-lists",
    )
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    asked = asks.join(long, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")
    held = holds.join(long, "key", "left").withColumn("block", F.pmod(F.xxhash64("b"), blocks)).drop("blocks")
    same_length_once = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    left, right = asked.alias("l"), held.alias("r")
    found = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block")) & same_length_once & one_edit)
    return found.select("a", "a_n", "b", "b_n")


# --- forms ------------------------------------------------------------------------------


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word; ``form`` and ``form_n`` are null for a word that stands for itself."""
    words = word_counts(docs, least_length, least_count)
    pairs = kept(near_pairs(words, least_length), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # A word has few near words: there are only so many single edits of it.
    best = both.groupBy("word").agg(
        F.size(F.collect_set("near")).cast("long").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    top = -F.col("best.less")
    stands = top >= F.col("n") * ratio
    formed = kept(
        words.join(best, "word", "left").select(
            "word", F.when(stands, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(stands, top).alias("form_n"),
        ),
        "formed",
    )
    return formed.join(_roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms. A form is more frequent than its word, so chains end; they halve every round."""
    ahead = kept(formed.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = kept(ahead.join(step, "root").select("word", F.col("root").alias("old"), F.col("further").alias("root")), "roots")
        ahead = after.select("word", "root")
        if after.where("root <> old").isEmpty():
            return ahead


__all__ = ["decompose", "gram_dictionary", "gram_limit", "near_pairs", "rarest_two", "variants", "word_counts"]
