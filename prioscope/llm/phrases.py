"""Collocations by set-oriented mining of occurrence relations (operator 13).

Texts are cut into pieces and words. The relation of single words says, for every place of every
piece, which word stands there; it is stored sorted by piece and place, one array per chunk of
texts, words as numbers and everything that cannot be part of a phrase as 0. In each pass a
relation is merge-joined with itself at the next place of the same piece, which gives the phrases
that are one word longer; Spark counts their groups; groups that are frequent enough are semi-joined back,
and the relation of those is stored for the next pass. Passes see phrases as hash numbers
and the semi-join is a bit filter, so they can only let too much through; a last pass counts
the surviving phrases by their words, exactly. No occurrence is ever shuffled by itself, only counts.

Defined results: a null or empty text has no words, a null language is ``und``, repeated rows count
as often as they come, ties are broken by the order of the result. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from prioscope.llm.common import by_group, kept, text_of
from prioscope.llm.filters import bit_filter, passes
from prioscope.llm.shingles import chunks, mixed
from prioscope.sources.staging import fresh_path

LONGEST, LEAST_COUNT = 4, 30
SCALE = 2_000_000
COVERED = (80, 100)
TOP = 2000
#: Upper case to lower case, blanks alike, every separator a full stop.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_STOP = b"."
_CHUNK = 4_000_000
_WORDS_PER_PART, _MOST_PART_BITS = 2_000_000, 26


def tokens_of(text: str) -> list[bytes]:
    """The words in order; a full stop stands wherever pieces are cut."""
    return text.encode("utf-8", "replace").translate(_BYTES).replace(_STOP, b" . ").split()


def _by_language(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    for frame in frames:
        for part in chunks(frame, "text", _CHUNK):
            for lang, texts in part.groupby("lang", sort=False)["text"]:
                flat: list[bytes] = []
                for t in texts:
                    flat += tokens_of(t)
                    flat.append(_STOP)
                yield lang, flat


def _hashes(words: np.ndarray, lang: str) -> np.ndarray:
    """A 32-bit number per word and language, never 0."""
    seed = np.uint64(int.from_bytes(lang.encode()[:8], "little") + len(lang))
    return (mixed(pd.util.hash_array(words, categorize=False) ^ mixed(np.array([seed]))[0]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, a, mark) of every word, stored; ``mark`` is its number in the relations."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, flat in _by_language(frames):
            found = Counter(flat)
            del found[_STOP]
            if found:
                yield pd.DataFrame({"lang": lang, "phrase": [w.decode() for w in found], "a": list(found.values())})

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = np.zeros(len(frame), np.int64)
            for lang, at in frame.groupby("lang", sort=False).indices.items():
                words = np.array([w.encode() for w in frame["phrase"].iloc[at]], dtype=object)
                marks[at] = mixed(_hashes(words, lang).astype(np.uint64)).view(np.int64)
            yield frame.assign(mark=marks)

    counted = texts.mapInPandas(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return kept(counted.mapInPandas(number, "lang string, phrase string, a long, mark long"), "words")


def _joined(relation: np.ndarray) -> np.ndarray:
    """Merge-join of a relation with itself at the next place: 64-bit numbers, 0 where either side is missing."""
    left, right = relation[:-1].astype(np.uint64), relation[1:].astype(np.uint64)
    both = mixed((left << np.uint64(32)) | right)
    both[(left == 0) | (right == 0)] = 0
    return np.append(both, np.uint64(0))


def _numbers(groups: np.ndarray, parts: int) -> np.ndarray:
    """The part (one of a power of two) and 32 more bits of the number of a group."""
    return groups >> np.uint64(64 - 32 - (parts.bit_length() - 1))


def _surviving(groups: np.ndarray, bits: np.ndarray, parts: int) -> np.ndarray:
    """The relation of the groups that the filter lets through, as 32-bit numbers."""
    stays = (groups != 0) & passes(bits, _numbers(groups, parts).view(np.int64))
    return np.where(stays, (groups >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))


def _relation_of_words(flat: list[bytes], lang: str, bits: np.ndarray) -> np.ndarray:
    code, distinct = pd.factorize(np.array(flat, dtype=object))
    numbers = _hashes(np.asarray(distinct, dtype=object), lang)
    stays = passes(bits, mixed(numbers.astype(np.uint64)).view(np.int64))
    numbers[~stays | (np.asarray(distinct, dtype=object) == _STOP)] = 0
    return numbers[code]


def _stored(relation: DataFrame, name: str) -> DataFrame:
    path = fresh_path(relation.sparkSession, name)
    relation.write.option("compression", "zstd").parquet(path)
    return relation.sparkSession.read.parquet(path)


def _packed(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that those that are mostly zero take no room in a shuffle."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _frequent_groups(relation: DataFrame, least: int, parts: int) -> np.ndarray:
    """Bit filter of the groups that occur often enough one word further on.

    Groups are dealt to ``parts`` by their number. A chunk sends its distinct groups of a part
    as one row, sorted and as differences, which is a third of what a row per group would take.
    The number of parts follows the number of words, so what meets in a part does not grow with the corpus.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for packed in frame["places"]:
                groups = _joined(np.frombuffer(packed, np.uint32))
                found, n = np.unique(_numbers(groups[groups != 0], parts), return_counts=True)
                ends = np.searchsorted(found >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
                rows = [(part, found[a:b].astype(np.uint32), n[a:b]) for part, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                yield pd.DataFrame([(part, _packed(np.diff(rest, prepend=np.uint32(0))), _packed(m)) for part, rest, m in rows], columns=["part", "rests", "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rests = np.concatenate([np.cumsum(_unpacked(r), dtype=np.uint32) for r in rows["rests"]])
        found, inverse = np.unique(rests, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([_unpacked(m) for m in rows["n"]]))
        often = found[total >= least].astype(np.int64)
        return pd.DataFrame({"mark": (np.int64(rows["part"].iloc[0]) << np.int64(32)) | often})

    counted = relation.mapInPandas(count, "part int, rests binary, n binary").groupBy("part").applyInPandas(add, "mark long")
    return bit_filter(counted, "mark")


def _extended(relation: DataFrame, bits: np.ndarray, parts: int) -> DataFrame:
    known = relation.sparkSession.sparkContext.broadcast(bits)

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"places": [_surviving(_joined(np.frombuffer(p, np.uint32)), known.value, parts).tobytes() for p in frame["places"]]})

    return _stored(relation.mapInPandas(extend, "places binary"), "relation")


def _exact(texts: DataFrame, filters: list[np.ndarray], least: int, parts: int) -> DataFrame:
    """(lang, phrase, a) of the phrases of two words and more, counted by their words."""
    known = texts.sparkSession.sparkContext.broadcast(filters)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, flat in _by_language(frames):
            relation = _relation_of_words(flat, lang, known.value[0])
            ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
            for nr, bits in enumerate(known.value[1:]):
                relation = _surviving(_joined(relation), bits, parts)
                at = np.flatnonzero(relation)
                # The shorter phrases at a place and at the next name the longer one, by dense numbers.
                pair = ids[at] * (ids.max() + 1) + ids[np.minimum(at + 1, len(ids) - 1)] if len(at) else at
                found, first, inverse, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                ids = np.zeros(len(flat), np.int64)
                ids[at] = inverse
                if len(found):
                    phrases = [b" ".join(flat[i : i + nr + 2]).decode() for i in at[first].tolist()]
                    yield pd.DataFrame({"lang": lang, "phrase": phrases, "a": n})

    counted = texts.mapInPandas(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return counted.where(F.col("a") >= least)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of the phrases of up to ``longest`` words with ``a >= least``, and (lang, n), both stored."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words = word_counts(texts)
    total = words.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n")).first().n
    parts = 1 << min(_MOST_PART_BITS, max(3, (total // _WORDS_PER_PART).bit_length()))
    filters = [bit_filter(words.where(F.col("a") >= least), "mark")]
    first = spark.sparkContext.broadcast(filters[0])

    def relate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, flat in _by_language(frames):
            yield pd.DataFrame({"places": [_relation_of_words(flat, lang, first.value).tobytes()]})

    relation = _stored(texts.mapInPandas(relate, "places binary"), "relation")
    for size in range(2, longest + 1):
        filters.append(_frequent_groups(relation, least, parts))
        if size < longest:
            relation = _extended(relation, filters[-1], parts)
    single = words.where(F.col("a") >= least).select("lang", "phrase", "a")
    phrases = single.unionByName(_exact(texts, filters, least, parts)).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a")
    return kept(phrases, "phrases"), kept(words.groupBy("lang").agg(F.sum("a").alias("n")), "languages")


def _part_counts(cuts: DataFrame, phrases: DataFrame, part: str, out: str) -> DataFrame:
    """Add the count of a part. A part that very many phrases share is joined by broadcast, see ``by_group``."""
    uses = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("uses"))
    known = phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(out)).join(uses, ["lang", part])
    marked = cuts.withColumn("_part", F.concat_ws("\n", "lang", part))
    return by_group(marked, kept(known.select(F.concat_ws("\n", "lang", part).alias("_part"), out, "uses"), "parts"), "_part", "uses", cuts.count()).drop("_part", "uses")


def cut_score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)) without rounding; the product may pass 64 bits."""
    wide = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)")
    return F.call_function("div", wide, (l + r).cast("decimal(20,0)")).cast("long")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words and more, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = kept(
        cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail")),
        "cuts",
    )
    both = _part_counts(_part_counts(parts, phrases, "head", "l"), phrases, "tail", "r")
    lowest = F.min(F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase that holds the phrase."""
    words = F.split("phrase", " ")
    spots = phrases.where("words > 2").select("lang", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    starts = spots.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    inner = starts.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases not covered by a longer one, best first, all or the first ``top`` of each language."""
    phrases, languages = frequent_phrases(docs, longest, least)
    share, whole = COVERED
    hidden = F.col("longer").cast("decimal(20,0)") * whole >= F.col("a").cast("decimal(20,0)") * share
    left = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~hidden).drop("longer")
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best_first))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS s(k)) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= {LEAST_COUNT}),
x AS (SELECT lang, phrase, a, unnest(range(1, k)) AS k, string_split(phrase, ' ') AS w FROM f),
y AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM x),
c AS (SELECT y.lang, y.phrase, y.a, y.k, h.a AS l, t.a AS r, ({SCALE}::HUGEINT * y.a) // (h.a + t.a) AS score
      FROM y JOIN f AS h ON h.lang = y.lang AND h.phrase = y.head JOIN f AS t ON t.lang = y.lang AND t.phrase = y.tail),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT f.lang, f.a, string_split(f.phrase, ' ') AS w, s.k, unnest(range(1, f.k - s.k + 2)) AS i
            FROM f, range(2, {LONGEST}) AS s(k) WHERE s.k < f.k) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR {COVERED[1]}::HUGEINT * longer < {COVERED[0]}::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= {TOP}
"""


__all__ = ["ORACLE", "collocations", "covered", "cut_score", "frequent_phrases", "scored", "tokens_of"]
