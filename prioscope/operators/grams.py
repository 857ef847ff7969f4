"""Words and runs of words, counted inside the task that holds their rows.

Spark prepares the texts (``plain_words``); the words of a slice of rows are then numbered at once, and runs of words are
counted as whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.text import plain_words, word_ngrams, word_tokens

#: Bytes of text that are cut into words at once; bounds what a task holds besides one long text.
SLICE_BYTES = 1 << 21
_WORDS = "_words"
#: Bytes of texts with blanks for the ASCII characters that are no part of a word.
_BLANKED = np.array([i if i > 127 or chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256)], dtype=np.uint8)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(values: Column) -> Column:
    """Array of (term, tf): sorted, then cut where the value changes. Null for an empty array."""

    def fold(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), size), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i - 2)))
        return _bound(
            starts,
            lambda at: F.zip_with(
                at, F.concat(F.slice(at, F.lit(2), size), F.array(size + 1)), lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).alias("tf"))
            ),
        )

    return _bound(F.sort_array(values), lambda s: F.when(F.size(s) > 0, fold(s)))


def term_rows(df: DataFrame, keys: list[str], text_col: str, longest: int, shortest: int = 1) -> DataFrame:
    """One row (keys, term, tf) per distinct term of a row: runs of one to ``longest`` words of at least ``shortest`` characters.

    Terms are counted where their row lies, so nothing is shuffled.
    """
    grams = counted(_bound(word_tokens(F.col(text_col), shortest), lambda t: word_ngrams(t, longest)))
    return df.select(*keys, F.inline(grams))


# --- slices of rows ---------------------------------------------------------------------


def _blanked(texts: pa.Array) -> pa.Array:
    flags, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [flags, offsets, pa.py_buffer(_BLANKED[np.frombuffer(data, np.uint8)])], offset=texts.offset)


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of parts of about ``SLICE_BYTES`` of texts from ``plain_words``, now with nothing but blanks between words."""
    texts = _blanked(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - 1) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for first, end in zip(cuts, cuts[1:]):
        if end > first:
            yield first, texts.slice(first, end - first)


def words_of(texts: pa.Array, shortest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of each spot, row of each spot) of texts from ``slices``."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    fits = pc.greater_equal(pc.utf8_length(coded.dictionary), shortest).to_numpy(zero_copy_only=False)
    word, row = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    keep = fits[word]
    return coded.dictionary, word[keep].astype(np.int64), row[keep].astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: pa.Array, word: np.ndarray, row: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash, row, first spots per length) of every run of one to ``longest`` words; the words of a run are hashed together."""
    single = _mixed(pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)) if len(words) else np.zeros(0, np.uint64)
    each, spot = single[word], np.arange(len(word))
    run, found, rows, spots = each, [each], [row], [spot]
    for n in range(2, longest + 1):
        spot = spot[spot + n - 1 < len(row)]
        same = row[spot] == row[spot + n - 1]
        run = _mixed(run[: len(same)][same] * np.uint64(0x9E3779B97F4A7C15) + each[spot[same] + n - 1])
        spot = spot[same]
        found.append(run), rows.append(row[spot]), spots.append(spot)
    return np.concatenate(found).view(np.int64), np.concatenate(rows), spots


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, number of each), in the order in which they come up."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def _cut(key: np.ndarray) -> np.ndarray:
    """Where a sorted array takes a new value."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def in_rows(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of the distinct pairs, sorted."""
    key = np.sort(row * codes + code)
    at = _cut(key)
    return key[at] // max(codes, 1), key[at] % max(codes, 1), np.diff(np.append(at, len(key)))


def _batches(batches: Iterator[pa.RecordBatch], each: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(_WORDS)):
            there = {c: batch.column(c).slice(first, len(texts)).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != _WORDS}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in each(texts, there)], names)


def _mapped(df: DataFrame, text_col: str, columns: list[Column], each: Callable, shape: dict[str, str]) -> DataFrame:
    """Rows that ``each`` makes of a slice of texts and the other columns, as arrays."""
    names = list(shape)
    plain = df.select(*columns, plain_words(F.col(text_col)).alias(_WORDS))
    return plain.mapInArrow(lambda batches: _batches(batches, each, names), ", ".join(f"`{n}` {t}" for n, t in shape.items()))


# --- counts --------------------------------------------------------------------------------


def hashed_counts(df: DataFrame, text_col: str, longest: int, shortest: int, copies: Column) -> DataFrame:
    """(term, example, term_count, document_count), one row per slice and term, added up over its rows.

    A row stands for ``copies`` documents; ``example`` is the hash of one of its texts. Terms are 64-bit hashes: a
    corpus of a billion distinct terms has a clash with a probability of 3 percent.
    """

    def each(texts, there):
        words, word, row = words_of(texts, shortest)
        hashes, rows, _ = _runs(words, word, row, longest)
        terms, code = _numbered(hashes)
        at, code, times = in_rows(rows, code, len(terms))
        held, used, documents = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        held[code[::-1]] = at[::-1]
        np.add.at(used, code, times * there["copies"][at])
        np.add.at(documents, code, there["copies"][at])
        return terms, there["example"][held], used, documents

    columns = [F.xxhash64(text_col).alias("example"), copies.cast("long").alias("copies")]
    return _mapped(df, text_col, columns, each, {"term": "long", "example": "long", "term_count": "long", "document_count": "long"})


def run_postings(df: DataFrame, run: Column, place: Column, copies: Column, text_col: str, longest: int, shortest: int) -> DataFrame:
    """(run, term, tf, rows, documents), one row per slice: the rows of a run that hold a term equally often, a bit for each place."""

    def each(texts, there):
        words, word, row = words_of(texts, shortest)
        hashes, rows, _ = _runs(words, word, row, longest)
        terms, code = _numbered(hashes)
        at, code, times = in_rows(rows, code, len(terms))
        runs, run_code = _numbered(there["run"])
        most = int(times.max(initial=0)) + 1
        key = (run_code[at] * max(len(terms), 1) + code) * most + times
        order = np.argsort(key)
        cut = order[_cut(key[order])]
        starts = _cut(key[order])
        if not len(starts):
            return [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int64)]
        bits = np.int64(1) << there["place"][at].astype(np.int64)
        rows_held = np.bitwise_or.reduceat(bits[order], starts)
        return runs[run_code[at[cut]]], terms[code[cut]], times[cut].astype(np.int32), rows_held, np.add.reduceat(there["copies"][at][order], starts)

    columns = [run.cast("long").alias("run"), place.cast("long").alias("place"), copies.cast("long").alias("copies")]
    return _mapped(df, text_col, columns, each, {"run": "long", "term": "long", "tf": "int", "rows": "long", "documents": "long"})


def _named(words: pa.Array, word: np.ndarray, first: list[np.ndarray], spots: np.ndarray) -> pa.Array:
    """The runs with the given places among all runs, their words joined by a blank."""
    size = np.array([len(s) for s in first])
    length = np.searchsorted(np.cumsum(size), spots, side="right")
    out = np.empty(len(spots), dtype=object)
    before = np.cumsum(size) - size
    for n in range(len(first)):
        here = np.flatnonzero(length == n)
        start = first[n][spots[here] - before[n]]
        parts = [pc.take(words, pa.array(word[start + i])) for i in range(n + 1)]
        out[here] = (pc.binary_join_element_wise(*parts, " ") if n else parts[0]).to_numpy(zero_copy_only=False)
    return pa.array(out, pa.string())


def named_terms(df: DataFrame, text_col: str, longest: int, shortest: int, copies: Column | None = None) -> DataFrame:
    """(hash, term, documents), one row per slice and term: its words put together, and the documents that hold it."""

    def each(texts, there):
        words, word, row = words_of(texts, shortest)
        hashes, rows, first = _runs(words, word, row, longest)
        terms, code = _numbered(hashes)
        spot = np.zeros(len(terms), np.int64)
        spot[code[::-1]] = np.arange(len(code))[::-1]
        at, code, _ = in_rows(rows, code, len(terms))
        documents = np.zeros(len(terms), np.int64)
        np.add.at(documents, code, there["copies"][at])
        return terms, _named(words, word, first, spot), documents

    copies = F.lit(1) if copies is None else copies
    return _mapped(df, text_col, [copies.cast("long").alias("copies")], each, {"hash": "long", "term": "string", "documents": "long"})


# --- terms of a vocabulary --------------------------------------------------------------------


class TermIndex:
    """Places of the terms of a vocabulary, found word by word, for all runs of a slice at once."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.words = sorted({w for words in split for w in words})
        number = {w: i for i, w in enumerate(self.words)}
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for place, words in enumerate(split):
            node = 0
            for w in words:
                node = nodes.setdefault((node, number[w]), len(nodes) + 1)
            ends[node] = place
        keys = np.array([a * len(self.words) + b for a, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([*nodes.values()], dtype=np.int64)[order]
        self.place = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.place[[*ends]] = [*ends.values()]
        self.longest = max(map(len, split), default=0)

    def found(self, texts: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the term) of every occurrence of a term."""
        words, word, row = words_of(texts, shortest)
        known = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word, rows, places = known[word], [], []
        spot, node = np.flatnonzero(word >= 0), np.int64(0)
        for n in range(self.longest):
            if n:
                inside = spot + n < len(word)
                spot, node = spot[inside], node[inside]
                inside = (row[spot] == row[spot + n]) & (word[spot + n] >= 0)
                spot, node = spot[inside], node[inside]
            key = node * len(self.words) + word[spot + n]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            spot, node = spot[hit], self.child[at[hit]]
            place = self.place[node]
            rows.append(row[spot[place >= 0]]), places.append(place[place >= 0])
        return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64),) * 2
