"""Near duplicates by ProbMinHash, banding and exact verification (operator 8).

Texts are sets of five-word shingles of lower-cased words. Each shingle is a Poisson process
whose rate is its weight; every arrival falls into one of the registers, which keep the
earliest, and a text stops as soon as no later arrival can win. The share of equal registers
estimates the probability Jaccard of two weighted texts. A link is defined on plain sets, so all
weights are equal here and the probability Jaccard is that of the sets. Registers are cut into
bands; texts that share a band are candidates, and a link needs an exact Jaccard of their
shingle sets of at least the limit. At a similarity of 0.8 a pair is missed by all bands with a
probability of 3 in a million. Registers only order the candidates of a bucket; none is left out for them.

Texts with the same words are one node from the start. First every node is
compared with the centre of one of its buckets and components are found, twice with other centres;
then only pairs of a bucket that lie in different components are tried, so a group of n copies
costs about n comparisons. The nodes of buckets that are still very large and mixed meet by their rarest
shingles instead, which loses no link; what is large and mixed even then is compared block by block.
No candidate is dropped for the size of a bucket.

Defined results: null texts count as empty; a text without words is a class of its own; a text of
one to four words is one shingle. A null id counts as the largest. Rows alike in id and text are
members of one class with one verdict, and ``keep_rows`` returns one of them. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from prioscope.llm.common import by_group, kept, row_key, text_of
from prioscope.llm.components import components
from prioscope.llm.filters import bit_filter, passes
from prioscope.llm.shingles import chunks, distinct_counts, mixed, shingle_hashes, words_of

WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
STAR_ROUNDS = 2
LARGE_BUCKET = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


def prob_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that comes first in each register, one line per text; texts without elements get zeros."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    at = np.zeros(len(h))
    arrival = 0
    while len(h):
        arrival += 1
        draw = mixed(h + np.uint64(arrival * int(_STEP) % 2**64))
        at = at - np.log((mixed(draw ^ _SALT) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        slot = text * registers + (draw % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, at)
        won = earliest[slot] == at
        winner[slot[won]] = h[won]
        latest = earliest.reshape(texts, registers).max(axis=1)
        open_ = at < latest[text]
        text, h, weight, at = text[open_], h[open_], weight[open_], at[open_]
    return winner.reshape(texts, registers)


def _content(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in chunks(frame, "text"):
            lists = [words_of(t) for t in part["text"]]
            text, h, _ = distinct_counts(*shingle_hashes(lists, WIDTH))
            winner = prob_minhash(text, h, np.ones(len(h)), len(lists))
            band = np.zeros((len(lists), BANDS), np.uint64)
            for j in range(BAND_ROWS):
                band = mixed(band * np.uint64(31) + winner[:, j::BAND_ROWS] + _STEP)
            band = mixed(band + np.arange(BANDS, dtype=np.uint64))
            yield pd.DataFrame(
                {
                    "key": part["key"].values,
                    "doc_id": part["doc_id"].values,
                    "content": [_content(w) for w in lists],
                    "n": np.bincount(text, minlength=len(lists)).astype(np.int32),
                    "bands": list(band.view(np.int64)),
                    "registers": [bytes(r) for r in (winner & np.uint64(255)).astype(np.uint8)],
                }
            )


def _shingle_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct shingles of a text as sorted numbers of five bytes."""
    for frame in frames:
        for part in chunks(frame, "text"):
            lists = [words_of(t) for t in part["text"]]
            text, h, _ = distinct_counts(*shingle_hashes(lists, WIDTH))
            five = np.ascontiguousarray((h >> np.uint64(24)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
            ends = np.searchsorted(text, np.arange(len(lists) + 1))
            yield pd.DataFrame({"key": part["key"].values, "shingles": [five[a:b].tobytes() for a, b in zip(ends, ends[1:])]})


def _numbers(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _jaccard_of(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets."""
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return both / max(1, len(x) + len(y) - both)


@F.pandas_udf(T.DoubleType())
def _jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_jaccard_of(_numbers(a), _numbers(b)) for a, b in zip(left, right)], dtype="float64")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted nodes; ``wanted`` has the id and the row key of one text of each."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("key").alias("mark")), "mark"))

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _shingle_sets(iter([frame[passes(bits.value, frame["mark"].to_numpy(np.int64))]]))

    texts = docs.select(text_of().alias("text"), row_key().alias("key")).withColumn("mark", F.xxhash64("key"))
    sets = texts.mapInPandas(chosen, "key binary, shingles binary")
    return kept(sets.join(wanted, "key").select("id", "shingles").dropDuplicates(["id"]), "shingles")


def _linked(pairs: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_jaccard("sa", "sb") >= limit).select("a", "b")


def _alike_in_size(a: Column, b: Column, limit: float) -> Column:
    return (a >= b * limit) & (b >= a * limit)


def near_links(docs: DataFrame, limit: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, doc_id, content, n), nodes (id, content) with words, and (node, label) of nodes that have links."""
    rows = kept(
        docs.select(row_key().alias("key"), F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
        .mapInPandas(_sketches, "key binary, doc_id string, content binary, n int, bands array<long>, registers binary")
        .withColumn("doc_id", F.col("doc_id").cast("long")),
        "sketches",
    )
    nodes = kept(
        rows.where("n > 0")
        .groupBy("content")
        .agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
        .withColumn("id", F.monotonically_increasing_id()),
        "nodes",
    )
    shared = _shared(nodes.select("id", F.explode("bands").alias("bucket")), "buckets")
    sets = _sets_of(docs, nodes.select("id", "key").join(shared.select("id").distinct(), "id", "left_semi"))
    links, labels, large = _searched(shared, None, None, nodes, sets, limit)
    if not large.isEmpty():
        rare = _shared(_rare_shingles(large.select("id").distinct(), sets, limit), "rare")
        links, labels, large = _searched(rare, links, labels, nodes, sets, limit)
        if not large.isEmpty():
            links = links.union(_links_in_buckets(_block_pairs(_mixed_buckets(large, labels)), nodes, sets, limit))
            labels = components(links)
    return rows.select("key", "doc_id", "content", "n"), nodes.select("id", "content"), labels


def _shared(level: DataFrame, name: str) -> DataFrame:
    """Rows (bucket, id, size) of buckets with two nodes or more."""
    sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return kept(level.join(sizes, "bucket"), name)


def _searched(
    shared: DataFrame, links: DataFrame | None, labels: DataFrame | None, nodes: DataFrame, sets: DataFrame, limit: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and labels after stars in all buckets and comparisons in small ones, and the large buckets still mixed then."""
    mixed_ = shared if labels is None else _mixed_buckets(shared, labels)
    for turn in range(STAR_ROUNDS):
        links = _grown(links, _linked(_stars(mixed_, turn), sets, limit))
        labels = components(links)
        mixed_ = _mixed_buckets(shared, labels)
    links = links.union(_links_in_buckets(mixed_.where(F.col("size") <= LARGE_BUCKET), nodes, sets, limit))
    return links, components(links), mixed_.where(F.col("size") > LARGE_BUCKET)


def _rare_shingles(ids: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """(id, bucket): the shingles of each node that are rarest among these nodes, as many as a link must meet.

    Two sets alike enough share all but n - limit * n shingles of either, so in any common order one of the
    first n - limit * n + 1 is shared. No link is lost, and what many texts share makes no bucket
    where texts also have rarer shingles of their own.
    """

    def shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, packed in zip(frame["id"], frame["shingles"]):
                found = _numbers(packed)
                needed = len(found) - int(np.ceil(limit * len(found) - 1e-9)) + 1
                yield pd.DataFrame({"id": node, "needed": needed, "bucket": found.astype(np.int64)})

    each = kept(sets.join(ids, "id", "left_semi").mapInPandas(shingles, "id long, needed int, bucket long"), "shingles")
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A shingle of one node alone meets nothing, but comes first in the order, so it takes a place.
    common = each.join(counts, "bucket")
    ordered = common.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "bucket"))).alias("order"))
    sizes = each.groupBy("id").agg(F.first("needed").alias("needed"), F.count(F.lit(1)).alias("size"))
    left = F.col("needed") - (F.col("size") - F.size("order"))
    chosen = ordered.join(sizes, "id").where(left > 0).select("id", F.explode(F.slice("order", F.lit(1), left.cast("int"))).alias("x"))
    return chosen.select("id", F.col("x.bucket").alias("bucket"))


def _block_pairs(large: DataFrame) -> DataFrame:
    """Rows (bucket, id, label) in which every two blocks of a large bucket meet as one bucket of at most about LARGE_BUCKET nodes."""
    blocks = F.ceil(F.col("size") * 4 / LARGE_BUCKET).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = large.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}).where("own <> other")
    return pairs.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "id", "label")


def _stars(buckets: DataFrame, turn: int) -> DataFrame:
    """One pair per node: with the centre of one of its buckets, the least node once some bits are flipped, other bits each turn."""
    flip = F.lit((turn * 0x5DEECE66D) & 0x7FFFFFFF)
    centres = buckets.groupBy("bucket").agg(F.min(F.col("id").bitwiseXOR(flip)).alias("centre"))
    apart = buckets.join(centres, "bucket").where(F.col("id").bitwiseXOR(flip) != F.col("centre"))
    return apart.groupBy("id").agg(F.min("centre").bitwiseXOR(flip).alias("b")).withColumnRenamed("id", "a")


def _grown(links: DataFrame | None, more: DataFrame) -> DataFrame:
    more = kept(more, "links")
    return more if links is None else links.union(more)


def _labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    known = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(known, node, "left").withColumn(label, F.coalesce(label, node))


def _mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, size, id, label) of buckets that hold more than one component."""
    labelled = kept(_labelled(shared.select("bucket", "size", "id"), labels, "id", "label"), "labelled")
    both = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return labelled.join(both.select("bucket"), "bucket", "left_semi")


def _links_in_buckets(rows: DataFrame, nodes: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Links between the components of a bucket, as few as connect what is alike.

    A bucket has at most about LARGE_BUCKET nodes, so one task can hold their registers and shingles. It
    compares every pair whose sizes allow a link and whose ends are not yet in one component,
    and returns the links it finds, not the pairs it tried.
    """
    full = rows.select("bucket", "id", "label").join(nodes.select("id", "n", "registers"), "id").join(sets, "id")
    lists = full.groupBy("bucket").agg(F.collect_list(F.struct("id", "label", "n", "registers", "shingles")).alias("nodes"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for members in frame["nodes"]:
                found = _bucket_links(list(members), limit)
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return kept(lists.select("nodes").mapInPandas(compare, "a long, b long"), "links", batch=4)


def _bucket_links(members: list, limit: float) -> list[tuple[int, int]]:
    """Exact links of one bucket that join components; the surest candidates first."""
    members.sort(key=lambda m: m["id"])
    sizes = np.array([m["n"] for m in members])
    component = np.unique(np.array([m["label"] for m in members]), return_inverse=True)[1]
    registers = np.frombuffer(b"".join([m["registers"] for m in members]), np.uint8).reshape(len(members), REGISTERS)
    shingles = [_numbers(m["shingles"]) for m in members]
    found = []
    for i in range(len(members) - 1):
        others = np.flatnonzero((component[i + 1 :] != component[i]) & _alike_in_size(sizes[i + 1 :], sizes[i], limit)) + i + 1
        agreement = (registers[others] == registers[i]).mean(axis=1)
        for j in others[np.argsort(-agreement, kind="stable")].tolist():
            if component[i] != component[j] and _jaccard_of(shingles[i], shingles[j]) >= limit:
                found.append((members[i]["id"], members[j]["id"]))
                component[component == component[j]] = component[i]
    return found


def near_classes(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """(key, doc_id, class_id, class_size, kept) per row; the row with the least id of a class stays.

    ``key`` tells rows apart by id and text.
    """
    rows, nodes, labels = near_links(docs, limit)
    rows = rows.withColumn("content", F.when(F.col("n") > 0, F.col("content")).otherwise(F.col("key"))).drop("n")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    contents = rows.groupBy("content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = _labelled(contents.join(nodes, "content", "left"), labels, "id", "label")
    classed = kept(numbered.withColumn("label", F.coalesce(F.col("label").cast("string"), F.hex("content"))).drop("id"), "classed")
    classes = classed.groupBy("label").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    by_content = kept(classed.select("content", "label", "n").join(classes, "label").drop("label"), "classes")
    return by_group(rows, by_content, "content", "n", rows.count()).select(
        "key", "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("key") == F.col("head.key")).alias("kept")
    )
