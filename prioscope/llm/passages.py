"""Removal of repeated passages by suffix arrays (operator 1).

Every string of ``LENGTH`` bytes (a window) has an anchor: the leftmost of its ``ANCHOR``-byte
substrings with the least hash. Equal windows have equal anchors at the same place, so windows
are compared only with those of the same anchor, wherever in the corpus they lie. The windows
that share one anchor in a text form a segment of at most 2 * LENGTH bytes around it.

1. Anchors are counted; segments of anchors that occur once hold no repeated window.
2. Equal segments are reduced to their first place before they meet; all later ones are repeated
   whole. So exact copies, however many, cost one row each.
3. Different segments of one anchor are repeated in part. Those are put together into one text
   per anchor, the anchor being a single symbol, and sorted by suffix arrays (linear grouping, see
   ``suffixes``). Windows that begin with the same symbols stand side by side there; all but the
   earliest are repeated.
4. Removed runs are gathered per document and cut out of its bytes.

An anchor with more than ``LARGE`` different segments is cut into single windows, which Spark groups
by 128-bit hash with partial aggregation, so no task gets a large group.

Defined results: a null text counts as empty. A null id counts as later than all ids below 2^63 - 2^40, rows with
the same id follow the order of a hash of their texts, and of rows alike in id and text one counts
as first. Texts under ``LENGTH`` bytes are left alone. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from prioscope.llm.common import kept, text_of
from prioscope.llm.filters import bit_filter, passes, slot_of
from prioscope.llm.shingles import chunks, mixed
from prioscope.llm.suffixes import suffix_arrays

LENGTH, ANCHOR = 100, 50
SPAN = LENGTH - ANCHOR + 1  # anchors to choose from in a window; also a window's length in symbols
LARGE = 48
PIECE = 1 << 18
FILTER_BITS = 26
SYMBOLS_AT_ONCE = 300_000
_LAST_ID = 2**63 - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    inverse = pow(base, -1, 2**64)
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (base, inverse))


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Hashes:
    """Hashes of any substring of a buffer, from sums of its bytes times powers of a base."""

    def __init__(self, buffer: np.ndarray, base: int) -> None:
        if base not in _CACHE or len(_CACHE[base][0]) <= len(buffer) + 1:
            _CACHE[base] = _powers(base, 2 * len(buffer) + 2)
        up, self.down = _CACHE[base]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buffer] * up[: len(buffer)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def of_all(self, width: int) -> np.ndarray:
        """32-bit hashes of all substrings of one width, above zero."""
        n = len(self.sums) - width
        return (((self.sums[width:] - self.sums[:n]) * self.down[:n] * np.uint64(_BASES[1])) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def segments(texts: list[bytes], whole: bool = True) -> dict[str, np.ndarray]:
    """Segments of many texts: the anchor's hash; if ``whole``, also text number, start, anchor place, number of windows and own hash.

    Texts over ``PIECE`` bytes are cut into pieces that share LENGTH - 1 bytes; that only cuts segments.
    """
    pieces = [(nr, at, t[at : at + PIECE + LENGTH - 1]) for nr, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), PIECE) if len(t) >= LENGTH]
    names = ("anchor", "text", "start", "anchor_at", "windows", "segment")[: 6 if whole else 1]
    parts = [_segments(group, whole) for group in _batches(pieces)]
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names}


def _batches(pieces: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _segments(pieces: list[tuple[int, int, bytes]], whole: bool) -> dict[str, np.ndarray]:
    """Anchors are the leftmost least of every SPAN hashes; a segment runs from the first window with its anchor to the next one's first."""
    buffer = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    hashes = _Hashes(buffer, _BASES[0])
    h = hashes.of_all(ANCHOR)
    least = _slide(h, SPAN, np.minimum)
    for at in begin[1:].tolist():
        least[at - LENGTH + 1 : at] = 0  # no window: it would reach into the next text
    edge = np.zeros(SPAN - 1, np.uint32)
    anchors = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), SPAN, np.maximum) == h)
    piece = np.searchsorted(begin, anchors, side="right") - 1
    starts = np.empty(len(anchors), np.int64)
    starts[1:] = np.where(h[anchors[1:]] < h[anchors[:-1]], anchors[1:] - SPAN + 1, anchors[:-1] + 1)
    new = np.append(True, piece[1:] != piece[:-1])
    starts[new] = begin[piece[new]]
    ends = np.append(np.where(new, np.iinfo(np.int64).max, starts)[1:], np.iinfo(np.int64).max)
    ends[np.append(new[1:], True)] = (begin + sizes - LENGTH + 1)[piece[np.append(new[1:], True)]]
    # An anchor that is never the leftmost least of a window has an empty segment.
    key = -piece * (len(buffer) + 1)
    ends = np.minimum.accumulate((ends - key)[::-1])[::-1] + key if len(ends) else ends
    real = np.flatnonzero(ends > starts)
    at, first, count, number = anchors[real], starts[real], (ends - starts)[real], piece[real]
    found = {"anchor": hashes.of(at, at + ANCHOR).view(np.int64)}
    if whole:
        offset = np.array([p[1] for p in pieces])[number] - begin[number]
        place = (at - first).astype(np.uint64)
        segment = _Hashes(buffer, _BASES[1]).of(first, first + count + LENGTH - 1)
        found |= {
            "text": np.array([p[0] for p in pieces])[number],
            "start": first + offset,
            "anchor_at": at + offset,
            "windows": count,
            "segment": mixed(segment + place * np.uint64(_BASES[0]) + count.astype(np.uint64)).view(np.int64),
        }
    return found


def _order() -> tuple[Column, Column]:
    """A row's place in the order of documents: id and a hash of the text. Null ids are put at the end of all numbers, told apart by 40 more bits."""
    unnamed = F.lit(_LAST_ID) - F.xxhash64(F.lit(40), text_of()).bitwiseAND(F.lit((1 << 40) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc"), F.xxhash64(text_of()).bitwiseAND(F.lit(0x7FFFFFFF)).alias("tie")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_order(), text_of().alias("text"))


def _read(frames: Iterator[pd.DataFrame], whole: bool = True) -> Iterator[tuple[pd.DataFrame, list[bytes], dict[str, np.ndarray]]]:
    for frame in frames:
        for part in chunks(frame, "text"):
            texts = [t.encode("utf-8", "surrogatepass") for t in part["text"]]
            yield part, texts, segments(texts, whole)


def _anchor_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, _, found in _read(frames, False):
        slots, n = np.unique(found["anchor"].astype(np.int64) & 0x7FFFFFFF, return_counts=True)
        yield pd.DataFrame({"slot": slots.astype(np.int32), "n": np.minimum(n, 2).astype(np.int8)})


def _occurrences(docs: DataFrame) -> DataFrame:
    """Segments whose anchor may occur more than once: (anchor, segment, doc, place, windows); place is tie and start."""
    counted = _texts(docs).select("text").mapInPandas(_anchor_counts, "slot int, n byte")
    repeated = counted.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("slot").cast("long").alias("slot"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "slot", FILTER_BITS))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, s in _read(frames):
            at = np.flatnonzero(passes(shared.value, s["anchor"]))
            text = s["text"][at]
            yield pd.DataFrame(
                {
                    "anchor": s["anchor"][at], "segment": s["segment"][at], "doc": part["doc"].to_numpy()[text],
                    "place": (part["tie"].to_numpy(np.int64)[text] << 32) + s["start"][at], "windows": s["windows"][at].astype(np.int16),
                }
            )

    return kept(_texts(docs).mapInPandas(find, "anchor long, segment long, doc long, place long, windows short"), "occurrences")


def _segment_texts(docs: DataFrame, partly: DataFrame) -> DataFrame:
    """``partly`` with the bytes of each segment and the anchor's place in it."""
    mark = F.col("segment").bitwiseXOR(F.col("place")).bitwiseXOR(F.col("doc"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(partly.select(mark.alias("mark")), "mark", FILTER_BITS))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, texts, s in _read(frames):
            doc = part["doc"].to_numpy()[s["text"]]
            place = (part["tie"].to_numpy(np.int64)[s["text"]] << 32) + s["start"]
            at = np.flatnonzero(passes(shared.value, s["segment"] ^ place ^ doc))
            rows = zip(s["text"][at].tolist(), s["start"][at].tolist(), s["windows"][at].tolist())
            yield pd.DataFrame(
                {
                    "anchor": s["anchor"][at], "segment": s["segment"][at], "doc": doc[at], "place": place[at],
                    "before": (s["anchor_at"] - s["start"])[at].astype(np.int16), "bytes": [texts[t][a : a + n + LENGTH - 1] for t, a, n in rows],
                }
            )

    found = _texts(docs).mapInPandas(cut, "anchor long, segment long, doc long, place long, before short, bytes binary")
    return found.join(partly, ["anchor", "segment", "doc", "place"]).distinct()


_SPANS = "doc long, place long, bytes int"


def _sorted_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows of the segments of each anchor; a row is one anchor with a list of segments."""
    for frame in frames:
        lists = list(frame["members"])
        total = np.cumsum([sum(len(m["bytes"]) for m in members) for members in lists])
        batch = total // SYMBOLS_AT_ONCE
        for b in np.unique(batch):
            yield _spans_of([lists[i] for i in np.flatnonzero(batch == b)])


def _spans_of(groups: list[list[dict]]) -> pd.DataFrame:
    """One text per group: its segments, each with the anchor as one symbol and a stop, and a least symbol at the end."""
    anchor, stop, least = 300, 1, 0
    whole, first, last, members = [], [], [], []
    symbol_at = 0
    starts, counts = [], []
    for group in groups:
        whole.append(np.array([-9]))
        symbol_at += 1
        first.append(symbol_at)
        for m in group:
            b, cut = np.frombuffer(m["bytes"], np.uint8).astype(np.int64) + 2, m["before"]
            symbols = np.concatenate([b[:cut], [anchor], b[cut + ANCHOR :], [stop]])
            members.append((m["doc"], m["place"]))
            starts.append(symbol_at)
            counts.append(len(m["bytes"]) - LENGTH + 1)
            whole.append(symbols)
            symbol_at += len(symbols)
        whole.append(np.array([least]))
        last.append(symbol_at)
        symbol_at += 1
    symbols = np.concatenate(whole)
    suffixes = suffix_arrays(symbols, np.array(first), np.array(last))
    starts, counts = np.array(starts), np.array(counts)
    member = np.full(len(symbols), -1)
    index = np.repeat(np.arange(len(starts)), counts)
    inner = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
    member[starts[index] + inner] = index
    group_of = np.zeros(len(symbols), np.int64)
    group_of[first] = 1
    group_of = np.cumsum(group_of)
    suffixes = suffixes[suffixes >= 0]
    windows = suffixes[member[suffixes] >= 0]
    same = group_of[windows[1:]] == group_of[windows[:-1]]
    for k in range(SPAN):
        at = np.flatnonzero(same)
        same[at] = symbols[windows[1:][at] + k] == symbols[windows[:-1][at] + k]
    kind = np.concatenate([[0], np.cumsum(~same)])
    own = member[windows]
    doc = np.array([m[0] for m in members])[own]
    place = np.array([m[1] for m in members])[own] + windows - starts[own]
    order = np.lexsort((place, doc, kind))
    repeated = order[np.flatnonzero(np.append(False, kind[order][1:] == kind[order][:-1]))] if len(order) else order
    return _runs(doc[repeated], place[repeated])


def _runs(doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Neighbouring windows of a document joined into runs."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(doc)) - 1 if len(doc) else new
    return pd.DataFrame({"doc": doc[new], "place": place[new], "bytes": (place[ends] - place[new] + LENGTH).astype(np.int32)})


def _single_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(one, two, doc, place): 128-bit hash and place of every window of a segment."""
    for frame in frames:
        texts = list(frame["bytes"])
        if texts:
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts])
            counts = sizes - LENGTH + 1
            own = np.repeat(np.arange(len(texts)), counts)
            inner = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = (np.cumsum(sizes) - sizes)[own] + inner
            one, two = (_Hashes(buffer, b).of(start, start + LENGTH).view(np.int64) for b in _BASES)
            yield pd.DataFrame({"one": one, "two": two, "doc": frame["doc"].to_numpy()[own], "place": frame["place"].to_numpy()[own] + inner})


def _later(rows: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Rows that are not the first of their key, by (doc, place)."""
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = rows.join(firsts, keys)
    return both.where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place"))).select("doc", "place", *extra)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, place, bytes) of stretches covered by windows that start earlier as well; place is tie and start."""
    rows = _occurrences(docs)
    firsts = kept(
        rows.groupBy("anchor", "segment").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts"
    )
    again = rows.join(firsts.where("n > 1"), ["anchor", "segment"]).where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    whole = again.select("doc", "place", (F.col("windows") + (LENGTH - 1)).cast("int").alias("bytes"))
    kinds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    partly = kept(firsts.join(kinds, "anchor").select("anchor", "segment", F.col("first.doc").alias("doc"), F.col("first.place").alias("place"), "kinds"), "partly")
    texts = kept(_segment_texts(docs, partly), "segments")
    groups = texts.where(F.col("kinds") <= LARGE).groupBy("anchor").agg(F.collect_list(F.struct("doc", "place", "before", "bytes")).alias("members"))
    sorted_ = groups.select("members").mapInPandas(_sorted_groups, _SPANS)
    single = kept(
        texts.where(F.col("kinds") > LARGE).select("doc", "place", "bytes").mapInPandas(_single_windows, "one long, two long, doc long, place long"), "windows"
    )
    rest = _later(single, ["one", "two"], []).withColumn("bytes", F.lit(LENGTH))
    return kept(whole.unionByName(sorted_).unionByName(rest), "spans")


def _merged(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs; a span is its start times 2 ** 32 plus its length."""
    packed = np.sort(packed)
    start, end = packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF)
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])[: len(start)]
    return start[new], reach[np.append(new[1:], True)[: len(start)]]


_CUT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_bytes", T.BinaryType())]
)


def _cutter(with_bytes: bool):
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, spans):
            data = text.encode("utf-8", "surrogatepass")
            starts, ends = _merged(np.asarray(found, np.int64))
            rest = b"".join([data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)])])
            rows.append((int((ends - starts).sum()), len(starts), sha256(rest).hexdigest(), rest if with_bytes else None))
        return pd.DataFrame(rows, columns=_CUT.names)

    return F.pandas_udf(cut, _CUT)


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, and the bytes that are left if asked for.

    Only texts that have a span are shuffled to meet it.
    """
    spans = repeated_spans(docs).select(
        "doc", F.shiftright("place", 32).alias("tie"), F.shiftleft(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col("bytes").cast("long")).alias("span")
    ).groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))
    spans = kept(spans, "spans-by-document")
    mark = F.xxhash64("doc", "tie")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(mark.alias("mark")), "mark"))

    @F.pandas_udf(T.BooleanType())
    def maybe(slot: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, slot.to_numpy(np.int64)))

    rows = docs.select(*_order(), text_of().alias("text"), F.col("doc_id").isNotNull().alias("named")).withColumn("maybe", maybe(slot_of(mark)))
    nothing = F.array().cast("array<bigint>")
    cut = rows.where("maybe").join(spans, ["doc", "tie"], "left").withColumn("cut", _cutter(with_bytes)("text", F.coalesce("spans", nothing)))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    touched = cut.select("doc", "tie", "named", size, "cut.n_removed", "cut.n_spans", "cut.kept_sha256", "cut.kept_bytes")
    clean = rows.where("NOT maybe").select(
        "doc", "tie", "named", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        (F.col("text").cast("binary") if with_bytes else F.lit(None).cast("binary")).alias("kept_bytes"),
    )
    verdicts = touched.unionByName(clean)
    return _spread_copies(verdicts, with_bytes)


def _spread_copies(verdicts: DataFrame, with_bytes: bool) -> DataFrame:
    """Of rows alike in id and text the first keeps its verdict; the others are removed whole, if they hold a window."""
    names = ["named", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    one = verdicts.groupBy("doc", "tie").agg(*[F.first(n).alias(n) for n in names], F.count(F.lit(1)).alias("rows"))
    each = one.withColumn("nr", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    gone = (F.col("nr") > 1) & (F.col("n_bytes") >= LENGTH)
    doc_id = F.when(F.col("named"), F.col("doc")).alias("doc_id")
    return each.select(
        doc_id, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept_bytes")).alias("kept_bytes")] if with_bytes else []),
    )
