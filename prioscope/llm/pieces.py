"""SentencePiece encoding and decoding on a relational lattice (operator 5).

A text gets a leading space and spaces become the mark ``▁``, as the public models define. It is
cut wherever two neighbouring characters stand next to each other in no piece; no piece and no
merge can span such a place, so the parts (units) are encoded on their own. Units are counted over
all documents. Those among the ``FREQUENT`` most frequent go through the lattice: their
substrings up to the longest piece are exploded and equi-joined to the piece table, edges are
grouped by unit (on the partitioning that the count left, so without another shuffle), and a
higher-order ``aggregate`` folds the edges to the best path: for a unigram model by Viterbi, for a
BPE model by replaying its merges, best score first and leftmost first, since the best sum of a BPE
model's scores is not the encoding the model defines. The result is a dictionary of bounded size
that every task gets; documents are encoded in one pass without a shuffle of texts. Units beyond the
dictionary follow the same rule where they occur.

Defined results: null and empty texts have no ids. A literal ``▁`` is a space, as in the public
library. Characters without a piece become their UTF-8 bytes if the model has byte pieces, else the
unknown id. Very long units are encoded in time n log n. Repeated rows come back as often as they
came in; ids may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prioscope.llm.common import kept, text_of

MARK = "▁"
FREQUENT = 1 << 18
LONGEST_UNIT = 64
_COUNTER_SIZE = 400_000
SHORT_UNIT = 32
#: A block is held some fifty bytes a character, a slice with its texts and ids.
BLOCK_CHARS, SLICE_ROWS = 500_000, 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_NO_PIECE = (float("-inf"), -1)


@dataclass
class PieceModel:
    """What a model file says, in plain Python. Bounded by the model's vocabulary."""

    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    unknown: int
    merges: bool
    prefix: bool
    names: list[bytes]
    longest: int = 1
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    joined: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))

    def marked(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each place between two neighbouring code points whether no piece connects them."""
        letter = self.letters[codes]
        return ~self.joined[letter[:-1], letter[1:]]

    def units(self, text: str) -> list[str]:
        """The parts of a marked text that no piece connects."""
        if not text:
            return []
        places = (np.flatnonzero(self.cuts(_code_points(text))) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]

    def spelled(self, text: str) -> list[int]:
        """Ids of a character that has no piece."""
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def round_trips(self, unit: str, ids: list[int]) -> bool:
        """Units are cut between characters, so a text is decoded to itself just when all of its units are.

        An id never gives less than the characters it stands for, so no two errors cancel out.
        """
        return b"".join([self.names[i] for i in ids]) == unit.replace(MARK, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.names[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver. Only models that leave characters as they are can be used."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("the model changes characters before encoding")
    p = SentencePieceProcessor(model_proto=proto.SerializeToString())
    scores, names, byte_ids = {}, [], {}
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            names.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            names.append(" ⁇ ".encode() if p.is_unknown(i) else b"")
        else:
            scores[piece] = (p.get_score(i), i)
            names.append(piece.replace(MARK, " ").encode())
    model = PieceModel(
        scores, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], p.unk_id(), proto.trainer_spec.model_type == 2, rules.add_dummy_prefix, names
    )
    model.longest = max(map(len, scores))
    pairs = {pair for piece in scores for pair in zip(piece, piece[1:])}
    letters = {c: i + 1 for i, c in enumerate(sorted({c for pair in pairs for c in pair}))}
    model.letters = np.zeros(0x110000, np.int16)
    for c, i in letters.items():
        model.letters[ord(c)] = i
    model.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for a, b in pairs:
        model.joined[letters[a], letters[b]] = True
    return model


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    return spark.createDataFrame([(p, i, -s) for p, (s, i) in model.scores.items()], "piece string, id int, cost double")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(text: str, model: PieceModel, most: int) -> Iterator[str]:
    """A long marked text in slices of about ``most`` characters that end where a unit ends."""
    start, width = 0, most
    while start + width < len(text):
        places = np.flatnonzero(model.cuts(_code_points(text[start : start + width + 1])))
        if len(places):
            yield text[start : start + int(places[-1]) + 1]
            start, width = start + int(places[-1]) + 1, most
        else:
            width *= 2
    yield text[start:]


def _row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: the results of a slice are on their way before the next one is read."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _blocks(texts: list[str], model: PieceModel, most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and marked texts, or slices of long ones, of about ``most`` characters together."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        marked = model.marked(text)
        for part in _slices(marked, model, most) if len(marked) > most else [marked]:
            if part:
                rows.append(row)
                parts.append(part)
                size += len(part)
            if size > most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def occurrences(texts: list[str], model: PieceModel, most: int = BLOCK_CHARS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(distinct units, unit number of each occurrence, row of each occurrence), block by block in order.

    Units are told apart by a polynomial hash; each occurrence is then compared with the first one
    letter by letter, and a block with a false match is numbered by the strings themselves.
    """
    powers = [np.zeros(0, np.uint64)] * 2
    for rows, parts in _blocks(texts, model, most):
        whole = "".join(parts)
        codes = _code_points(whole)
        ends_of_parts = np.cumsum([len(p) for p in parts])
        cut = model.cuts(codes)
        cut[ends_of_parts[:-1] - 1] = True
        begin = np.append(0, np.flatnonzero(cut) + 1)
        size = np.diff(np.append(begin, len(codes)))
        if len(powers[0]) < len(codes):
            powers = [np.cumprod(np.append(np.uint64(1), np.full(len(codes), b))) for b in (_BASE, _UNBASE)]
        total = np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * powers[0][: len(codes)]))
        number, distinct = pd.factorize(np.diff(total[np.append(begin, len(codes))]) * powers[1][begin])
        first = np.empty(len(distinct), np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        shift = (begin[first][number] - begin).astype(np.int32)
        if (size == size[first][number]).all() and (codes == codes[np.repeat(shift, size) + np.arange(len(codes), dtype=np.int32)]).all():
            units = [whole[a : a + n] for a, n in zip(begin[first].tolist(), size[first].tolist())]
        else:
            number, found = pd.factorize(np.array([whole[a : a + n] for a, n in zip(begin.tolist(), size.tolist())], dtype=object))
            units = list(found)
        yield units, number, np.repeat(rows, np.diff(np.searchsorted(begin, np.append(0, ends_of_parts))))


def unit_counts(docs: DataFrame, shared) -> DataFrame:
    """(unit, n) over all documents. Tasks add up before they send, in a table of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = shared.value, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["unit", "n"])
            found.clear()
            return batch

        for batch in _row_slices(batches):
            for units, number, _ in occurrences(batch.column(0).to_pylist(), model):
                for unit, n in zip(units, np.bincount(number, minlength=len(units)).tolist()):
                    found[unit] += n
                if len(found) > _COUNTER_SIZE:
                    yield out()
        if found:
            yield out()

    return docs.select(text_of().alias("text")).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, size, edges): all pieces in each unit with their place, the best first and from the left.

    The piece table is bounded by the model, so it is broadcast.
    """
    size = F.length("unit")
    starts = units.select("unit", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    spans = starts.select("unit", "size", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("s")))).alias("length"))
    parts = spans.withColumn("piece", F.substring(F.col("unit"), F.col("s") + 1, F.col("length")))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR (s = 0 AND length = 1)")
    edge = F.when(F.col("id").isNotNull(), F.struct("cost", "s", (F.col("s") + F.col("length")).alias("e"), "id"))
    return edges.groupBy("unit", "size").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def merged_cuts() -> Column:
    """Fold a BPE model's merges: from single characters, join the best and leftmost two neighbours that make a piece."""

    def once(value: Column, use) -> Column:
        """``use`` of a value that is worked out a single time."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def fits(cuts: Column, x: Column) -> Column:
        return once(F.array_position(cuts, x["s"]).cast("int"), lambda p: (p > 0) & F.coalesce(F.get(cuts, p + 1) == x["e"], F.lit(False)))

    def step(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter(F.col("joins"), lambda x: fits(cuts, x)), F.lit(0))
        return once(best, lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= b["s"]) | (c >= b["e"]))))

    every = F.sequence(F.lit(0), F.col("size"))
    return F.when(F.col("size") == 1, every).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("size") - 1), every, step))


def viterbi_cuts(unknown_cost: float) -> Column:
    """Fold Viterbi over the end positions: the least cost to reach each, and the cuts of that path.

    A character without a piece can be crossed at ``unknown_cost``.
    """
    empty = F.array(F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("cuts")))

    def step(best: Column, end: Column) -> Column:
        ways = F.transform(
            F.filter(F.col("edges"), lambda x: x["e"] == end),
            lambda x: F.struct((F.get(best, x["s"])["cost"] + x["cost"]).alias("cost"), F.array_append(F.get(best, x["s"])["cuts"], end).alias("cuts")),
        )
        last = F.get(best, end - 1)
        bare = F.array(F.struct((last["cost"] + unknown_cost).alias("cost"), F.array_append(last["cuts"], end).alias("cuts")))
        single = F.exists(F.col("edges"), lambda x: (x["e"] == end) & (x["s"] == end - 1))
        return F.array_append(best, F.array_min(F.when(single, ways).otherwise(F.concat(ways, bare))))

    return F.get(F.aggregate(F.sequence(F.lit(1), F.col("size")), empty, step), F.col("size"))["cuts"]


def encoded_units(units: DataFrame, spark: SparkSession, model: PieceModel) -> DataFrame:
    """(unit, pieces): each piece is (id, text); the id is null where a character has no piece."""
    edges = lattice(units, piece_table(spark, model), model.longest)
    cuts = merged_cuts() if model.merges else viterbi_cuts(_unknown_cost(model))
    folded = edges.withColumn("joins", F.filter("edges", lambda x: x["e"] - x["s"] > 1)).withColumn("cuts", cuts)

    def piece(k: Column) -> Column:
        a, b = F.get(F.col("cuts"), k), F.get(F.col("cuts"), k + 1)
        edge = F.get(F.filter(F.col("edges"), lambda x: (x["s"] == a) & (x["e"] == b)), F.lit(0))
        return F.struct(edge["id"].alias("id"), F.substring(F.col("unit"), a + 1, b - a).alias("text"))

    return folded.select("unit", F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), piece).alias("pieces"))


def _unknown_cost(model: PieceModel) -> float:
    return max(-s for s, _ in model.scores.values()) + 10.0


def merge_ids(unit: str, model: PieceModel) -> list[int]:
    """Ids of one unit of a BPE model: a short one by looking at all neighbours each time, a long one in time n log n."""
    if len(unit) > SHORT_UNIT:
        return _merge_long(unit, model)
    known, parts = model.scores.get, list(unit)
    costs = [known(a + b, _NO_PIECE)[0] for a, b in zip(parts, parts[1:])]
    while costs:
        best = max(costs)
        if best == _NO_PIECE[0]:
            break
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = known(parts[i] + parts[i + 1], _NO_PIECE)[0]
        if i:
            costs[i - 1] = known(parts[i - 1] + parts[i], _NO_PIECE)[0]
    return [x for p in parts for x in ([model.scores[p][1]] if p in model.scores else model.spelled(p))]


def _merge_long(unit: str, model: PieceModel) -> list[int]:
    parts: list[str | None] = list(unit)
    left, right = list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if right[i] < len(parts):
            both = parts[i] + parts[right[i]]
            if both in model.scores:
                heapq.heappush(heap, (-model.scores[both][0], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], right[i] = both, None, right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [x for p in parts if p is not None for x in ([model.scores[p][1]] if p in model.scores else model.spelled(p))]


def viterbi_ids(unit: str, model: PieceModel) -> list[int]:
    """Ids of one unit of a unigram model."""
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        ways = []
        for start in range(max(0, end - model.longest), end):
            known = model.scores.get(unit[start:end])
            if known:
                ways.append((best[start][0] - known[0], start, [known[1]]))
            elif start == end - 1:
                ways.append((best[start][0] + _unknown_cost(model), start, model.spelled(unit[start:end])))
        best.append(min(ways))
    ids, end = [], len(unit)
    while end:
        ids.append(best[end][2])
        end = best[end][1]
    return [x for part in reversed(ids) for x in part]


def frequent_units(counts: DataFrame, most: int) -> DataFrame:
    """Units above a count that at most ``most`` of them reach; no sort, and only a thousand numbers reach the driver."""
    stored = kept(counts, "unit-counts")
    step = F.floor(F.log2("n") * 16)
    rows = stored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("least")).collect()
    least, total = None, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["units"]
        if total > most:
            break
        least = r["least"]
    return stored.where(F.lit(False) if least is None else F.col("n") >= least).select("unit")


@dataclass
class PackedUnits:
    """Units and their ids (packed as 32-bit numbers) as two Arrow columns; a task unpickles them as a dictionary.

    The driver only hands them on, so it holds a few bytes a unit and no Python object for each.
    """

    units: pa.ChunkedArray
    ids: pa.ChunkedArray

    def __len__(self) -> int:
        return len(self.units)

    def __reduce__(self):
        return _unpacked, (self.units, self.ids)


def _unpacked(units: pa.ChunkedArray, ids: pa.ChunkedArray) -> dict[str, bytes]:
    return dict(zip(units.to_pylist(), ids.to_pylist()))


def dictionary(docs: DataFrame, model: PieceModel, shared, most: int = FREQUENT) -> PackedUnits:
    """The most frequent units with their ids, from the lattice."""
    frequent = frequent_units(unit_counts(docs, shared).where(F.length("unit") <= LONGEST_UNIT), most)
    spread = frequent.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = [
                [x for i, t in zip(ids, texts) for x in ([int(i)] if i is not None and i == i else shared.value.spelled(t))]
                for ids, texts in zip(frame["id"], frame["text"])
            ]
            yield pd.DataFrame({"unit": frame["unit"], "ids": [np.array(x, np.int32).tobytes() for x in flat]})

    encoded = encoded_units(spread, docs.sparkSession, model).select("unit", "pieces.id", "pieces.text")
    rows = encoded.mapInPandas(pack, "unit string, ids binary").toArrow()
    return PackedUnits(rows["unit"], rows["ids"])


def encode(docs: DataFrame, model: PieceModel, most: int = FREQUENT) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) per row: whether the decoded ids are the text again."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    known = context.broadcast(dictionary(docs, model, shared, most))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, known.value
        rule = merge_ids if model.merges else viterbi_ids
        rest: dict[str, bytes] = {}
        whole: dict[str, bool] = {}

        def packed_ids(unit: str) -> bytes:
            packed = table.get(unit) or rest.get(unit)
            if packed is None:
                if len(rest) > 200_000:
                    rest.clear()
                packed = rest[unit] = np.array(rule(unit, model), np.int32).tobytes()
            return packed

        def comes_back(unit: str, packed: bytes) -> bool:
            found = whole.get(unit)
            if found is None:
                if len(whole) > 400_000:
                    whole.clear()
                found = whole[unit] = model.round_trips(unit, np.frombuffer(packed, np.int32).tolist())
            return found

        for batch in _row_slices(batches):
            n_ids, same, flat = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool), [np.zeros(0, np.int32)]
            for units, number, row in occurrences(batch.column("text").to_pylist(), model):
                packed = [packed_ids(u) for u in units]
                back = np.array([comes_back(u, p) for u, p in zip(units, packed)])
                size = np.array([len(p) // 4 for p in packed])
                start, each = (np.cumsum(size) - size)[number], size[number]
                place = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(each.sum())
                flat.append(np.frombuffer(b"".join(packed), np.int32)[place])
                n_ids += np.bincount(row, weights=each, minlength=batch.num_rows).astype(np.int64)
                same[row[~back[number]]] = False
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_ids)), pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(same)], ["doc_id", "ids", "round_trip"])

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    found = given.mapInArrow(work, "doc_id string, ids array<int>, round_trip boolean")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), "round_trip")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, text) from ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].values, "text": [shared.value.decode(list(i)) for i in frame["ids"]]})

    given = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return given.mapInPandas(work, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))
