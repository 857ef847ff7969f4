"""Mixing of sources to target weights by Sainte-Laguë apportionment (operator 11); DataFrame functions only.

Each source has a weight and a target number of words; no target passes ``most`` times the
words of its source, and what is left over is shared again by weight. The mix is laid out as
shards of equal-token blocks. For every shard the blocks of all shards up to it are apportioned
to the sources by highest quotients target / (blocks + 1/2). That method never takes
a block back when more are to be given, so the differences from shard to shard are the integer quotas per shard,
and their sum is the apportionment of the whole mix.

The documents of a source are put in an order drawn by the seed (a hash of seed, id and text); blocks
are cut from this order one after the other, from its start again when it is used up, and the quota takes the
first of them. So almost all documents are taken whole, and the same seed gives the same mix.
Places in the order are prefix sums over two digits of the hash, so no task sees a whole source. Rows alike
in id and text are one group whose copies follow each other.

Defined results: a null text has no words; null sources are one source, the last in order; a
source without words has the target 0; repeated rows are separate copies; an empty table gives an empty
result. Extra columns are ignored by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from prioscope.llm.common import by_group, kept, text_of
from prioscope.operators.ordering import number_values, running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 16
SHARD_BLOCKS = 1 << 20
SEED = 11
_COPIES = 4096
_CELL_WORDS = 1 << 20


@dataclass
class Mix:
    """``sources``: one row per source. ``quotas``: blocks per shard and source. ``rows``: one row per document."""

    sources: DataFrame
    quotas: DataFrame
    rows: DataFrame


def mix_key(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """32 bytes that tell rows apart by id and text and put them in the order of the seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text_of(text_col))
    return F.unhex(F.sha2(named, 256))


def _earlier(c: str, keys: list[str], order: str) -> Column:
    """Sum over the rows before, within ``keys``."""
    return F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def with_starts(groups: DataFrame) -> DataFrame:
    """Add ``start``: the words of the same source that come before, by two digits of the key."""
    fine = groups.groupBy("mark", F.substring("key", 1, 3).alias("cell")).agg(F.sum("words").alias("words"))
    fine = kept(fine.withColumn("digit", F.substring("cell", 1, 1)), "cells")
    coarse = fine.groupBy("mark", "digit").agg(F.sum("words").alias("words"))
    coarse = coarse.select("mark", "digit", _earlier("words", ["mark"], "digit").alias("before_digit"))
    cells = fine.withColumn("before_cell", _earlier("words", ["mark", "digit"], "cell")).join(coarse, ["mark", "digit"])
    placed = groups.withColumn("cell", F.substring("key", 1, 3)).withColumn("before", _earlier("words", ["mark", "cell"], "key"))
    joined = placed.join(cells.select("mark", "cell", "before_cell", "before_digit"), ["mark", "cell"])
    return joined.withColumn("start", F.col("before_digit") + F.col("before_cell") + F.col("before")).drop("cell", "before", "before_cell", "before_digit")


def source_table(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(mark, source, place, weight, source_size, source_rows), sources in code-point order, null last."""
    sizes = kept(groups.groupBy("mark").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "sources")
    named = sizes.where("source IS NOT NULL")
    numbered = named.join(number_values(named, "source", "place"), "source")
    last = named.agg(F.count(F.lit(1))).scalar()
    whole = numbered.unionByName(sizes.where("source IS NULL").withColumn("place", last))
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights)).cast("int"))
    return kept(whole.select("mark", "source", "place", weight.alias("weight"), "source_size", "source_rows"), "numbered")


def with_targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target``. Sources are filled by weight up to one level; those whose limit lies below it stay at their limit.

    Sources are put in the order of limit / weight. The last one whose own limit as the level would
    still share out less than all words is the last that stays at its limit.
    """
    limited = sources.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    steps = running_sums(limited.groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")), "ratio", ["cap", "weight"])
    full = F.col("before_cap") + F.col("cap")
    open_weight = F.col("all_weight") - F.col("before_weight") - F.col("weight")
    total = F.expr(f"all_cap div {most}")
    below = full + F.col("ratio") * open_weight < total
    levels = steps.select("ratio", (total - full).alias("rest"), open_weight.alias("share")).where(below)
    none = steps.agg(F.lit(-1.0).alias("ratio"), F.max(total).alias("rest"), F.max("all_weight").alias("share"))
    level = levels.unionByName(none).agg(F.max(F.struct("ratio", "rest", "share"))).scalar()
    return (
        limited.withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level.rest") / F.col("level.share")))
        .drop("cap", "ratio", "level")
    )


def apportion(sources: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, place, seats, blocks): blocks given up to a shard, and in it. ``sources`` needs place, source_size and target.

    Rounding target / block comes within half the number of sources of the right total, which leaves
    few seats per source open; those go to the highest quotients, and equal ones to the first source.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0).cast("long"))).scalar()
    given = sources.where("target > 0").withColumns({"total": total, "m": sources.where("target > 0").agg(F.count(F.lit(1))).scalar()})
    seats = F.ceil(F.col("total") / block)
    house = F.least(F.col("shard") * shard_blocks, seats)
    rows = given.withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(seats / shard_blocks)))).withColumn("house", house)

    def about(houses: Column) -> Column:
        return F.floor(F.col("target") * houses / F.col("total") + 0.5)

    bounded = kept(
        rows.select("shard", "place", "target", "house", F.greatest(F.lit(0).cast("long"), about(F.col("house") - F.col("m") / 2) - 1).alias("low"),
                    (about(F.col("house") + F.col("m") / 2) + 1).alias("high")),
        "bounds",
    )
    need = bounded.groupBy("shard").agg((F.max("house") - F.sum("low")).alias("need"))
    open_seats = kept(
        bounded.withColumn("seat", F.explode(F.sequence("low", "high"))).select("shard", "place", (-F.col("target") / (F.col("seat") + 0.5)).alias("order")),
        "open-seats",
    )
    classes = running_sums(open_seats.groupBy("shard", "order").agg(F.count(F.lit(1)).alias("n")), "order", ["n"], by=["shard"])
    class_row = F.row_number().over(Window.partitionBy("shard", "order").orderBy("place"))
    ranked = open_seats.withColumn("nr", class_row).join(classes.select("shard", "order", "before_n"), ["shard", "order"]).join(need, "shard")
    won = ranked.where(F.col("before_n") + F.col("nr") <= F.col("need")).groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won"))
    reached = bounded.join(won, ["shard", "place"], "left").select("shard", "place", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("place").orderBy("shard"))
    return kept(reached.withColumn("blocks", F.col("seats") - before), "quotas")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> Mix:
    """Targets, quotas per shard, and how many words of each document the mix takes."""
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("mark"),
        mix_key(seed).alias("key"), words.alias("size"),
    )
    groups = rows.groupBy("mark", "key").agg(
        F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")
    )
    groups = kept(groups.withColumn("words", F.col("size") * F.col("copies")), "groups")
    sources = kept(with_targets(source_table(groups, weights), most), "targets")
    quotas = apportion(sources, block, shard_blocks)
    given = quotas.groupBy("place").agg(F.sum("blocks").alias("quota"))
    quota = F.coalesce("quota", F.lit(0).cast("long"))
    used = sources.join(given, "place", "left").withColumn("quota", quota).withColumn("used", F.least(F.col("quota") * block, F.col("source_size") * most))
    table = kept(used, "used")
    placed = with_starts(groups).drop("source", "words")
    described = by_group(placed, table, "mark", "source_rows", groups.count())
    return Mix(table, quotas, _with_taken(_copies(described)))


def _copies(groups: DataFrame) -> DataFrame:
    """One row per document, ``start`` moved on by its size for each copy; very large groups are spread first."""
    many = groups.where(F.col("copies") > _COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_COPIES}"))))
    many = many.repartition("key", "part")
    first, last = F.col("part") * _COPIES, F.least((F.col("part") + 1) * _COPIES, F.col("copies")) - 1
    spread = many.withColumn("copy", F.explode(F.sequence(first, last))).drop("part")
    few = groups.where(F.col("copies") <= _COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return few.unionByName(spread).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def _with_taken(rows: DataFrame) -> DataFrame:
    """Words taken: whole rounds through the source, and what the last round covers of the document."""
    rounds, rest = F.expr("used div greatest(source_size, 1)"), F.expr("used % greatest(source_size, 1)")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    return rows.withColumn("taken", F.col("size") * rounds + part)


def pieces(mixed: Mix, block: int = BLOCK_WORDS) -> DataFrame:
    """(shard, mark, at, key, copy, size, first_word, n_words): which words of which document go to which shard.

    Documents and shards are intervals of a source's order; both are cut at every ``_CELL_WORDS`` words
    and joined by cell, so no key of the join holds more than that many words.
    """
    cell = F.lit(_CELL_WORDS).cast("long")
    spans = mixed.quotas.where("blocks > 0").join(mixed.sources.select("place", "mark", "used"), "place")
    spans = spans.select("mark", "shard", ((F.col("seats") - F.col("blocks")) * block).alias("low"), F.least(F.col("seats") * block, F.col("used")).alias("high"))
    spans = spans.where("low < high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    rounds = F.expr("(used - 1 - start) div source_size")
    taken = mixed.rows.where("taken > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds)))
    taken = taken.withColumn("from", F.col("start") + F.col("round") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("used")))
    taken = taken.where("`from` < `to`").withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    low = F.greatest("low", "from", F.col("cell") * cell)
    high = F.least("high", "to", (F.col("cell") + 1) * cell)
    met = taken.join(spans, ["mark", "cell"]).withColumns({"a": low, "b": high}).where("a < b")
    parts = met.groupBy("shard", "mark", "key", "copy", "round", "size", "from").agg(F.min("a").alias("at"), F.sum(F.col("b") - F.col("a")).alias("n_words"))
    return parts.select("shard", "mark", "at", "key", "copy", "size", (F.col("at") - F.col("from")).alias("first_word"), "n_words")


def write_mix(docs: DataFrame, path: str, seed: int = SEED, block: int = BLOCK_WORDS, **given) -> Mix:
    """Write the mix below ``path``, one folder per shard: (source, doc_id, text). Cut documents are written as words and blanks."""
    mixed = mix(docs, seed=seed, block=block, **given)
    parts = kept(pieces(mixed, block), "pieces")
    uses = parts.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    texts = docs.select(mix_key(seed).alias("key"), "doc_id", F.col("source").cast("string").alias("source"), text_of().alias("text")).dropDuplicates(["key"])
    met = by_group(parts, kept(texts.join(uses, "key"), "texts"), "key", "uses", parts.count())
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    out = met.withColumn("text", F.when(F.col("n_words") == F.col("size"), F.col("text")).otherwise(some))
    shards = out.repartition("shard").sortWithinPartitions("shard", "mark", "at").select("shard", "source", "doc_id", "text")
    shards.write.partitionBy("shard").parquet(path)
    return mixed


def oracle(block: int = BLOCK_WORDS, seed: int = SEED) -> str:
    """DuckDB SQL for the query: the same targets, the exact apportionment of all blocks, and the same seeded order."""
    weights = ", ".join(str(w) for w in WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             sha256(concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'), ':', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
c AS (SELECT *, {MOST_REPEATS} * source_size AS cap, {MOST_REPEATS} * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM s),
l AS (SELECT ratio, total - sum(cap) OVER w AS rest, sum(weight) OVER () - sum(weight) OVER w AS share, total FROM c WINDOW w AS (ORDER BY ratio)),
v AS (SELECT ratio, rest, share FROM l WHERE total - rest + ratio * share < total UNION ALL SELECT -1, max(total), (SELECT sum(weight) FROM s) FROM l),
t AS (SELECT c.*, least(cap::DOUBLE, weight * rest / share) AS target FROM c, (SELECT * FROM v ORDER BY ratio DESC LIMIT 1)),
m AS (SELECT ceil(max(total) / {block})::BIGINT AS house, count(*) AS m FROM t WHERE target > 0),
b AS (SELECT place, target, greatest(0, floor(target * (house - m) / total) - 2)::BIGINT AS low, (floor(target * (house + m) / total) + 2)::BIGINT AS high FROM t, m WHERE target > 0),
o AS (SELECT place, row_number() OVER (ORDER BY target / (seat + 0.5) DESC, place) AS nr FROM (SELECT *, unnest(range(low, high)) AS seat FROM b)),
q AS (SELECT b.place, any_value(low) + count(o.nr) FILTER (o.nr <= (SELECT max(house) FROM m) - (SELECT sum(low) FROM b)) AS quota FROM b JOIN o USING (place) GROUP BY b.place),
u AS (SELECT t.source, source_size, target, least(coalesce(quota, 0) * {block}, cap)::BIGINT AS used FROM t LEFT JOIN q USING (place)),
p AS (SELECT d.doc_id, d.size, u.*, coalesce(sum(size) OVER (PARTITION BY u.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * (used // greatest(source_size, 1)) + greatest(0, least(size, used % greatest(source_size, 1) - start)))::BIGINT AS taken FROM p
"""


__all__ = ["Mix", "apportion", "mix", "mix_key", "oracle", "pieces", "with_targets", "write_mix"]
