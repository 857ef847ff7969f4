"""Exact quantiles of a growing table from stored state; rows that were absorbed are never read again.

The state holds, per batch, a sketch (how many numbers fall into each coarse cell) and the
counts of the numbers themselves, sorted by cell. Both merge by adding. A quantile is found in
two steps: the sketches say which cells hold the ranks asked for, at most two for each share,
and only those cells are read from the counts, where the exact value is picked. So a refit reads
the sketches and a few row groups, however many rows have been absorbed.

A batch is named by its caller and counts once: absorbed again it replaces itself, and a batch
that died half-way is not seen. ``merge_batches`` keeps the number of folders small.

Defined results: null and NaN do not count, infinities do; an empty state gives nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prioscope.operators.ordering import coarse_digit, quantiles_of_ranked, running_sums, value_counts
from prioscope.operators.time_signal import LIMITS, usable_logs
from prioscope.settings import FULL, Profile
from prioscope.sources.staging import delete_folder, folder_exists, folders_in, publish_version, versions_of

_COUNTS = "cell LONG, value DOUBLE, n LONG"
_SKETCH = "cell LONG, n LONG"


def _write_counts(counts: DataFrame, folder: str) -> None:
    """Counts in order of value, so that a cell lies in few row groups; the sketch is written last and marks the end."""
    spark = counts.sparkSession
    delete_folder(spark, f"{folder}/sketch")
    counts.repartitionByRange(F.col("value")).sortWithinPartitions("value").write.mode("overwrite").parquet(f"{folder}/counts")
    stored = spark.read.parquet(f"{folder}/counts")
    stored.groupBy("cell").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/sketch")


def _whole(spark: SparkSession, folder: str) -> bool:
    return all(folder_exists(spark, f"{folder}/{part}/_SUCCESS") for part in ("counts", "sketch"))


def _merged(spark: SparkSession, state: str) -> tuple[str | None, set[str]]:
    """Folder of the newest merge and the batches that are in it."""
    found = versions_of(spark, f"{state}/merged")
    if not found:
        return None, set()
    inside = spark.read.parquet(f"{state}/merged/version-{found[-1]}")
    return f"{state}/tables/merge-{found[-1]}", {r.batch for r in inside.collect()}


def _folders(spark: SparkSession, state: str) -> tuple[list[str], set[str]]:
    """Folders that together hold every absorbed batch once, and the names of those batches."""
    merged, inside = _merged(spark, state)
    later = {name for name in folders_in(spark, f"{state}/batches") if name not in inside and _whole(spark, f"{state}/batches/{name}")}
    return ([merged] if merged else []) + [f"{state}/batches/{name}" for name in sorted(later)], inside | later


def absorb(df: DataFrame, value_col: str, state: str, batch: str) -> bool:
    """Add the numbers of a batch to the state. False if a merge holds the batch already; then nothing is done."""
    spark = df.sparkSession
    if batch in _merged(spark, state)[1]:
        return False
    counts = value_counts(df, value_col, []).select(coarse_digit(F.col("_v")).alias("cell"), F.col("_v").alias("value"), F.col("_n").alias("n"))
    _write_counts(counts, f"{state}/batches/{batch}")
    return True


def _read(spark: SparkSession, folders: list[str], part: str, shape: str) -> DataFrame:
    return spark.read.schema(shape).parquet(*[f"{f}/{part}" for f in folders]) if folders else spark.createDataFrame([], shape)


def absorbed(spark: SparkSession, state: str) -> set[str]:
    """Names of the batches that count."""
    return _folders(spark, state)[1]


def merge_batches(spark: SparkSession, state: str) -> None:
    """Write all batches as one; the list of what it holds is published last, so readers see the old or the new state."""
    folders, names = _folders(spark, state)
    if len(folders) < 2:
        return
    counts = _read(spark, folders, "counts", _COUNTS).groupBy("cell", "value").agg(F.sum("n").alias("n"))
    number = max(versions_of(spark, f"{state}/merged"), default=0) + 1
    _write_counts(counts, f"{state}/tables/merge-{number}")
    publish_version(spark.createDataFrame([(n,) for n in sorted(names)], "batch STRING"), f"{state}/merged")


def bracket_cells(spark: SparkSession, folders: list[str], shares: list[float]) -> list:
    """The cells that hold the ranks of the shares, with the rows before them; at most two for each share."""
    cells = _read(spark, folders, "sketch", _SKETCH).groupBy("cell").agg(F.sum("n").alias("n"))
    placed = running_sums(cells, "cell", ["n"])
    last = F.col("all_n") - 1
    hits = F.lit(False)
    for share in shares:
        position = last * F.lit(float(share))
        for rank in (F.floor(position), F.ceil(position)):
            hits = hits | ((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")))
    return placed.where(hits).select("cell", "before_n", "all_n").collect()


def stored_quantiles(spark: SparkSession, state: str, shares: list[float], names: list[str]) -> DataFrame:
    """One row with the exact quantiles of everything absorbed, as ``ordering.quantiles`` would find them."""
    folders, _ = _folders(spark, state)
    brackets = bracket_cells(spark, folders, shares)
    wanted = [r.cell for r in brackets]
    inside = _read(spark, folders, "counts", _COUNTS).where(F.col("cell").isin(wanted))
    values = inside.groupBy("cell", F.col("value").alias("_v")).agg(F.sum("n").alias("_n"))
    starts = spark.createDataFrame([tuple(r) for r in brackets], "cell LONG, _start LONG, _all LONG")
    placed = running_sums(values, "_v", ["_n"], ["cell"]).join(F.broadcast(starts), "cell")
    ranked = placed.select("_v", "_n", (F.col("_start") + F.col("before__n")).alias("before__n"), F.col("_all").alias("all__n"))
    return quantiles_of_ranked(ranked, shares, names, [])


def absorb_hours(clean: DataFrame, state: str, batch: str, hours_col: str = "resolution_hours", profile: Profile = FULL) -> bool:
    """Add the hours of a batch of cleaned tickets to the state that ``stored_thresholds`` reads."""
    return absorb(usable_logs(clean, hours_col, profile), "_log", state, batch)


def stored_thresholds(spark: SparkSession, state: str) -> DataFrame:
    """The three limits over all absorbed batches; equal to ``fit_thresholds`` of all their rows."""
    return stored_quantiles(spark, state, list(LIMITS.values()), list(LIMITS))


def start_absorbing(clean: DataFrame, state: str, checkpoint: str, hours_col: str = "resolution_hours", profile: Profile = FULL, once: bool = True, name: str = "stream"):
    """Absorb the micro-batches of a stream of cleaned tickets; a retried batch replaces itself.

    Streams that feed one state, or a stream started over with a new checkpoint, need a ``name`` of their own.
    """

    def absorb_batch(batch: DataFrame, number: int) -> None:
        absorb_hours(batch, state, f"{name}-{number}", hours_col, profile)

    writer = clean.writeStream.foreachBatch(absorb_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
