"""Stored quantiles and published runs."""

import random

import pytest
from pyspark.sql import functions as F

from prioscope.operators import quantile_state as stored
from prioscope.operators.ordering import quantiles
from prioscope.operators.time_signal import fit_thresholds
from prioscope.sources.runs import outputs, published_runs, remove_unpublished, run_once
from prioscope.sources.staging import delete_folder, folder_exists

SHARES, NAMES = [0.0, 0.15, 0.5, 0.65, 0.999, 1.0], ["a", "b", "c", "d", "e", "f"]


def numbers(seed, n=400):
    rng = random.Random(seed)
    usual = [rng.choice([4.0, 4.0, rng.lognormvariate(2, 2), -rng.random(), 4.0 + rng.random() / 1e6]) for _ in range(n)]
    return usual + [None, float("nan"), float("inf"), 0.0]


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def test_ten_batches_equal_a_refit_of_all_rows(spark, tmp_path):
    state, everything = str(tmp_path / "state"), []
    for i in range(10):
        everything += numbers(i)
        assert stored.absorb(table(spark, numbers(i)), "v", state, f"b{i}")
        if i in (3, 7):
            stored.merge_batches(spark, state)
        if i not in (2, 5, 9):
            continue
        expected = quantiles(table(spark, everything), "v", SHARES, NAMES).first()
        assert str(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == str(expected)
    assert stored.absorbed(spark, state) == {f"b{i}" for i in range(10)}


def test_a_batch_counts_once_and_only_when_it_is_whole(spark, tmp_path):
    state = str(tmp_path / "state")
    for i in range(3):
        stored.absorb(table(spark, numbers(i)), "v", state, f"b{i}")
    stored.merge_batches(spark, state)
    first = str(stored.stored_quantiles(spark, state, SHARES, NAMES).first())
    assert not stored.absorb(table(spark, numbers(1)), "v", state, "b1")
    stored.absorb(table(spark, numbers(5)), "v", state, "b5")
    with_fifth = str(stored.stored_quantiles(spark, state, SHARES, NAMES).first())
    stored.absorb(table(spark, numbers(5)), "v", state, "b5")
    assert str(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == with_fifth != first
    delete_folder(spark, f"{state}/batches/b5/sketch")
    assert str(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == first
    assert stored.absorbed(spark, state) == {"b0", "b1", "b2"}


def test_empty_state_and_empty_batches(spark, tmp_path):
    state = str(tmp_path / "state")
    assert set(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == {None}
    stored.absorb(table(spark, [None]), "v", state, "nothing")
    stored.merge_batches(spark, state)
    assert set(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == {None}
    stored.absorb(table(spark, [3.0]), "v", state, "one")
    assert set(stored.stored_quantiles(spark, state, SHARES, NAMES).first()) == {3.0}


def test_only_bracket_cells_are_read(spark, tmp_path):
    state = str(tmp_path / "state")
    stored.absorb(spark.range(20_000).select(F.col("id").cast("double").alias("v")), "v", state, "b")
    folders, _ = stored._folders(spark, state)
    assert len(stored.bracket_cells(spark, folders, [0.15, 0.35, 0.65])) <= 6
    plan = stored.stored_quantiles(spark, state, [0.5], ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cell), EqualTo(cell," in plan or "PushedFilters: [In(cell," in plan


def test_a_stream_of_hours_gives_the_limits_of_the_whole(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(abs(v) * 3,) for v in numbers(11, 300) if v is not None and abs(v) < 1e6]
    hours = spark.createDataFrame(rows, "resolution_hours double")
    hours.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stored.start_absorbing(stream, state, str(tmp_path / "check")).awaitTermination()
    assert len(stored.absorbed(spark, state)) > 1
    assert stored.stored_thresholds(spark, state).first() == fit_thresholds(hours).first()


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "out")

    def build(value, dies=False):
        def write(folder):
            spark.range(value).write.parquet(f"{folder}/one")
            if dies:
                raise RuntimeError("lost")
            spark.range(value + 1).write.parquet(f"{folder}/two")
            return value

        return write

    def sizes():
        return {name: spark.read.parquet(path).count() for name, path in outputs(spark, base).items()}

    with pytest.raises(FileNotFoundError):
        outputs(spark, base)
    assert run_once(spark, base, build(3), "r1") == 3
    assert sizes() == {"one": 3, "two": 4}
    with pytest.raises(RuntimeError):
        run_once(spark, base, build(8, dies=True), "r2")
    assert sizes() == {"one": 3, "two": 4}
    run_once(spark, base, build(5), "r2")
    assert sizes() == {"one": 5, "two": 6}
    with pytest.raises(ValueError):
        run_once(spark, base, build(9), "r2")
    with pytest.raises(RuntimeError):
        run_once(spark, base, build(8, dies=True), "r3")
    assert remove_unpublished(spark, base) == ["r1", "r3"]
    assert published_runs(spark, base) == ["r1", "r2"] and sizes() == {"one": 5, "two": 6}
    assert not folder_exists(spark, f"{base}/runs/r3")
