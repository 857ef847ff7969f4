"""Helpers the operators of this package share."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prioscope.sources.staging import delete_folder, fresh_path

_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

HELD_OUT_PARTS, HELD_OUT_PART = 4, 2


def kept(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """Write a table that several later steps read to the shared folder, and go on from there.

    While it is written, Python workers get ``batch`` rows at a time, few since texts may be long.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    noted = _SCRATCH.get()
    if noted is not None:
        noted.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession, collect: bool = True) -> None:
    """Delete the tables kept since the last call with ``collect``; nothing may read them any more.

    Tables are only noted for this while ``collect`` holds, that is within the pipeline, and
    for each thread by itself, so two pipelines of one driver leave each other's tables alone.
    """
    for path in _SCRATCH.get() or []:
        delete_folder(spark, path)
    _SCRATCH.set([] if collect else None)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_PARTS == HELD_OUT_PART


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """32 bytes that tell rows apart by id and whole text; null ids are alike."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text_of(text_col)), 256))


def keep_rows(docs: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is in ``keys``; rows equal in id and text come back once.

    One shuffle by a key that is all but unique, so no task gets a large group.
    """
    name = free_name(docs, "_row_key")
    keyed = docs.withColumn(name, row_key())
    wanted = keys.select(F.col(key_col).alias(name)).distinct()
    return keyed.join(wanted, name, "left_semi").dropDuplicates([name]).drop(name)


def by_group(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int, most: int = 1000) -> DataFrame:
    """Join each row to the one row of its group, without one task ever getting a large group.

    Groups that hold more than 1 / ``most`` of the ``total`` rows are fewer than ``most``,
    so those are broadcast; the rest are joined by a shuffle in which every key is small.
    """
    least = total // most + 1
    heavy = F.broadcast(groups.where(F.col(size_col) > least))
    light = groups.where(F.col(size_col) <= least)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


__all__ = ["by_group", "free_name", "held_out", "keep_rows", "kept", "release", "row_key", "text_of"]
