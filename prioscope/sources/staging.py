"""Tables written once to the shared folder and read back, so later work starts from storage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Neighbouring rows that ``numbered_rows`` keeps together: a power of two, 64 at most.
RUN_ROWS = 32
#: Tables between two steps hold whole texts, many of them alike and side by side.
_CODEC = "zstd"
#: Columns that ``text_rows`` adds: the key of a row's text, the row's number, and the group that buckets both.
TEXT_KEY, TEXT_ROW, TEXT_GROUP = "_text_key", "_text_row", "_text_group"
#: Copies within 2 ** 12 rows meet; these rows are dealt to 64 groups by the ends of their texts.
_BLOCK_BITS, _ENDS, _END_LENGTH = 12, 64, 128


def shared_folder(spark: SparkSession) -> str:
    """The folder every node can reach. A temporary one is only made on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="prioscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(spark: SparkSession, key: str, name: str, build, spread_by: str | None = None) -> DataFrame:
    """Read table ``name`` for input ``key``, writing it first if this application has not.

    ``spread_by`` spreads the rows, so that scoring, which is bound by the processor and
    not by input size, starts on all cores; adaptive execution sizes the files.
    """
    mark = hashlib.sha256(key.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/prioscope/{spark.sparkContext.applicationId}/{mark}/{name}"
    if not folder_exists(spark, f"{path}/_SUCCESS"):
        table = build()
        if spread_by:
            table = table.repartition(spread_by)
        table.write.mode("overwrite").parquet(path, compression=_CODEC)
    return spark.read.parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it is not there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(hadoop_path) if status.isDirectory())


def delete_folder(spark: SparkSession, folder: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def versions_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions below ``folder`` that are written to their end, the oldest first."""
    names = folders_in(spark, folder)
    numbers = sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-") and n.removeprefix("version-").isdigit())
    return [n for n in numbers if folder_exists(spark, f"{folder}/version-{n}/_SUCCESS")]


def publish_version(df: DataFrame, folder: str) -> int:
    """Write a table beside its earlier versions; readers see it when it is whole. A half-written one is overwritten."""
    number = max(versions_of(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/version-{number}")
    return number


def newest_version(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    found = versions_of(spark, folder)
    if not found:
        raise FileNotFoundError(f"no version has been published in {folder}")
    return found[-1], spark.read.parquet(f"{folder}/version-{found[-1]}")


def remove_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged; call it when no result is read any more."""
    delete_folder(spark, f"{shared_folder(spark)}/prioscope/{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of this application that nothing has written to."""
    return f"{shared_folder(spark)}/prioscope/{spark.sparkContext.applicationId}/kept/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and go on from storage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=_CODEC)
    return df.sparkSession.read.parquet(path)


def staged_text_rows(spark: SparkSession, key: str, name: str, build, text_col: str) -> DataFrame:
    """``text_rows`` of what ``build`` gives, stored once for input ``key``."""
    mark = hashlib.sha256(f"{key} {spark.sparkContext.applicationId}".encode()).hexdigest()[:24]
    table = f"{name}_{mark}".replace("-", "_")
    path = f"{shared_folder(spark)}/prioscope/{spark.sparkContext.applicationId}/{mark[:12]}/{name}"
    if not (spark.catalog.tableExists(table) and folder_exists(spark, f"{path}/_SUCCESS")):
        return _stored_by_text(build(), text_col, table, path)
    return spark.table(table)


def text_rows(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """The table stored bucketed by its texts, so that work on texts is done once for copies.

    ``TEXT_ROW`` numbers the rows as they lay. Rows of a block of 2 ** 12 whose texts end alike form a ``TEXT_GROUP``, which
    is what buckets them: copies meet, texts that differ in their beginnings stay side by side and compress, and a text
    found all over the table does not fill one bucket. ``TEXT_KEY`` is the group with a 64-bit hash of the text.
    """
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    return _stored_by_text(df, text_col, table, fresh_path(df.sparkSession, name))


def _stored_by_text(df: DataFrame, text_col: str, table: str, path: str) -> DataFrame:
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn(TEXT_ROW, F.monotonically_increasing_id())
    text = F.col(text_col).cast("string")
    end = F.pmod(F.xxhash64(F.right(text, F.lit(_END_LENGTH))), F.lit(_ENDS))
    grouped = numbered.withColumn(TEXT_GROUP, F.shiftright(TEXT_ROW, _BLOCK_BITS) * _ENDS + end)
    keyed = grouped.withColumn(TEXT_KEY, F.struct(F.col(TEXT_GROUP).alias("group"), F.xxhash64(text).alias("text")))
    rows = keyed.repartition(buckets, TEXT_GROUP)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, TEXT_GROUP).option("compression", _CODEC).option("path", path).saveAsTable(table)
    return spark.table(table)


def distinct_texts(rows: DataFrame, text_col: str, count_col: str = "_copies") -> DataFrame:
    """(TEXT_GROUP, TEXT_KEY, TEXT_ROW, text, count_col) per text of ``text_rows``: its first row, and how many there are. Nothing is shuffled for it."""
    return rows.groupBy(TEXT_GROUP, TEXT_KEY, text_col).agg(F.min(TEXT_ROW).alias(TEXT_ROW), F.count(F.lit(1)).alias(count_col))


def with_text_results(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``text_rows`` with what ``found`` has for their ``TEXT_KEY``; the stored rows do not move.

    Groups are joined and texts compared within a group, which has few, and 2 ** 12 at most; the text as a second join key would have Spark
    move the stored rows. ``found`` does not move either if it still has the ``TEXT_GROUP`` of ``distinct_texts``.
    """
    there = found.withColumn("_group", F.col(TEXT_GROUP if TEXT_GROUP in found.columns else f"{TEXT_KEY}.group"))
    there = there.withColumn("_text", F.col(f"{TEXT_KEY}.text")).drop(TEXT_KEY, TEXT_GROUP)
    same = (F.col(TEXT_GROUP) == F.col("_group")) & (F.col(f"{TEXT_KEY}.text").bitwiseXOR(F.col("_text")) == 0)
    return rows.join(there.hint("shuffle_hash"), same).drop(TEXT_KEY, TEXT_ROW, TEXT_GROUP, "_group", "_text")


def run_col(row_col: str) -> str:
    """Name of the column that tells the run of a numbered row."""
    return f"{row_col}_run"


def run_of(row: Column) -> Column:
    return F.shiftright(row, RUN_ROWS.bit_length() - 1)


def numbered_rows(df: DataFrame, row_col: str, name: str) -> DataFrame:
    """The table stored with a row number, bucketed by runs of ``RUN_ROWS`` numbers, one file per bucket.

    A narrow result keyed by the row number joins back by ``with_row_results`` without moving the stored
    columns again. Rows that lie side by side stay side by side, so like texts still compress.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    numbered = df.withColumn(row_col, F.monotonically_increasing_id())
    rows = numbered.withColumn(run_col(row_col), run_of(F.col(row_col))).repartition(buckets, run_col(row_col))
    rows.write.format("parquet").bucketBy(buckets, run_col(row_col)).option("compression", _CODEC).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def with_row_results(rows: DataFrame, found: DataFrame, row_col: str) -> DataFrame:
    """Rows of ``numbered_rows`` with the one row of ``found`` that has their number, or nulls.

    Only ``found`` moves, to the buckets of the runs. The row number is compared within a run of few rows;
    as a second join key it would have Spark move the stored rows as well.
    """
    run, number = run_col(row_col), f"_of{row_col}"
    there = found.withColumnRenamed(row_col, number).withColumn(f"_of{run}", run_of(F.col(number)))
    same = (F.col(run) == F.col(f"_of{run}")) & (F.col(row_col) - F.col(number) == 0)
    return rows.join(there.hint("shuffle_hash"), same, "left").drop(number, f"_of{run}")
