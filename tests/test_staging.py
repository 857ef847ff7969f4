"""Staged tables: written once, found again, removed on request."""

from prioscope.sources.staging import folder_exists, fresh_path, kept, shared_folder, staged


def test_staged_once_and_found_again(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(10).withColumnRenamed("id", "k")

    for _ in range(2):
        assert staged(spark, "some input", "some table", build, "k").count() == 10
    assert built == [1]


def test_kept_tables_have_paths_of_their_own(spark):
    first, second = kept(spark.range(3), "same-name"), kept(spark.range(4), "same-name")
    assert first.count() == 3 and second.count() == 4
    assert not folder_exists(spark, fresh_path(spark, "nothing")) and folder_exists(spark, shared_folder(spark))


def test_rows_side_by_side_stay_together_and_meet_their_results(spark):
    from pyspark.sql import functions as F

    from prioscope.sources.staging import RUN_ROWS, numbered_rows, run_col, with_row_results

    rows = numbered_rows(spark.range(500, numPartitions=2).withColumnRenamed("id", "k"), "nr", "side-by-side")
    files = rows.select("nr", F.input_file_name().alias("file")).groupBy(F.floor(F.col("nr") / RUN_ROWS).alias("run"))
    assert all(r.n == 1 for r in files.agg(F.count_distinct("file").alias("n")).collect())
    found = rows.where("k % 3 = 0").select("nr", (F.col("k") * 2).alias("twice"))
    joined = with_row_results(rows, found, "nr")
    assert {(r.k, r.twice) for r in joined.collect()} == {(k, 2 * k if k % 3 == 0 else None) for k in range(500)}
    assert joined.columns == ["k", "nr", run_col("nr"), "twice"]


def test_a_clustered_table_is_staged_as_it_lies(spark, tmp_path):
    """Tickets with the same turn lie side by side; a shuffle by id would deal them to all files, where like texts no longer compress."""
    from pyspark.sql import functions as F

    from prioscope.plans.catalog import clean, tickets

    d = str(tmp_path)
    n = 400
    spark.range(n).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", "'1-HIGH' AS o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(10).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "concat('turn of talk ', id) AS text").write.parquet(f"{d}/conversations.parquet")
    spark.range(n).selectExpr("id AS event_id", "CAST(id AS double) AS value").write.parquet(f"{d}/events.parquet")
    spark.range(5).selectExpr("id AS p_partkey", "'TYPE' AS p_type").write.parquet(f"{d}/part.parquet")
    spark.range(20).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").write.parquet(f"{d}/customer.parquet")
    for table in (tickets(spark, d), clean(spark, d)):
        files = table.withColumn("file", F.input_file_name()).where("ticket_key % 103 != 0").groupBy(F.regexp_extract("description", "turn of talk \\d", 0).alias("turn"))
        found = files.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
        assert len(found) == 10 and sum(r.n for r in found) == n - 4
        assert all(r.files == 1 for r in found)
