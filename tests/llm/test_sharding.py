import duckdb
from pyspark.sql import functions as F

from prioscope.llm.sharding import assign, oracle, write_shards
from prioscope.sources.staging import fresh_path


def test_equals_sql_at_a_small_limit(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    limit = 9_000
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    cursor = base.execute(oracle(limit))
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(r) for r in cursor.fetchall())
    found = assign(docs, limit).select(*names)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert max(r[names.index("depth")] for r in want) > 8
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def test_shards_are_a_prefix_code_and_fit(spark, tricky, nothing):
    found = assign(tricky, 500).collect()
    assert len(found) == tricky.count()
    shards = {r.shard for r in found}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for s in shards:
        own = [r for r in found if r.shard == s]
        assert {r.shard_bytes for r in own} == {sum(r.n_bytes for r in own)}
        assert sum(r.n_bytes for r in own) <= 500 or len(own) == 1 and own[0].oversized
    assert assign(nothing, 500).count() == 0


def test_rows_with_one_key_are_split(spark):
    docs = spark.range(64).selectExpr("cast(null as long) AS doc_id", "repeat('x', 100) AS text")
    found = assign(docs, 1000).collect()
    assert len(found) == 64 and all(r.shard_bytes <= 1000 for r in found) and min(r.depth for r in found) > 32


def test_written_shards_hold_every_row(spark, tricky):
    path = fresh_path(spark, "shards")
    docs = tricky.withColumnRenamed("label_", "shard")
    table = write_shards(docs, 2000, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() == table.count()
    assert back.select("shard_").distinct().count() == table.select("shard").distinct().count()


def test_shards_of_a_shuffled_input(spark):
    path = fresh_path(spark, "shuffled-shards")
    docs = spark.range(3000).selectExpr("id % 40 AS doc_id", "concat('text ', id) AS text").repartition(7)
    table = write_shards(docs, 2000, path)
    sizes = {r.shard: (r.shard_bytes, r.shard_rows) for r in table.collect()}
    read = spark.read.schema("doc_id long, text string, shard string").parquet(path)
    found = {r.shard[1:]: (r.b, r.n) for r in read.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert found == sizes and read.select("text").distinct().count() == 3000
