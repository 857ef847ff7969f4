"""Queries on fitted models score each row once."""

from pyspark.sql import functions as F

from prioscope.plans import catalog
from prioscope.streaming import score as streams


class _Given:
    """A model whose prediction counts the rows that it is asked for."""

    def __init__(self, seen):
        self.seen = seen

    def predict(self, df):
        seen = self.seen
        return df.withColumns({"prediction": F.col("label"), "mismatch_probability": F.udf(lambda x: seen.add(1) or x, "double")(F.col("p"))})


def test_report_reads_stored_predictions(spark, monkeypatch):
    rows = spark.createDataFrame([(f"t{i}", i % 2, 0.1 + 0.8 * (i % 2)) for i in range(40)], "ticket_id string, label int, p double")
    asked = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(catalog, "_text_model", lambda *_: _Given(asked))
    monkeypatch.setattr(catalog, "_parts", lambda *_: {"test": rows})
    report = catalog.mo1_text_model_report(spark, "unused").first()
    assert (report.n_samples, report.n_mismatch, report.ranks_better_than_chance) == (40, 20, True) and asked.value == 40


def test_few_arriving_files_are_scored_on_all_cores(spark, tmp_path):
    folder, cores = str(tmp_path / "in"), spark.sparkContext.defaultParallelism
    spark.range(400, numPartitions=1).selectExpr("concat('t', id) AS ticket_id", "'down' AS subject").write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    for files, parts in ((1, cores), (cores, 1), (None, 1)):
        seen, rows = [], streams.read_ticket_stream(spark, folder, "parquet", schema, files_per_batch=files)
        note = lambda batch, _: seen.append([len(p) for p in batch.rdd.glom().collect()])
        run = rows.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / f"state-{files}")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert len(seen) == 1 and sum(seen[0]) == 400 and len([n for n in seen[0] if n]) == parts
