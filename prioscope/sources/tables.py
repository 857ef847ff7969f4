"""A raw ticket table joined from business tables.

Every order is a ticket. Its text opens with a phrase of the bank and goes on with
one whole conversation turn; its hours come from an event, its product from a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prioscope.sources.phrases import CHANNELS, OPENINGS, TYPES


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _pick(names: list[str], position: Column) -> Column:
    return F.array(*[F.lit(n) for n in names])[position.cast("int")]


def opening_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *opening) for k, opening in enumerate(OPENINGS)]
    return spark.createDataFrame(rows, "k int, opening_subject string, phrase string, base_hours double")


def ticket_table(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tickets, with the gaps and bad values that cleaning has to handle."""
    key = F.col("o_orderkey")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    events = read(spark, folder, "events").select("event_id", "value")
    parts = read(spark, folder, "part").select("p_partkey", "p_type")
    customers = read(spark, folder, "customer").select("c_custkey", "c_name")

    n_events = events.agg(F.count(F.lit(1))).scalar()
    n_parts = parts.agg(F.count(F.lit(1))).scalar()
    n_talks = turns.agg(F.max("conv_id") + 1).scalar()
    lengths = turns.groupBy(F.col("conv_id").alias("talk")).agg(F.count(F.lit(1)).alias("n_turns"))

    keyed = orders.withColumns(
        {
            "k": (key % len(OPENINGS)).cast("int"),
            "talk": F.col("o_custkey") % n_talks,
            "event": key % n_events,
            "part": key % n_parts,
        }
    )
    # Narrow lookups first, texts last, so that no text is moved more than once. An order
    # without a partner in one of them is a ticket with a gap there. The merge spreads the
    # tickets over tasks and leaves those with the same text side by side.
    joined = (
        keyed.join(events, F.col("event_id") == F.col("event"), "left")
        .join(parts, F.col("p_partkey") == F.col("part"), "left")
        .join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(lengths, "talk", "left")
        .withColumn("step", key % F.col("n_turns"))
        .join(turns.hint("merge"), (F.col("conv_id") == F.col("talk")) & (F.col("turn") == F.col("step")), "left")
        .join(F.broadcast(opening_table(spark)), "k")
    )
    exact = F.col("base_hours") * (F.lit(0.5) + F.col("value") / 70)
    hours = F.floor(exact * 100 + 0.5) / 100
    return joined.select(
        F.format_string("TKT-%05d", key + 1).alias("ticket_id"),
        F.when(key % 101 != 0, F.col("opening_subject")).alias("subject"),
        F.when(key % 103 != 0, F.concat_ws(" ", "phrase", "text")).alias("description"),
        F.regexp_replace("o_orderpriority", "^[0-9]+-", "").alias("priority"),
        F.when(key % 97 == 0, None)
        .when(key % 89 == 0, "n/a")
        .when(key % 83 == 0, "12 hours")
        .when(key % 79 == 0, "-3")
        .when(key % 73 == 0, "0")
        .when(key % 71 == 0, " 1e1 ")
        .otherwise(hours.cast("string"))
        .alias("resolution_time"),
        F.when(key % 53 != 0, _pick(CHANNELS, F.col("o_custkey") % 5)).alias("channel"),
        F.when(key % 59 != 0, _pick(TYPES, F.floor(key / 200) % 5)).alias("ticket_type"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias(
            "customer_email"
        ),
        F.col("p_type").alias("product"),
        key.alias("ticket_key"),
    )
