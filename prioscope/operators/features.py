"""Feature tables of the classifiers: weighted n-grams and four metadata columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prioscope.functions.levels import band
from prioscope.functions.text import plain_words, word_ngrams, word_tokens
from prioscope.functions.vectors import sparse_vector
from prioscope.operators.grams import TermIndex, hashed_counts, in_rows, named_terms, slices
from prioscope.operators.ordering import number_values, running_sums
from prioscope.settings import (
    DEFAULT_HOURS, FULL, MAX_NGRAM, MAX_TERMS, MIN_DOCUMENTS, Profile, RESOLUTION_TOKENS,
)
from prioscope.sources.staging import kept

#: Cells of the first count, and how many of them per wanted term are counted exactly at first.
COUNT_CELLS, FIRST_CELLS = 1 << 20, 3
META = ["channel_code", "type_code", "log_hours", "text_length"]


# --- text ------------------------------------------------------------------------


def with_grams(df: DataFrame, text_col: str = "combined_text", profile: Profile = FULL) -> DataFrame:
    """Add ``grams``: every run of one to three words."""
    tokens = df.withColumn("_tokens", word_tokens(F.col(text_col), profile.shortest_token))
    return tokens.withColumn("grams", word_ngrams(F.col("_tokens"), MAX_NGRAM)).drop("_tokens")


def vocabulary(
    df: DataFrame, text_col: str = "combined_text", profile: Profile = FULL, size: int = MAX_TERMS, min_documents: int = MIN_DOCUMENTS,
    cells: int = COUNT_CELLS, count_col: str | None = None,
) -> DataFrame:
    """The most used terms that occur in enough documents, at most ``size`` rows. With ``count_col`` a row stands for so many documents.

    First every term adds its count to one of ``cells`` cells, so a cell's total is never below the
    count of a term in it, and what is shuffled is a table of fixed size per task. Then only terms of the fullest
    cells are counted one by one, within their slices of rows first. The count that the last place needs among those is a
    lower bound of the true one; if no other cell reaches it, no winner is lost. Otherwise all cells that reach
    it are counted. Terms are told apart by 64-bit hashes. Texts are cut into words once; after
    that only one text per winner is looked at, to put the winner's words together.
    """
    text = (text_col, MAX_NGRAM, profile.shortest_token)
    copies = F.col(count_col) if count_col else F.lit(1)
    terms = kept(hashed_counts(df, *text, copies), "term-counts")
    cell = F.pmod("term", F.lit(cells))
    totals = kept(terms.groupBy(cell.alias("cell")).agg(F.sum("term_count").alias("total")), "cells")
    least = _reached(totals, "total", FIRST_CELLS * size)
    while True:
        full = totals.where(F.col("total") >= least).select("cell")
        counted = (
            terms.withColumn("cell", cell)
            .join(F.broadcast(full), "cell", "left_semi")  # at most ``cells`` numbers
            .groupBy("term")
            .agg(F.sum("term_count").alias("term_count"), F.sum("document_count").alias("document_count"), F.min("example").alias("example"))
        )
        usable = kept(counted.where(F.col("document_count") >= min_documents), "usable")
        cut = _reached(usable, "term_count", size)
        if cut >= least or totals.where((F.col("total") >= max(cut, 1)) & (F.col("total") < least)).isEmpty():
            break
        least = max(cut, 1)
    winners = kept(usable.where(F.col("term_count") >= cut).withColumnRenamed("term", "hash"), "winners")
    keyed = df.select(text_col, F.xxhash64(text_col).alias("example"))
    shown = keyed.join(winners.select("example").distinct(), "example", "left_semi").select(text_col).distinct()
    named = named_terms(shown, *text).join(winners.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.min("term").alias("term"))
    return winners.join(named, "hash").select("term", "term_count", "document_count").orderBy(F.desc("term_count"), "term").limit(size)


def _reached(counts: DataFrame, column: str, places: int) -> int:
    """The largest number that at least ``places`` rows reach, 0 if there are fewer rows."""
    levels = counts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(levels, column, ["n"])
    return placed.agg(F.coalesce(F.max(F.when(F.col("all_n") - F.col("before_n") >= places, F.col(column))), F.lit(0)).alias("cut")).first().cut


def smoothed_idf(document_count: Column, documents: Column) -> Column:
    return F.log((1 + documents) / (1 + document_count)) + 1


def sublinear(tf: Column) -> Column:
    return 1 + F.log(tf)


# --- metadata -----------------------------------------------------------------------


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct values, alphabetical codes from 0, stored. Any number of values will do."""
    known = df.select(F.coalesce(F.col(column), F.lit("Unknown")).alias("value"))
    return kept(number_values(known, "value", "code"), "codes")


def with_code(df: DataFrame, column: str, codes: DataFrame, out_col: str) -> DataFrame:
    """Add the code of a value; one not seen in training takes the first."""
    named = codes.select(F.col("value").alias("_value"), F.col("code").cast("double").alias(out_col))
    joined = df.join(named, F.coalesce(F.col(column), F.lit("Unknown")) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(out_col, F.coalesce(out_col, F.lit(0.0)))


def with_metadata(df: DataFrame, channels: DataFrame, types: DataFrame, text_col: str = "combined_text") -> DataFrame:
    """Add the four columns. The log of hours at or below -1 is undefined and reads as 0."""
    hours = F.coalesce(F.col("resolution_hours"), F.lit(DEFAULT_HOURS)).cast("double")
    coded = with_code(with_code(df, "channel", channels, "channel_code"), "ticket_type", types, "type_code")
    return coded.withColumns(
        {
            "log_hours": F.when(hours > -1, F.log1p(hours)).otherwise(F.lit(0.0)),
            "text_length": F.length(text_col) / F.lit(1000.0),
        }
    )


def meta_moments(df: DataFrame) -> DataFrame:
    """Mean and population deviation of the four columns; a constant column gets deviation 1."""
    found = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in META], *[F.stddev_pop(c).alias(f"{c}_std") for c in META]
    )
    return found.withColumns(
        {f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in META}
    )


def standardise(df: DataFrame, moments: DataFrame) -> DataFrame:
    row = moments.select(F.struct(*moments.columns).alias("m")).scalar()
    scaled = {c: (F.col(c) - F.col(f"_m.{c}_mean")) / F.col(f"_m.{c}_std") for c in META}
    return df.withColumn("_m", row).withColumns(scaled).drop("_m")


# --- vectors -------------------------------------------------------------------------


def text_weights(
    df: DataFrame, terms: list[str], idf: list[float], text_col: str = "combined_text", profile: Profile = FULL,
    coefficients: list[float] | None = None,
) -> DataFrame:
    """Add ``text_indices`` and ``text_values``: sublinear counts times idf, unit length. No shuffle; texts are looked at in slices.

    With ``coefficients`` per term, ``text_score`` is the sum of the values times theirs.
    """
    index, shortest, by, words = TermIndex(terms), profile.shortest_token, np.array(idf, dtype=float), plain_words(F.col(text_col))

    def weighed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for _, part in slices(texts):
            row, place, n = in_rows(*index.found(part, shortest), len(terms))
            weight = (1 + np.log(n)) * by[place]
            square = np.bincount(row, weights=weight * weight, minlength=len(part))
            yield len(part), row, place, weight / np.sqrt(square)[row]

    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [*weighed(texts)]
            sizes = [np.bincount(row, minlength=n) for n, row, _, _ in parts]
            ends = pa.array(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32))
            places, values = (np.concatenate([np.zeros(0), *[p[i] for p in parts]]) for i in (2, 3))
            lists = [pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))]
            yield pa.StructArray.from_arrays(lists, names=["indices", "values"])

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sums = [np.bincount(row, weights=value * factor[place], minlength=n) for n, row, place, value in weighed(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *sums]))

    found = F.arrow_udf(weights, "indices array<int>, values array<double>")(words)
    done = df.withColumn("_found", found).withColumns({"text_indices": F.col("_found.indices"), "text_values": F.col("_found.values")}).drop("_found")
    if coefficients is not None:
        factor = np.array(coefficients, dtype=float)
        done = done.withColumn("text_score", F.arrow_udf(score, "double")(words))
    return done


def feature_vector(width: int) -> Column:
    """Text weights and standardised metadata as one sparse vector, for training."""
    places = F.array(*[F.lit(width + i) for i in range(len(META))])
    return sparse_vector(F.lit(width + len(META)), F.concat("text_indices", places), F.concat("text_values", F.array(*META)))


def meta_score(coefficients: list[float], intercept: float) -> Column:
    """Metadata times their coefficients, and the intercept."""
    total = F.lit(float(intercept))
    for name, weight in zip(META, coefficients):
        total = total + F.col(name) * float(weight)
    return total


# --- class weights and model strings ---------------------------------------------------


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """rows / (classes * rows of the class). One row per class."""
    counted = class_distribution(df, label_col)
    total = counted.agg(F.sum("n")).scalar()
    classes = counted.agg(F.count(F.lit(1))).scalar()
    return counted.select(label_col, "n", (total / (classes * F.col("n"))).alias("class_weight"))


def with_class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    weights = class_weights(df, label_col).select(label_col, "class_weight")
    return df.join(F.broadcast(weights), label_col)


def resolution_token(hours: Column) -> Column:
    return band(hours, RESOLUTION_TOKENS)


def model_text(df: DataFrame, separator: str = "[SEP]", out_col: str = "model_text") -> DataFrame:
    """Metadata tags followed by subject and description."""
    tags = F.concat(
        F.lit("[CHANNEL: "), F.col("channel"), F.lit("] [TYPE: "), F.col("ticket_type"),
        F.lit("] [RT: "), resolution_token(F.col("resolution_hours")), F.lit("]"),
    )
    return df.withColumn(out_col, F.concat_ws(" ", tags, "subject", F.lit(separator), "description"))
