"""Signal A: severity of the anchor text that a ticket resembles most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from prioscope.functions.levels import best_level
from prioscope.functions.numbers import rounded
from prioscope.operators.grams import named_terms, run_postings, term_rows
from prioscope.functions.vectors import cosine, norm
from prioscope.sources.staging import (
    RUN_ROWS, TEXT_GROUP, TEXT_KEY, TEXT_ROW, distinct_texts, kept, numbered_rows, run_col, text_rows, with_row_results, with_text_results,
)
from prioscope.settings import FULL, LEVELS, Profile

MAX_COMMON_TERMS = 200_000
SOFTMAX_FACTOR = 10.0
ROW = "_ticket_row"
COPIES = "_copies"
_SIDES = [f"anchor_{level.lower()}" for level in LEVELS]


def anchor_table(spark, profile: Profile = FULL) -> DataFrame:
    rows = [(level, i, s) for level in LEVELS for i, s in enumerate(profile.anchors[level])]
    return spark.createDataFrame(rows, "level string, position int, sentence string")


# --- term weights ---------------------------------------------------------------


def term_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(term, documents): the terms of ``df`` and how many of its rows hold them, added up over the rows of a slice."""
    return named_terms(df, text_col, longest=2, shortest=2).select("term", "documents")


def anchor_counts(spark, profile: Profile = FULL, hashed: bool = False) -> DataFrame:
    """Term counts of the four anchor documents, one column per level. ``hashed`` names terms as ``run_postings`` does."""
    joined = [(level, " ".join(profile.anchors[level])) for level in LEVELS]
    documents = spark.createDataFrame(joined, "level string, text string").coalesce(1)
    found = term_rows(documents, ["level"], "text", longest=2, shortest=2)
    if hashed:
        names = named_terms(documents, "text", longest=2, shortest=2).groupBy("term").agg(F.first("hash").alias("hash"))
        found = found.join(names, "term").select("level", F.col("hash").alias("term"), "tf")
    sides = [F.coalesce(F.sum(F.when(F.col("level") == level, F.col("tf"))), F.lit(0)).cast("long").alias(side) for level, side in zip(LEVELS, _SIDES)]
    return found.groupBy("term").agg(*sides)


def document_frequency(terms: DataFrame, anchors: DataFrame, documents: Column | None = None) -> DataFrame:
    """Documents per term, the four anchor documents included; a row of ``terms`` stands for one or ``documents``."""
    in_anchors = reduce(lambda a, b: a + b, [(F.col(s) > 0).cast("long") for s in _SIDES])
    return (
        terms.select("term", (F.lit(1) if documents is None else documents).cast("long").alias("n"))
        .unionByName(anchors.select("term", in_anchors.alias("n")))
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
    )


def inverse_frequency(df_col: Column, documents: Column) -> Column:
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def anchor_weights(anchors: DataFrame, frequency: DataFrame, documents: Column) -> DataFrame:
    """Unit-length weight of every anchor term on each level."""
    weighted = frequency.join(F.broadcast(anchors), "term").select(
        "term",
        *[(F.col(s) * inverse_frequency(F.col("df"), documents)).alias(s) for s in _SIDES],
    )
    whole = Window.partitionBy()
    return weighted.select(
        "term",
        *[(F.col(s) / F.sqrt(F.sum(F.col(s) * F.col(s)).over(whole))).alias(s) for s in _SIDES],
    )


def fit_vocabulary(df: DataFrame, text_col: str = "combined_text", profile: Profile = FULL) -> DataFrame:
    """Document frequency of every term of the anchors and of ``df``, written to storage."""
    return kept(document_frequency(term_counts(df, text_col), anchor_counts(df.sparkSession, profile), F.col("documents")), "vocabulary")


def tfidf_similarity(
    df: DataFrame, row_col: str, text_col: str = "combined_text", profile: Profile = FULL, count_col: str | None = None
) -> DataFrame:
    """(row_col, one cosine per anchor text) of each row, fitted on anchors plus ``df``; rows without terms are left out.

    With ``count_col`` a row stands for so many documents with its text. ``df`` comes from ``numbered_rows`` by ``row_col``. A text is cut into words once; its terms are counted in
    slices of rows as hashes. Rows of a run that hold a term equally often share one posting, which names them by a
    bit each, so neighbours with like texts cost little more than one; a run that two slices share has
    two postings, and nothing is shuffled for it. Terms split by how common they are. A term is common if it is in at
    least ``postings / 200,000`` documents; there can be no more than 200,000 of those, so they
    are broadcast and their weights are summed where the run lies. The rest are rare: only those postings
    move to look up their frequency, and no key of that join is hot. Weights are summed by set of rows
    before they are dealt to the rows.
    """
    spark = df.sparkSession
    run, place = run_col(row_col), F.col(row_col).bitwiseAND(F.lit(RUN_ROWS - 1)).cast("int")
    copies = (F.col(count_col) if count_col else F.lit(1)).cast("long")
    terms = kept(run_postings(df, F.col(run), place, copies, text_col, longest=2, shortest=2).withColumnRenamed("run", run), "run-terms")
    anchors = kept(anchor_counts(spark, profile, hashed=True), "anchor-terms")
    frequency = kept(document_frequency(terms, anchors, F.col("documents")), "vocabulary")
    documents = df.agg((F.coalesce(F.sum(copies), F.lit(0)) + len(LEVELS)).alias("n")).scalar()
    limit = frequency.agg(F.greatest(F.sum("df") / MAX_COMMON_TERMS, F.lit(2.0))).scalar()

    weights = anchor_weights(anchors, frequency, documents)
    common = kept(
        frequency.join(F.broadcast(weights), "term", "left")
        .where((F.col("df") >= limit) | F.col(_SIDES[0]).isNotNull())
        .select("term", inverse_frequency(F.col("df"), documents).alias("idf"), *_SIDES),
        "common-terms",
    )
    rare = frequency.where(F.col("df") < limit).select("term", inverse_frequency(F.col("df"), documents).alias("idf"))

    weight = F.col("tf") * F.col("idf")
    near = terms.join(F.broadcast(common), "term").select(run, "rows", (weight * weight).alias("square"), *[(weight * F.col(s)).alias(s) for s in _SIDES])
    far = (
        terms.join(F.broadcast(common.select("term")), "term", "left_anti")
        .join(rare, "term")
        .select(run, "rows", (weight * weight).alias("square"), *[F.lit(None).cast("double").alias(s) for s in _SIDES])
    )
    sums = [F.sum("square").alias("square"), *[F.sum(s).alias(s) for s in _SIDES]]
    members = F.filter(F.sequence(F.lit(0), F.lit(RUN_ROWS - 1)), lambda i: F.getbit(F.col("rows"), i) == 1)
    by_rows = near.unionByName(far).groupBy(run, "rows").agg(*sums)
    return (
        by_rows.select((F.col(run) * RUN_ROWS).alias("first"), F.explode(members).alias("place"), "square", *_SIDES)
        .groupBy((F.col("first") + F.col("place")).alias(row_col))
        .agg(*sums)
        .select(row_col, *[F.round(F.coalesce(F.col(s), F.lit(0.0)) / F.sqrt("square"), 12).alias(s) for s in _SIDES])
    )


# --- dense vectors ----------------------------------------------------------------


def mean_vectors(df: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """Mean vector per group; partial averages keep a large group off a single task."""
    return (
        df.select(group_col, F.posexplode(vector_col).alias("pos", "x"))
        .groupBy(group_col, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(group_col)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("items"))
        .select(group_col, F.transform("items", lambda item: item["x"]).alias("anchor"))
    )


def vector_similarity(df: DataFrame, vector_col: str, anchors: DataFrame) -> DataFrame:
    """Add ``similarities``: one struct per anchor row, in rank order, read from a one-row table.

    ``anchors`` has ``rank int, level string, anchor array<double>`` and one row per level.
    """
    packed = anchors.agg(
        F.sort_array(F.collect_list(F.struct("rank", "level", "anchor"))).alias("anchors")
    ).select(
        F.transform(
            "anchors",
            lambda a: F.struct(
                a["rank"].alias("rank"), a["level"].alias("level"), a["anchor"].alias("anchor"),
                norm(a["anchor"]).alias("length"),
            ),
        ).alias("anchors")
    )
    ready = df.withColumns({"_anchors": packed.scalar(), "_length": norm(F.col(vector_col))})
    similar = F.transform(
        F.col("_anchors"),
        lambda a: F.struct(
            cosine(F.col(vector_col), a["anchor"], F.col("_length"), a["length"]).alias("similarity"),
            (-a["rank"]).alias("tie"),
            a["level"].alias("level"),
        ),
    )
    return ready.withColumn("similarities", similar).drop("_anchors", "_length")


def nearest_level(similarities: Column) -> Column:
    """Level of the highest similarity; ties go to the lower rank."""
    return F.array_max(similarities)["level"]


def softmax_confidence(similarities: Column) -> Column:
    powers = F.transform(similarities, lambda s: F.exp(s["similarity"] * SOFTMAX_FACTOR))
    return rounded(F.array_max(powers) / F.aggregate(powers, F.lit(0.0), lambda t, x: t + x), 4)


# --- the signal ---------------------------------------------------------------------


def semantic_signal(
    df: DataFrame,
    mode: str = "tfidf",
    text_col: str = "combined_text",
    row_col: str | None = None,
    vector_col: str | None = None,
    anchors: DataFrame | None = None,
    profile: Profile = FULL,
    count_col: str | None = None,
) -> DataFrame:
    """Add ``semantic_severity`` and ``semantic_score``.

    ``tfidf`` compares texts, ``embedding`` compares a vector column with ``anchors``,
    ``rule`` copies signal C at nine tenths of its score. For ``tfidf``, rows of a table from
    ``numbered_rows`` are not moved again if ``row_col`` names their number, and ``count_col`` says how many documents
    each stands for; of other tables the distinct texts are stored that way first.
    """
    if mode == "rule":
        return df.withColumns(
            {"semantic_severity": F.col("rule_severity"), "semantic_score": F.col("rule_score") * 0.9}
        )
    if mode == "embedding":
        compared = vector_similarity(df, vector_col, anchors)
        return compared.select(
            *df.columns,
            nearest_level(F.col("similarities")).alias("semantic_severity"),
            softmax_confidence(F.col("similarities")).alias("semantic_score"),
        )
    if mode != "tfidf":
        raise ValueError(f"unknown mode {mode!r}")
    if not row_col:
        rows = df if TEXT_KEY in df.columns else text_rows(df, text_col, "rows")
        names = [c for c in df.columns if c not in (TEXT_KEY, TEXT_ROW, TEXT_GROUP)]
        scored = semantic_signal(numbered_texts(rows, text_col), mode, text_col, row_col=ROW, profile=profile, count_col=COPIES)
        return with_text_results(rows, scored.select(TEXT_KEY, "semantic_severity", "semantic_score")).select(*names, "semantic_severity", "semantic_score")
    scores = {level: F.col(side) for level, side in zip(LEVELS, _SIDES)}
    picked = tfidf_similarity(df, row_col, text_col, profile, count_col).select(
        row_col,
        best_level(scores, prefer_severe=False).alias("semantic_severity"),
        F.greatest(*_SIDES).alias("semantic_score"),
    )
    joined = with_row_results(df, picked, row_col).select(*df.columns, "semantic_severity", "semantic_score")
    return joined.na.fill({"semantic_severity": LEVELS[0], "semantic_score": 0.0})


def numbered_texts(rows: DataFrame, text_col: str) -> DataFrame:
    """The distinct texts of ``text_rows`` as ``numbered_rows`` by ``ROW``, ``COPIES`` documents each, in the order in which their rows lay."""
    texts = distinct_texts(rows, text_col, COPIES).drop(TEXT_GROUP).sortWithinPartitions(TEXT_ROW)
    return numbered_rows(texts, ROW, "texts")


def embed_texts(df: DataFrame, text_col: str, make_predict_fn, vector_col: str = "embedding", batch_size: int = 64) -> DataFrame:
    """Add a vector column from a user-supplied model that runs in batches on the workers."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(vector_col, encode(F.col(text_col)))
