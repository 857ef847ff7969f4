"""One runnable query per operator, over the tables of a folder."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from prioscope.functions import text as T
from prioscope.functions.levels import best_level
from prioscope.functions.numbers import to_hours
from prioscope.operators import (
    breakdowns, classify, cleaning, dashboard, evaluate, evidence, features, fusion, ordering, profiling, quantile_state,
    rule_signal as rules, splitting, text_signal as texts, time_signal as times,
)
from prioscope.plans.audit import audit_batch, audit_fast, audit_rows, label_tickets, once_per_text
from prioscope.settings import (
    COMPACT, FULL, LEVELS, CRITICAL_WORDS, ESCALATION_PHRASES, IMPACT_PATTERNS, QUANTIFIER_PATTERNS,
)
from prioscope.sources import files
from prioscope.sources.staging import TEXT_GROUP, TEXT_KEY, TEXT_ROW, distinct_texts, fresh_path, kept, shared_folder, staged, staged_text_rows, with_text_results
from prioscope.sources.tables import read, ticket_table
from prioscope.streaming import score as streams

QUERIES: dict = {}


def query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


# --- tables that several queries start from ------------------------------------------------
# Tickets are written as the join with the texts leaves them, those with the same turn side by side. No later
# table moves them, so all are spread alike and like texts compress.


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "tickets", lambda: ticket_table(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "clean", lambda: cleaning.clean_tickets(tickets(spark, folder)))


def by_text(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned tickets bucketed by their texts, for scores of texts."""
    return staged_text_rows(spark, folder, "by-text", lambda: clean(spark, folder), "combined_text")


def labeled(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "labeled", lambda: label_tickets(by_text(spark, folder)))


def audited(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "audited", lambda: audit_fast(by_text(spark, folder)))


def work_folder(spark: SparkSession, folder: str, name: str) -> str:
    mark = hashlib.sha256(folder.encode()).hexdigest()[:12]
    return f"{shared_folder(spark)}/prioscope/{spark.sparkContext.applicationId}/work-{mark}/{name}"


def _round(df: DataFrame, decimals: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals) for c in columns})


# --- sources and sinks ------------------------------------------------------------------------


@query("sc1_read_csv")
def sc1_read_csv(spark, d):
    path = work_folder(spark, d, "tickets-csv")
    files.write_csv(cleaning.to_source_names(tickets(spark, d)), path)
    return cleaning.to_internal_names(files.read_ticket_csv(spark, path)).withColumn(
        "ticket_key", F.col("ticket_key").cast("long")
    )


@query("sc3_audit_uploaded_files")
def sc3_audit_uploaded_files(spark, d):
    path = work_folder(spark, d, "uploaded")
    files.write_csv(cleaning.to_source_names(tickets(spark, d).drop("ticket_key")), path)
    raw = files.read_ticket_csv(spark, path)
    return files.display_columns(audit_batch(raw).audited)


@query("sc4_ticket_table")
def sc4_ticket_table(spark, d):
    return ticket_table(spark, d)


@query("sk1_cleaned_table")
def sk1_cleaned_table(spark, d):
    path = work_folder(spark, d, "cleaned")
    files.write_table(cleaning.clean_tickets(tickets(spark, d)), path)
    return _round(spark.read.parquet(path), 6, "resolution_hours")


@query("sk2_labeled_csv")
def sk2_labeled_csv(spark, d):
    path = work_folder(spark, d, "labeled-csv")
    files.write_csv(labeled(spark, d), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return back.select(
        "ticket_id", "inferred_severity", "mismatch_label", F.col("severity_delta").cast("int").alias("severity_delta"),
        F.get_json_object("rule_features", "$.escalation_hits").cast("int").alias("escalation_hits"),
    )


@query("sk2_signal_tables")
def sk2_signal_tables(spark, d):
    path = work_folder(spark, d, "signal-tables")
    done = labeled(spark, d)
    files.write_csv(fusion.pairwise_agreement(done), f"{path}/ablation")
    files.write_csv(fusion.decisive_votes(done), f"{path}/contribution")
    pairs = spark.read.csv(f"{path}/ablation", header=True).select(
        F.col("signal_pair").alias("name"), F.col("agreement_rate").cast("double").alias("value")
    )
    alone = spark.read.csv(f"{path}/contribution", header=True).select(
        F.col("signal").alias("name"), F.col("contribution_percent").cast("double").alias("value")
    )
    return pairs.unionByName(alone)


@query("sk3_prediction_columns")
def sk3_prediction_columns(spark, d):
    path = work_folder(spark, d, "predictions")
    files.write_predictions(audit_batch(tickets(spark, d)).audited, path)
    back = cleaning.to_internal_names(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    return back.withColumns(
        {
            "mismatch_probability": F.col("mismatch_probability").cast("double"),
            "severity_delta": F.col("severity_delta").cast("int"),
            "subject": F.coalesce("subject", F.lit("")),
            "mismatch_type": F.coalesce("mismatch_type", F.lit("")),
        }
    )


@query("sk4_evidence_json")
def sk4_evidence_json(spark, d):
    path = work_folder(spark, d, "dossiers")
    files.write_json(evidence.evidence_records(audited(spark, d)), path)
    back = spark.read.json(path)
    return back.select(
        "ticket_id", "confidence", "constraint_analysis", F.size("feature_evidence").alias("items")
    )


def _quality_table(spark, d) -> DataFrame:
    """Quality against a guess from the text length: a second evaluation table."""
    documents = read(spark, d, "documents").select("doc_id", "n_chars")
    chance = F.round(1 / (1 + F.col("n_chars") / 1500.0), 2)
    joined = read(spark, d, "labels").join(documents, "doc_id")
    return joined.select(
        "doc_id", F.col("quality").alias("label"), chance.alias("probability"),
        (chance >= 0.5).cast("int").alias("prediction"),
    )


def _flat_report(report: DataFrame) -> DataFrame:
    sides = {"consistent": "Consistent", "mismatch": "Mismatch"}
    return report.select(
        "model_name", "n_samples", "n_mismatch", "mismatch_rate", "accuracy", "macro_f1",
        *[
            F.col(f"per_class.{side}.{m}").alias(f"{low}_{m}")
            for low, side in sides.items()
            for m in ("precision", "recall", "f1", "support")
        ],
        F.element_at(F.element_at("confusion_matrix", 1), 2).alias("fp"),
        F.element_at(F.element_at("confusion_matrix", 2), 1).alias("fn"),
        "roc_auc", "thresholds.accuracy_pass", "thresholds.macro_f1_pass",
        "thresholds.consistent_recall_pass", "thresholds.mismatch_recall_pass", "overall_pass",
    )


@query("sk5_report_json")
def sk5_report_json(spark, d):
    path = work_folder(spark, d, "report")
    files.write_json(evaluate.evaluate(_quality_table(spark, d), "By length", score="probability"), path)
    return _flat_report(spark.read.json(path))


@query("sk6_agreement_json")
def sk6_agreement_json(spark, d):
    path = work_folder(spark, d, "agreement")
    files.write_json(fusion.signal_agreement(labeled(spark, d)), path)
    return spark.read.json(path)


@query("sk8_display_columns")
def sk8_display_columns(spark, d):
    return files.display_columns(audited(spark, d))


# --- cleaning -------------------------------------------------------------------------------------


@query("cl1_ticket_ids")
def cl1_ticket_ids(spark, d):
    bare = tickets(spark, d).drop("ticket_id")
    return cleaning.with_ticket_ids(bare, "ticket_key").select("ticket_key", "ticket_id")


@query("cl2_clean_text")
def cl2_clean_text(spark, d):
    raw = tickets(spark, d)
    return raw.select(
        "ticket_id", cleaning.clean_text(raw, "subject").alias("subject"),
        cleaning.clean_text(raw, "description").alias("description"),
    )


@query("cl3_capitalize")
def cl3_capitalize(spark, d):
    return tickets(spark, d).select("ticket_id", T.capitalize(T.strip(F.col("priority"))).alias("priority"))


@query("cl4_synonyms")
def cl4_synonyms(spark, d):
    return tickets(spark, d).select("ticket_id", cleaning.standard_priority(F.col("priority")).alias("priority"))


@query("cl5_valid_priorities")
def cl5_valid_priorities(spark, d):
    return cleaning.keep_valid_priorities(tickets(spark, d)).select("ticket_id", "priority")


@query("cl6_parse_hours")
def cl6_parse_hours(spark, d):
    return tickets(spark, d).select("ticket_id", to_hours(F.col("resolution_time"), "string").alias("hours"))


@query("cl7_fill_hours")
def cl7_fill_hours(spark, d):
    filled = cleaning.fill_hours(cleaning.keep_valid_priorities(tickets(spark, d)))
    return _round(filled.select("ticket_id", "resolution_hours"), 6, "resolution_hours")


@query("cl8_optional_columns")
def cl8_optional_columns(spark, d):
    raw = tickets(spark, d)
    return raw.select("ticket_id", *[cleaning.clean_optional(raw, c).alias(c) for c in cleaning.OPTIONAL_COLUMNS])


@query("cl9_combined_text")
def cl9_combined_text(spark, d):
    raw = tickets(spark, d)
    both = cleaning.combined_text(cleaning.clean_text(raw, "subject"), cleaning.clean_text(raw, "description"))
    return raw.select("ticket_id", both.alias("combined_text"))


@query("cl10_row_counts")
def cl10_row_counts(spark, d):
    return cleaning.cleaning_counts(tickets(spark, d))


@query("cl11_short_cases")
def cl11_short_cases(spark, d):
    return cleaning.keep_short_cases(clean(spark, d)).select("ticket_id", F.round("resolution_hours", 6).alias("resolution_hours"))


@query("cl12_type_for_display")
def cl12_type_for_display(spark, d):
    return audited(spark, d).select("ticket_id", cleaning.type_for_display(F.col("mismatch_type")).alias("mismatch_type"))


@query("cl13_preview")
def cl13_preview(spark, d):
    return cleaning.preview(clean(spark, d).select("ticket_key", "ticket_id", "subject", "priority"), "ticket_key")


# --- rule signal -------------------------------------------------------------------------------------


@query("ru1_normalised_text")
def ru1_normalised_text(spark, d):
    whole = F.concat_ws(" ", "subject", "description")
    return tickets(spark, d).select("ticket_id", T.normalise(whole).alias("t"))


@query("ru2_negation_aware_hits")
def ru2_negation_aware_hits(spark, d):
    prepared = clean(spark, d).select("ticket_id", T.normalise(F.col("combined_text")).alias("t"))
    return rules.weighted_hits(prepared, "t", {"hits": CRITICAL_WORDS}).select("ticket_id", "hits")


def _features(spark, d) -> DataFrame:
    """Features of each ticket; every text is looked at once."""
    rows = by_text(spark, d).select("ticket_id", "combined_text", TEXT_KEY, TEXT_ROW, TEXT_GROUP)
    return once_per_text(rows, rules.with_rule_features)


@query("ru3_lexicon_features")
def ru3_lexicon_features(spark, d):
    return _features(spark, d).select("ticket_id", *rules.KEYWORD_FEATURES)


@query("ru4_escalation")
def ru4_escalation(spark, d):
    found = T.keyword_hits(T.normalise(F.col("combined_text")), ESCALATION_PHRASES)
    return clean(spark, d).select("ticket_id", F.size(F.array_distinct(found)).alias("escalation_hits"))


@query("ru5_business_impact")
def ru5_business_impact(spark, d):
    text = T.normalise(F.col("combined_text"))
    return clean(spark, d).select("ticket_id", T.count_present_patterns(text, IMPACT_PATTERNS).alias("business_impact_hits"))


@query("ru6_quantifiers")
def ru6_quantifiers(spark, d):
    text = T.normalise(F.col("combined_text"))
    return clean(spark, d).select("ticket_id", T.count_present_patterns(text, QUANTIFIER_PATTERNS).alias("quantifier_hits"))


def _raw_text(spark, d) -> DataFrame:
    return tickets(spark, d).select("ticket_id", F.concat_ws(" ", "subject", "description").alias("raw_text"))


@query("ru7_capital_words")
def ru7_capital_words(spark, d):
    return _raw_text(spark, d).select("ticket_id", T.count_capital_words(F.col("raw_text")).alias("caps_word_count"))


@query("ru8_exclamation_marks")
def ru8_exclamation_marks(spark, d):
    return _raw_text(spark, d).select("ticket_id", T.count_character(F.col("raw_text"), "!").alias("exclamation_count"))


@query("ru9_text_length")
def ru9_text_length(spark, d):
    return _round(_features(spark, d).select("ticket_id", "text_length_norm"), 6, "text_length_norm")


_SCORES = [f"score_{level.lower()}" for level in LEVELS]


@query("ru10_level_scores")
def ru10_level_scores(spark, d):
    return _round(rules.with_level_scores(_features(spark, d)).select("ticket_id", *_SCORES), 6, *_SCORES)


@query("ru11_best_level")
def ru11_best_level(spark, d):
    scored = rules.with_level_scores(_features(spark, d))
    best = best_level({level: F.col(f"score_{level.lower()}") for level in FULL.weights}, prefer_severe=True)
    return scored.select("ticket_id", best.alias("rule_severity"))


@query("ru12_margin")
def ru12_margin(spark, d):
    lead = rules.with_margin(rules.with_level_scores(_features(spark, d)))
    return _round(lead.select("ticket_id", "score_margin", "score_total"), 6, "score_margin", "score_total")


@query("ru13_confidence")
def ru13_confidence(spark, d):
    lead = rules.with_margin(rules.with_level_scores(_features(spark, d)))
    return lead.select("ticket_id", rules.rule_confidence(F.col("score_margin"), F.col("score_total")).alias("rule_score"))


@query("ru14_rule_signal")
def ru14_rule_signal(spark, d):
    scored = rules.rule_signal(clean(spark, d).select("ticket_id", "combined_text"))
    return scored.select("ticket_id", "rule_severity", "rule_score", "rule_features.escalation_hits")


@query("ru14_rule_signal_raw_text")
def ru14_rule_signal_raw_text(spark, d):
    scored = rules.rule_signal(_raw_text(spark, d), text_col="raw_text")
    return scored.select("ticket_id", "rule_severity", "rule_score", "rule_features.caps_word_count")


@query("ru14_rule_signal_documents")
def ru14_rule_signal_documents(spark, d):
    scored = rules.rule_signal(read(spark, d, "documents").select("doc_id", "text"), text_col="text")
    return scored.select("doc_id", "rule_severity", "rule_score", "rule_features.exclamation_count")


@query("ru15_mean_features")
def ru15_mean_features(spark, d):
    return rules.mean_features(audited(spark, d))


# --- time signal ----------------------------------------------------------------------------------------


@query("rt1_thresholds")
def rt1_thresholds(spark, d):
    return _round(times.fit_thresholds(clean(spark, d)), 9, *times.LIMITS)


@query("rt2_log_hours")
def rt2_log_hours(spark, d):
    fill = ordering.median(clean(spark, d), "resolution_hours").scalar()
    value = times.log_hours(F.col("resolution_hours"), fill)
    return clean(spark, d).select("ticket_id", F.round(value, 9).alias("rt_log"))


@query("rt3_time_level")
def rt3_time_level(spark, d):
    return times.time_signal(clean(spark, d)).select("ticket_id", "rt_severity")


@query("rt4_time_confidence")
def rt4_time_confidence(spark, d):
    return times.time_signal(clean(spark, d)).select("ticket_id", "rt_score")


@query("rt5_fit_on_input")
def rt5_fit_on_input(spark, d):
    fitted = times.fit_thresholds(clean(spark, d))
    stored = times.time_signal(clean(spark, d), thresholds=fitted)
    return stored.groupBy("rt_severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rt_score"), 6).alias("mean_score"))


@query("rt5_thresholds_from_state")
def rt5_thresholds_from_state(spark, d):
    """The limits after ten batches of tickets; half of them merged, and one absorbed twice."""
    state = fresh_path(spark, "quantile-state")
    table = clean(spark, d)
    for i in range(10):
        part = table.where(F.pmod(F.xxhash64("ticket_id"), F.lit(10)) == i)
        quantile_state.absorb_hours(part, state, f"part-{i}")
        if i == 4:
            quantile_state.merge_batches(spark, state)
    quantile_state.absorb_hours(part, state, "part-9")
    return _round(quantile_state.stored_thresholds(spark, state), 9, *times.LIMITS)


@query("rt6_thresholds_in_hours")
def rt6_thresholds_in_hours(spark, d):
    found = times.thresholds_in_hours(times.fit_thresholds(clean(spark, d)))
    return _round(found, 6, *found.columns)


# --- text signal ------------------------------------------------------------------------------------------


@query("se1_anchor_terms")
def se1_anchor_terms(spark, d):
    anchors = texts.anchor_counts(spark)
    terms = texts.term_counts(clean(spark, d), "combined_text").join(F.broadcast(anchors.select("term")), "term", "left_semi")
    found = texts.document_frequency(terms, anchors, F.col("documents")).join(F.broadcast(anchors), "term")
    return found.select("term", "df", *[F.col(f"anchor_{l.lower()}") for l in LEVELS])


def _vector_anchors(spark, d) -> DataFrame:
    means = texts.mean_vectors(read(spark, d, "embeddings"), "label", "embedding")
    return means.select(F.col("label").alias("rank"), F.col("label").cast("string").alias("level"), "anchor")


@query("se2_mean_vectors")
def se2_mean_vectors(spark, d):
    means = texts.mean_vectors(read(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("anchor").alias("pos", "x")).withColumn("x", F.round("x", 6))


def _hashed_letters():
    def predict(batch):
        """Counts of the 26 letters, over the code points of all texts of the batch at once."""
        texts = [str(t).lower() for t in batch]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) - ord("a")
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        letter = (codes >= 0) & (codes < 26)
        counts = np.bincount(text[letter] * 26 + codes[letter], minlength=26 * len(texts))
        return counts.reshape(len(texts), 26).astype(np.float32)

    return predict


@query("se3_embed_in_batches")
def se3_embed_in_batches(spark, d):
    embedded = texts.embed_texts(clean(spark, d).select("ticket_id", "combined_text"), "combined_text", _hashed_letters)
    return embedded.select("ticket_id", F.col("embedding")[0].cast("int").alias("letter_a"), F.size("embedding").alias("width"))


def _compared(spark, d) -> DataFrame:
    return texts.vector_similarity(read(spark, d, "embeddings"), "embedding", _vector_anchors(spark, d))


@query("se4_cosine")
def se4_cosine(spark, d):
    pairs = _compared(spark, d).select("vec_id", F.explode("similarities").alias("s"))
    return pairs.select("vec_id", F.col("s.level").alias("level"), F.round("s.similarity", 6).alias("similarity"))


@query("se5_nearest_level")
def se5_nearest_level(spark, d):
    return _compared(spark, d).select("vec_id", texts.nearest_level(F.col("similarities")).alias("level"))


@query("se6_softmax_confidence")
def se6_softmax_confidence(spark, d):
    return _compared(spark, d).select("vec_id", texts.softmax_confidence(F.col("similarities")).alias("confidence"))


@query("se7_tfidf_similarity")
def se7_tfidf_similarity(spark, d):
    rows = by_text(spark, d).select("ticket_id", "combined_text", TEXT_KEY, TEXT_ROW, TEXT_GROUP)
    each = texts.numbered_texts(rows, "combined_text")
    found = texts.tfidf_similarity(each, texts.ROW, count_col=texts.COPIES)
    sides = [f"anchor_{l.lower()}" for l in LEVELS]
    scores = each.select(TEXT_KEY, texts.ROW).join(found.hint("shuffle_hash"), texts.ROW, "left").drop(texts.ROW)
    return _round(with_text_results(rows.drop("combined_text"), scores).na.fill(0.0), 6, *sides)


@query("se8_text_signal")
def se8_text_signal(spark, d):
    scored = texts.semantic_signal(by_text(spark, d).select("ticket_id", "combined_text", TEXT_KEY, TEXT_ROW, TEXT_GROUP))
    return _round(scored.select("ticket_id", "semantic_severity", "semantic_score"), 6, "semantic_score")


@query("se9_embedding_mode")
def se9_embedding_mode(spark, d):
    vectors = read(spark, d, "embeddings")
    scored = texts.semantic_signal(vectors, "embedding", vector_col="embedding", anchors=_vector_anchors(spark, d))
    return scored.select("vec_id", "semantic_severity", "semantic_score")


# --- fusion -------------------------------------------------------------------------------------------------


@query("fu1_level_votes")
def fu1_level_votes(spark, d):
    votes = [f"vote_{l.lower()}" for l in LEVELS]
    return _round(fusion.with_votes(labeled(spark, d)).select("ticket_id", *votes), 6, *votes)


def _refused(spark, d, weights=None) -> DataFrame:
    bare = labeled(spark, d).drop("inferred_severity", "fusion_confidence", "signal_agreement", "mismatch_label", "mismatch_type", "severity_delta", "label")
    return fusion.fuse_signals(bare, weights)


@query("fu1_other_weights")
def fu1_other_weights(spark, d):
    weights = {"semantic": 0.2, "resolution_time": 0.2, "rule_based": 0.6}
    return _refused(spark, d, weights).groupBy("inferred_severity").agg(F.count(F.lit(1)).alias("n"))


@query("fu2_winner")
def fu2_winner(spark, d):
    return _refused(spark, d).select("ticket_id", "inferred_severity")


@query("fu3_fusion_confidence")
def fu3_fusion_confidence(spark, d):
    return _refused(spark, d).select("ticket_id", "fusion_confidence")


@query("fu4_agreement")
def fu4_agreement(spark, d):
    return _refused(spark, d).select("ticket_id", "signal_agreement")


@query("fu5_mismatch_label")
def fu5_mismatch_label(spark, d):
    return fusion.label_mismatch(_refused(spark, d)).select(
        "ticket_id", "mismatch_label", "mismatch_type", "severity_delta", "label"
    )


@query("fu6_full_labeling")
def fu6_full_labeling(spark, d):
    return label_tickets(by_text(spark, d)).select(
        "ticket_id", "semantic_severity", "rt_severity", "rt_score", "rule_severity", "rule_score",
        "inferred_severity", "fusion_confidence", "signal_agreement", "mismatch_label", "mismatch_type",
        "severity_delta", "label",
    )


@query("fu7_label_summary")
def fu7_label_summary(spark, d):
    return fusion.label_summary(labeled(spark, d))


@query("fu8_pairwise_agreement")
def fu8_pairwise_agreement(spark, d):
    return fusion.pairwise_agreement(labeled(spark, d))


@query("fu9_decisive_votes")
def fu9_decisive_votes(spark, d):
    return fusion.decisive_votes(labeled(spark, d))


@query("fu10_agreement_row")
def fu10_agreement_row(spark, d):
    return fusion.signal_agreement(labeled(spark, d))


@query("fu11_fast_audit")
def fu11_fast_audit(spark, d):
    return audit_fast(by_text(spark, d)).select(
        "ticket_id", "rt_severity", "rt_score", "inferred_severity", "fusion_confidence", "signal_agreement",
        "semantic_severity", "semantic_score", "mismatch_label", "mismatch_type", "severity_delta", "label",
    )


@query("fu12_ticket_audit")
def fu12_ticket_audit(spark, d):
    done = audit_rows(clean(spark, d))
    return done.select(
        "ticket_id", "inferred_severity", "mismatch_label", "mismatch_type", "severity_delta",
        F.get("dossier.feature_evidence", F.size("dossier.feature_evidence") - 1)["value"].alias("last_item"),
    )


@query("fu13_rule_probability")
def fu13_rule_probability(spark, d):
    return fusion.rule_only_prediction(audited(spark, d)).select(
        "ticket_id", "predicted_label", F.round("prediction_confidence", 6).alias("prediction_confidence"), "mismatch_probability"
    )


# --- splits and features ------------------------------------------------------------------------------------------


@query("ml1_split_sizes")
def ml1_split_sizes(spark, d):
    parted = splitting.stratified_split(labeled(spark, d))
    return parted.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("ml2_word_grams")
def ml2_word_grams(spark, d):
    grams = features.with_grams(clean(spark, d).select("ticket_id", "combined_text"))
    return grams.select(
        "ticket_id", F.size("grams").alias("n_grams"),
        F.size(F.array_distinct("grams")).alias("n_distinct"),
    )


def _vocabulary(spark, d, profile=FULL) -> DataFrame:
    each = distinct_texts(by_text(spark, d), "combined_text", texts.COPIES)
    return features.vocabulary(each, profile=profile, count_col=texts.COPIES)


@query("ml3_vocabulary")
def ml3_vocabulary(spark, d):
    return _vocabulary(spark, d)


def _terms(spark, d) -> tuple[list[str], list[float]]:
    """The whole vocabulary and its idf, as the classifier has them."""
    source = clean(spark, d)
    idf = features.smoothed_idf(F.col("document_count"), F.lit(float(source.count())))
    rows = sorted((r["term"], r["idf"]) for r in _vocabulary(spark, d).select("term", idf.alias("idf")).collect())
    return [t for t, _ in rows], [w for _, w in rows]


def _weight_columns() -> list:
    total = F.aggregate("text_values", F.lit(0.0), lambda a, x: a + x)
    return [
        F.size("text_values").cast("long").alias("terms"), F.round(F.array_max("text_values"), 6).alias("top_weight"), F.round(total, 6).alias("weight_sum")
    ]


@query("ml4_term_weights")
def ml4_term_weights(spark, d):
    found = features.text_weights(clean(spark, d), *_terms(spark, d))
    return found.where(F.size("text_values") > 0).select("ticket_id", *_weight_columns())


def _metadata(spark, d) -> DataFrame:
    source = clean(spark, d)
    return features.with_metadata(source, features.category_codes(source, "channel"), features.category_codes(source, "ticket_type"))


@query("ml5_category_codes")
def ml5_category_codes(spark, d):
    return _metadata(spark, d).select("ticket_id", "channel_code", "type_code")


@query("ml6_numeric_features")
def ml6_numeric_features(spark, d):
    return _round(_metadata(spark, d).select("ticket_id", "log_hours", "text_length"), 6, "log_hours", "text_length")


@query("ml7_standardised")
def ml7_standardised(spark, d):
    found = _metadata(spark, d)
    scaled = features.standardise(found, features.meta_moments(found))
    return _round(scaled.select("ticket_id", *features.META), 6, *features.META)


@query("ml8_assembled_vector")
def ml8_assembled_vector(spark, d):
    found = _metadata(spark, d)
    scaled = features.standardise(found, features.meta_moments(found))
    terms, idf = _terms(spark, d)
    vectors = features.text_weights(scaled, terms, idf).withColumn("parts", F.unwrap_udt(features.feature_vector(len(terms))))
    values, n = F.col("parts.values"), F.size("parts.values") - len(features.META)
    text = F.slice(values, F.lit(1), n)
    square = F.aggregate(text, F.lit(0.0), lambda a, x: a + x * x)
    meta = [F.round(F.get(values, n + i), 6).alias(c) for i, c in enumerate(features.META)]
    return vectors.select(
        "ticket_id", F.col("parts.size").alias("width"), n.cast("long").alias("terms"),
        F.round(F.aggregate(text, F.lit(0.0), lambda a, x: a + x), 6).alias("weight_sum"), F.round(F.sqrt(square), 6).alias("length"), *meta,
    )


@query("ml9_class_weights")
def ml9_class_weights(spark, d):
    return _round(features.class_weights(labeled(spark, d)), 9, "class_weight")


@query("ml10_class_distribution")
def ml10_class_distribution(spark, d):
    return features.class_distribution(labeled(spark, d))


@query("ml11_model_text")
def ml11_model_text(spark, d):
    return features.model_text(clean(spark, d)).select("ticket_id", "model_text")


@query("ml12_resolution_token")
def ml12_resolution_token(spark, d):
    return clean(spark, d).select("ticket_id", features.resolution_token(F.col("resolution_hours")).alias("token"))


# --- classifiers -----------------------------------------------------------------------------------------------------


_MODELS: dict = {}


def _parts(spark, d) -> dict[str, DataFrame]:
    parted = staged(spark, d, "split", lambda: splitting.stratified_split(labeled(spark, d).drop("rule_features")))
    return {n: parted.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}


def _text_model(spark, d) -> classify.TextModel:
    key = (spark.sparkContext.applicationId, d, "text")
    if key not in _MODELS:
        _MODELS[key] = classify.fit_text_model(_parts(spark, d)["train"])
    return _MODELS[key]


def _tagged_model(spark, d) -> classify.TaggedModel:
    key = (spark.sparkContext.applicationId, d, "tagged")
    if key not in _MODELS:
        parts = _parts(spark, d)
        _MODELS[key] = classify.fit_tagged_model(parts["train"], parts["validation"])
    return _MODELS[key]


@query("mo1_text_model_report")
def mo1_text_model_report(spark, d):
    """Sizes of the test part, and whether the report is consistent and beats the larger class."""
    predicted = kept(_text_model(spark, d).predict(_parts(spark, d)["test"]).select("label", "prediction", "mismatch_probability"), "test")
    report = _flat_report(evaluate.evaluate(predicted, "Baseline TF-IDF+LR", score="mismatch_probability"))
    larger = F.greatest("n_mismatch", F.col("n_samples") - F.col("n_mismatch"))
    guess = F.col("larger") / (2 * F.col("n_samples") - (F.col("n_samples") - F.col("larger")))
    return report.withColumn("larger", larger).select(
        "model_name", "n_samples", "n_mismatch", (F.col("macro_f1") > guess).alias("beats_larger_class"),
        (F.abs(F.col("accuracy") - (F.col("n_samples") - F.col("fp") - F.col("fn")) / F.col("n_samples")) < 1e-3).alias("accuracy_fits"),
        (F.col("roc_auc") > 0.5).alias("ranks_better_than_chance"),
    )


def _prediction_check(predicted: DataFrame) -> DataFrame:
    """Rows, and how many break a rule that every prediction must follow."""
    p = F.col("mismatch_probability")
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("out_of_range"),
        F.count_if((p >= 0.5).cast("int") != F.col("prediction")).alias("wrong_side"), F.countDistinct("ticket_id").alias("tickets"),
    )


@query("mo2_text_model_predictions")
def mo2_text_model_predictions(spark, d):
    return _prediction_check(_text_model(spark, d).predict(_parts(spark, d)["test"]))


@query("mo3_decision")
def mo3_decision(spark, d):
    given = fusion.rule_only_prediction(audited(spark, d)).select("ticket_id", (1 - F.col("mismatch_probability")).alias("mismatch_probability"))
    return classify.with_decision(given).select("ticket_id", "predicted_label", "prediction_confidence")


@query("mo4_tagged_model_predictions")
def mo4_tagged_model_predictions(spark, d):
    return _prediction_check(_tagged_model(spark, d).predict(_parts(spark, d)["test"]))


@query("mo5_tagged_model_search")
def mo5_tagged_model_search(spark, d):
    """Whether the search kept its best round and stopped by its rule: two rounds without gain, or four in all."""
    model = _tagged_model(spark, d)
    scored = classify.training_history(spark, model).where(F.col("metric") == "val_f1")
    rounds = scored.agg(F.max("round").alias("rounds"), F.max("value").alias("top"), F.min(F.struct(-F.col("value"), "round")).alias("first"))
    since = F.col("rounds") - F.col("first.round")
    return rounds.select(
        (F.col("top") == F.lit(model.best)).alias("best_kept"), ((since == 2) | ((F.col("rounds") == 4) & (since < 2))).alias("stopped_by_rule")
    )


def _exclamation_model():
    def predict(batch):
        marks = np.strings.count(np.asarray(batch, dtype=np.dtypes.StringDType()), "!").astype(np.float32)
        chance = 1 / (1 + np.exp(1 - marks))
        return np.stack([1 - chance, chance], axis=1).astype(np.float32)

    return predict


@query("mo6_external_model")
def mo6_external_model(spark, d):
    given = features.model_text(clean(spark, d))
    scored = classify.predict_external(given, _exclamation_model)
    return scored.select("ticket_id", "prediction", F.round("mismatch_probability", 4).alias("mismatch_probability"))


@query("mo7_load_with_fallback")
def mo7_load_with_fallback(spark, d):
    path = work_folder(spark, d, "text-model")
    _text_model(spark, d).save(path)
    model, used, why = classify.load_model(spark, path, f"{path}-absent", "advanced")
    predicted = model.predict(_parts(spark, d)["test"])
    return _prediction_check(predicted).withColumns({"model_used": F.lit(used), "why_given": F.lit(why != "")})


@query("mo8_batch_audit")
def mo8_batch_audit(spark, d):
    done = audit_batch(tickets(spark, d), _text_model(spark, d), "baseline").audited
    rule = F.when(F.col("inferred_severity") != F.col("priority"), "Mismatch").otherwise("Consistent")
    sound = F.col("mismatch_probability").between(0, 1) & (F.col("predicted_label") == F.col("mismatch_label"))
    return done.select(
        "ticket_id", "inferred_severity", "mismatch_type", "severity_delta", "model_used", sound.alias("sound"),
        (F.col("label_conflict") == (F.col("predicted_label") != rule)).alias("conflict_fits"),
    )


@query("mo9_training_history")
def mo9_training_history(spark, d):
    """Read back with the stored models: whether the loss falls, and whether each round has its three numbers."""
    path = work_folder(spark, d, "histories")
    _text_model(spark, d).save(f"{path}/text")
    _tagged_model(spark, d).save(f"{path}/tagged")
    losses = [r["value"] for r in spark.read.parquet(f"{path}/text/history").orderBy("round").collect()]
    rounds = classify.training_history(spark, classify.TaggedModel.load(f"{path}/tagged")).groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    falls = len(losses) > 1 and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    return rounds.agg((F.min("n") == 3).alias("rounds_complete"), (F.max("n") == 3).alias("no_round_twice")).withColumn("loss_falls", F.lit(falls))


@query("mo10_label_from_prediction")
def mo10_label_from_prediction(spark, d):
    given = labeled(spark, d).withColumn("prediction", (F.col("rule_severity") != F.col("priority")).cast("int"))
    return classify.label_from_prediction(given).select("ticket_id", "mismatch_label")


@query("sk7_saved_model_predictions")
def sk7_saved_model_predictions(spark, d):
    path = work_folder(spark, d, "saved-model")
    model, test = _text_model(spark, d), _parts(spark, d)["test"]
    model.save(path)
    before = model.predict(test).select("ticket_id", F.col("mismatch_probability").alias("before"))
    after = classify.TextModel.load(spark, path).predict(test).select("ticket_id", "mismatch_probability")
    gap = F.abs(F.col("before") - F.col("mismatch_probability"))
    return before.join(after, "ticket_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > 1e-9).alias("different"))


# --- evaluation ------------------------------------------------------------------------------------------------------------


@query("ev1_confusion")
def ev1_confusion(spark, d):
    return _round(evaluate.confusion(_quality_table(spark, d)), 6, "accuracy")


_CLASS_MEASURES = [f"{side}_{m}" for side in ("consistent", "mismatch") for m in ("precision", "recall", "f1")] + ["macro_f1"]


@query("ev2_class_scores")
def ev2_class_scores(spark, d):
    scored = evaluate.class_scores(evaluate.confusion(_quality_table(spark, d)))
    return _round(scored.select(*_CLASS_MEASURES), 6, *_CLASS_MEASURES)


@query("ev3_support")
def ev3_support(spark, d):
    return evaluate.support(_quality_table(spark, d))


@query("ev4_roc_auc")
def ev4_roc_auc(spark, d):
    return evaluate.roc_auc(_quality_table(spark, d))


@query("ev5_quality_gates")
def ev5_quality_gates(spark, d):
    gated = evaluate.quality_gates(evaluate.class_scores(evaluate.confusion(_quality_table(spark, d))))
    return gated.select("accuracy_pass", "macro_f1_pass", "consistent_recall_pass", "mismatch_recall_pass", "overall_pass")


@query("ev6_roc_curve")
def ev6_roc_curve(spark, d):
    return _round(evaluate.roc_curve(_quality_table(spark, d)), 6, "fpr", "tpr")


@query("ev7_compare_models")
def ev7_compare_models(spark, d):
    first = _quality_table(spark, d)
    second = first.withColumn("prediction", (F.col("probability") >= 0.4).cast("int"))
    return evaluate.compare_models([evaluate.evaluate(first, "Half"), evaluate.evaluate(second, "Two fifths")])


@query("ev8_case_suite")
def ev8_case_suite(spark, d):
    hours = F.col("resolution_hours")
    expected = F.when(hours <= 4, 3).when(hours <= 12, 2).when(hours <= 48, 1).otherwise(0)
    ranked = breakdowns.level_ranks(audited(spark, d)).withColumn("gap", expected - F.col("assigned_rank"))
    cases = ranked.withColumns(
        {
            "expected_mismatch": F.col("gap") != 0,
            "expected_type": F.when(F.col("gap") > 0, "Hidden Crisis").when(F.col("gap") < 0, "False Alarm").otherwise(""),
        }
    )
    return evaluate.case_accuracy(evaluate.case_results(cases))


# --- evidence ---------------------------------------------------------------------------------------------------------------


def _flagged(spark, d) -> DataFrame:
    return audited(spark, d).where(F.col("mismatch_label") == "Mismatch")


@query("do1_keyword_items")
def do1_keyword_items(spark, d):
    found = clean(spark, d).select("ticket_id", F.posexplode(evidence.keyword_items(F.col("subject"), F.col("description"))).alias("position", "i"))
    return found.select("ticket_id", "position", "i.value", "i.weight")


@query("do2_source_fields")
def do2_source_fields(spark, d):
    found = clean(spark, d).select("ticket_id", F.posexplode(evidence.keyword_items(F.col("subject"), F.col("description"))).alias("position", "i"))
    return found.groupBy("i.value", "i.source_field").agg(F.count(F.lit(1)).alias("n"))


@query("do3_grounding_checks")
def do3_grounding_checks(spark, d):
    return evidence.grounding_checks(labeled(spark, d)).groupBy("signal", "grounded").agg(F.count(F.lit(1)).alias("n"))


@query("do4_hours_items")
def do4_hours_items(spark, d):
    item = evidence.hours_item(F.col("resolution_hours"), F.col("rt_severity"))
    return audited(spark, d).select("ticket_id", item.alias("i")).select("ticket_id", "i.value", "i.inferred_severity", "i.interpretation")


@query("do5_similarity_items")
def do5_similarity_items(spark, d):
    item = evidence.similarity_item(F.col("semantic_severity"), F.col("semantic_score"))
    return audited(spark, d).select("ticket_id", item.alias("i")).select("ticket_id", "i.value", "i.confidence")


@query("do6_channel_items")
def do6_channel_items(spark, d):
    found = clean(spark, d).select("ticket_id", evidence.channel_item(F.col("channel")).alias("i"))
    return found.where(F.col("i").isNotNull()).select("ticket_id", "i.value", "i.interpretation")


@query("do7_capped_items")
def do7_capped_items(spark, d):
    made = _flagged(spark, d).select("ticket_id", evidence.evidence_items().alias("items"))
    return made.select(
        "ticket_id", F.size("items").alias("n"),
        F.array_join(F.transform("items", lambda i: i["signal"]), ",").alias("signals"),
    )


@query("do8_confidence_label")
def do8_confidence_label(spark, d):
    return labeled(spark, d).select("ticket_id", evidence.confidence_label(F.col("fusion_confidence")).alias("confidence"))


@query("do9_analysis")
def do9_analysis(spark, d):
    return labeled(spark, d).where(F.col("mismatch_label") == "Mismatch").select("ticket_id", evidence.analysis().alias("analysis"))


def _joined_items(c: str):
    fields = evidence.ITEM_FIELDS
    return F.array_join(F.transform(c, lambda i: F.concat_ws("|", *[i[f] for f in fields])), ";")


@query("do10_record_or_null")
def do10_record_or_null(spark, d):
    made = evidence.with_record(audited(spark, d))
    return made.select(
        "ticket_id", F.col("dossier.assigned_priority").alias("assigned_priority"),
        F.col("dossier.confidence").alias("confidence"), _joined_items("dossier.feature_evidence").alias("items"),
    )


@query("do11_records")
def do11_records(spark, d):
    made = evidence.evidence_records(labeled(spark, d))
    return made.select(
        "ticket_id", "assigned_priority", "inferred_severity", "mismatch_type", "severity_delta",
        _joined_items("feature_evidence").alias("items"), "constraint_analysis", "confidence",
    )


@query("do11_record_counts")
def do11_record_counts(spark, d):
    return evidence.record_counts(labeled(spark, d))


@query("do12_flat_records")
def do12_flat_records(spark, d):
    return evidence.flat_records(evidence.evidence_records(audited(spark, d)))


@query("do13_items")
def do13_items(spark, d):
    made = evidence.record_items(evidence.evidence_records(audited(spark, d)))
    return made.select("ticket_id", "position", "signal", "value", "source_field")


@query("do14_record_summary")
def do14_record_summary(spark, d):
    return evidence.record_summary(evidence.evidence_records(audited(spark, d)))


# --- streams -------------------------------------------------------------------------------------------------------------------


def _stream(spark, d, model=None) -> DataFrame:
    source = tickets(spark, d).drop("ticket_key")
    folder = work_folder(spark, d, "arriving")
    source.write.mode("overwrite").parquet(folder)
    raw = streams.read_ticket_stream(spark, folder, "parquet", source.schema, files_per_batch=4)
    return streams.score_stored(spark, raw, _scoring_state(spark, d), model)


def _scoring_state(spark, d) -> str:
    """Limits and median, fitted and written once; the streams only read them."""
    path = work_folder(spark, d, "scoring-state")
    known = cleaning.keep_valid_priorities(tickets(spark, d)).select(to_hours(F.col("resolution_time"), "string").alias("h"))
    streams.fit_scoring(clean(spark, d), known).write.mode("overwrite").parquet(path)
    return path


def _fresh(spark, d, name: str) -> str:
    return work_folder(spark, d, f"{name}-{uuid.uuid4().hex}")


@query("st1_stream_scoring")
def st1_stream_scoring(spark, d):
    out = _fresh(spark, d, "scored")
    streams.start_scoring(_stream(spark, d).drop("rule_features"), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select(
        "ticket_id", "rt_severity", "rt_score", "inferred_severity", "mismatch_label", "mismatch_type", "severity_delta"
    )


@query("st1_stream_published_thresholds")
def st1_stream_published_thresholds(spark, d):
    state, out = _fresh(spark, d, "published"), _fresh(spark, d, "scored-published")
    streams.publish_scoring(spark.read.parquet(_scoring_state(spark, d)), state)
    source, folder = tickets(spark, d).drop("ticket_key"), work_folder(spark, d, "published-tickets")
    source.write.mode("overwrite").parquet(folder)
    raw = streams.read_ticket_stream(spark, folder, "parquet", source.schema)
    streams.start_published_scoring(raw, state, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select(
        "ticket_id", "rt_severity", "rt_score", "inferred_severity", "mismatch_label", "mismatch_type", "severity_delta"
    )


@query("st1_stream_with_stored_model")
def st1_stream_with_stored_model(spark, d):
    path, out = work_folder(spark, d, "stream-model"), _fresh(spark, d, "scored-by-model")
    _text_model(spark, d).save(path)
    model, used, _ = classify.load_model(spark, path)
    scored = _stream(spark, d, model).drop("rule_features")
    streams.start_scoring(scored, out, f"{out}-state").awaitTermination()
    done = spark.read.parquet(out)
    sound = F.col("mismatch_probability").between(0, 1) & (F.col("predicted_label") == F.col("mismatch_label"))
    return done.select("ticket_id", "rt_severity", "inferred_severity", "severity_delta", sound.alias("sound"), F.lit(used).alias("model_used"))


@query("st1_stream_of_three_columns")
def st1_stream_of_three_columns(spark, d):
    folder, out = work_folder(spark, d, "three-columns"), _fresh(spark, d, "scored-three")
    files.write_csv(cleaning.to_source_names(tickets(spark, d).select("subject", "description", "priority")), folder)
    raw = streams.read_ticket_stream(spark, folder)
    scored = streams.score_stored(spark, raw, _scoring_state(spark, d)).drop("rule_features")
    streams.start_scoring(scored, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("priority", "inferred_severity", "mismatch_label", "resolution_hours").agg(
        F.count(F.lit(1)).alias("n"), F.count("ticket_id").alias("with_id")
    )


@query("st2_stream_evidence")
def st2_stream_evidence(spark, d):
    out = _fresh(spark, d, "records")
    streams.start_evidence(_stream(spark, d), out, f"{out}-state").awaitTermination()
    return spark.read.json(out).select("ticket_id", "confidence", "constraint_analysis", F.size("feature_evidence").alias("items"))


# --- group-by analytics -------------------------------------------------------------------------------------------------------------


for _column in ("mismatch_label", "inferred_severity", "priority", "channel", "ticket_type"):
    QUERIES[f"an1_counts_by_{_column}"] = lambda spark, d, c=_column: breakdowns.counts_by(audited(spark, d), c)


@query("an2_counts_in_level_order")
def an2_counts_in_level_order(spark, d):
    return breakdowns.counts_in_level_order(audited(spark, d), "rule_severity")


@query("an3_mismatch_rate_by_priority")
def an3_mismatch_rate_by_priority(spark, d):
    return _round(breakdowns.mismatch_rate_by_priority(audited(spark, d)), 6, "mismatch_rate")


@query("an4_type_counts")
def an4_type_counts(spark, d):
    return breakdowns.type_counts(audited(spark, d))


@query("an5_mismatches_by_channel")
def an5_mismatches_by_channel(spark, d):
    return breakdowns.mismatches_by_channel(audited(spark, d))


@query("an6_channel_rates")
def an6_channel_rates(spark, d):
    return _round(breakdowns.channel_rates(audited(spark, d)), 6, "rate")


@query("an7_priority_matrix")
def an7_priority_matrix(spark, d):
    return breakdowns.priority_matrix(audited(spark, d))


@query("an8_ordered_matrix")
def an8_ordered_matrix(spark, d):
    return breakdowns.ordered_priority_matrix(audited(spark, d))


@query("an9_type_volumes")
def an9_type_volumes(spark, d):
    return breakdowns.type_volumes(audited(spark, d))


@query("an_dashboard_counts")
def an_dashboard_counts(spark, d):
    return _round(dashboard.dashboard_counts(labeled(spark, d)), 4, "agreement_sum")


_BOX = ["minimum", "q1", "median", "q3", "maximum", "lower_whisker", "upper_whisker"]


@query("an10_hours_box_by_severity")
def an10_hours_box_by_severity(spark, d):
    return _round(breakdowns.hours_box_by(audited(spark, d), "inferred_severity"), 6, *_BOX)


@query("an11_level_ranks")
def an11_level_ranks(spark, d):
    return breakdowns.level_ranks(audited(spark, d)).select("ticket_id", "inferred_rank", "assigned_rank")


@query("an12_mean_hours")
def an12_mean_hours(spark, d):
    both = breakdowns.mean_hours(clean(spark, d), "Critical").unionByName(breakdowns.mean_hours(clean(spark, d), "Low"))
    return _round(both, 6, "mean_hours")


@query("an13_agreement_histogram")
def an13_agreement_histogram(spark, d):
    found = profiling.equal_bins(labeled(spark, d).select("signal_agreement"), "signal_agreement", 10)
    return _round(found.select("bin", "lower", "n", "mean"), 6, "lower", "mean")


@query("an14_signal_distribution")
def an14_signal_distribution(spark, d):
    done = labeled(spark, d)
    parts = [
        breakdowns.counts_by(done, f"{p}_severity").select(F.lit(p).alias("signal"), F.col(f"{p}_severity").alias("level"), "n")
        for p in ("semantic", "rt", "rule")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- profiling --------------------------------------------------------------------------------------------------------------------------


@query("pr1_shape")
def pr1_shape(spark, d):
    return profiling.shape(clean(spark, d))


_MOMENTS = ["mean", "std", "minimum", "q1", "median", "q3", "maximum"]


@query("pr2_describe")
def pr2_describe(spark, d):
    return _round(profiling.describe_all(clean(spark, d)), 6, *_MOMENTS)


@query("pr3_null_counts")
def pr3_null_counts(spark, d):
    return profiling.null_counts(tickets(spark, d))


@query("pr4_total_nulls")
def pr4_total_nulls(spark, d):
    return profiling.total_nulls(tickets(spark, d))


@query("pr5_duplicate_texts")
def pr5_duplicate_texts(spark, d):
    return profiling.duplicate_rows(tickets(spark, d), ["subject", "description"])


@query("pr6_duplicate_ids")
def pr6_duplicate_ids(spark, d):
    return profiling.duplicate_rows(clean(spark, d), ["ticket_id"])


@query("pr7_hours_summary")
def pr7_hours_summary(spark, d):
    found = profiling.hours_summary(clean(spark, d))
    return _round(found, 6, *found.columns)


@query("pr8_percentiles")
def pr8_percentiles(spark, d):
    return _round(profiling.percentile_rows(clean(spark, d), "resolution_hours", [10, 25, 50, 75, 90, 95]), 6, "value")


@query("pr9_hours_histogram")
def pr9_hours_histogram(spark, d):
    found = profiling.histogram(cleaning.keep_short_cases(clean(spark, d)).select("resolution_hours"), "resolution_hours", 50)
    return _round(found.select("bin", "lower", "n"), 6, "lower")


@query("pr9_log_hours_histogram")
def pr9_log_hours_histogram(spark, d):
    positive = clean(spark, d).where(F.col("resolution_hours") > -1)
    found = profiling.histogram(positive.select(F.log1p("resolution_hours").alias("x")), "x", 50)
    return _round(found.select("bin", "lower", "n"), 6, "lower")


@query("pr10_hour_percentiles")
def pr10_hour_percentiles(spark, d):
    return _round(profiling.percentile_rows(clean(spark, d), "resolution_hours", [15, 35, 65]), 6, "value")


@query("pr11_density")
def pr11_density(spark, d):
    found = profiling.density_histogram(clean(spark, d).select("resolution_hours"), "resolution_hours", 50)
    return _round(found.select("bin", "n", "density"), 9, "density")


@query("pr12_channel_by_priority")
def pr12_channel_by_priority(spark, d):
    return _round(profiling.share_matrix(clean(spark, d), "channel"), 6, *LEVELS)


@query("pr12_type_by_priority")
def pr12_type_by_priority(spark, d):
    return _round(profiling.share_matrix(clean(spark, d), "ticket_type"), 6, *LEVELS)


@query("pr13_text_lengths")
def pr13_text_lengths(spark, d):
    return profiling.length_summary(clean(spark, d))


@query("pr14_length_histogram")
def pr14_length_histogram(spark, d):
    found = profiling.length_histogram_by_priority(clean(spark, d))
    return _round(found.select("priority", "bin", "lower", "n"), 6, "lower")


@query("pr15_length_box")
def pr15_length_box(spark, d):
    return _round(profiling.length_box_by_priority(clean(spark, d)), 6, *_BOX)


@query("pr16_correlations")
def pr16_correlations(spark, d):
    ranked = breakdowns.level_ranks(profiling.with_lengths(audited(spark, d)))
    return profiling.correlations(ranked, ["assigned_rank", "resolution_hours", "subject_len", "desc_len"])


@query("pr17_priority_share")
def pr17_priority_share(spark, d):
    return _round(profiling.shares(clean(spark, d), "priority"), 6, "percent")


# --- the compact parameter set -------------------------------------------------------------------------------------------------------------


@query("nv_rule_signal")
def nv_rule_signal(spark, d):
    return rules.rule_signal(_raw_text(spark, d), "raw_text", COMPACT).select("ticket_id", "rule_severity", "rule_score")


@query("nv_time_signal")
def nv_time_signal(spark, d):
    return _round(times.time_signal(clean(spark, d), profile=COMPACT).select("ticket_id", "rt_severity", "rt_score"), 6, "rt_score")


@query("nv_labels")
def nv_labels(spark, d):
    return label_tickets(by_text(spark, d), profile=COMPACT).select(
        "ticket_id", "inferred_severity", "fusion_confidence", "signal_agreement", "mismatch_type", "severity_delta"
    )


@query("nv_records")
def nv_records(spark, d):
    done = staged(spark, d, "labeled-compact", lambda: label_tickets(by_text(spark, d), profile=COMPACT))
    made = evidence.evidence_records(done, COMPACT)
    return made.select("ticket_id", "confidence", "constraint_analysis", _joined_items("feature_evidence").alias("items"))


@query("cl10_observed_rows")
def cl10_observed_rows(spark, d):
    seen = Observation("rows")
    cleaning.observe_rows(cleaning.keep_valid_priorities(tickets(spark, d)), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows_after long")



@query("nv_split_without_validation")
def nv_split_without_validation(spark, d):
    parted = splitting.stratified_split(labeled(spark, d), validation=COMPACT.validation_share)
    return parted.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("nv_vocabulary_of_longer_words")
def nv_vocabulary_of_longer_words(spark, d):
    return _vocabulary(spark, d, COMPACT)


@query("nv_anchor_weights")
def nv_anchor_weights(spark, d):
    """How often each anchor term of the smaller anchor set occurs per level and in the tickets, and its weight on each level."""
    table = clean(spark, d)
    anchors = texts.anchor_counts(spark, COMPACT)
    frequency = texts.fit_vocabulary(table, profile=COMPACT)
    documents = table.agg((F.count(F.lit(1)) + len(LEVELS)).alias("n")).scalar()
    names = {f"anchor_{level.lower()}": f"weight_{level.lower()}" for level in LEVELS}
    weights = texts.anchor_weights(anchors, frequency, documents).withColumnsRenamed(names)
    return _round(anchors.join(frequency, "term").join(weights, "term"), 6, *names.values())


@query("nv_text_model")
def nv_text_model(spark, d):
    """The classifier of the compact set: its own labels, no validation part, words of two characters or more."""
    table = staged(spark, d, "labeled-compact", lambda: label_tickets(by_text(spark, d), profile=COMPACT))
    parted = staged(
        spark, d, "split-compact", lambda: splitting.stratified_split(table.drop("rule_features"), validation=COMPACT.validation_share)
    )
    model = classify.fit_text_model(parted.where("split = 'train'").drop("split"), profile=COMPACT)
    predicted = kept(model.predict(parted.where("split = 'test'").drop("split")), "test-compact")
    report = evaluate.evaluate(predicted, "compact", score="mismatch_probability").select((F.col("roc_auc") > 0.5).alias("ranks_better_than_chance"))
    short = sum(any(len(word) < COMPACT.shortest_token for word in term.split(" ")) for term in model.terms)
    return _prediction_check(predicted).crossJoin(F.broadcast(report)).withColumn("terms_with_short_words", F.lit(short).cast("long"))
