"""Labeling, batch audit and training flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from prioscope.operators import classify, evaluate, evidence, fusion
from prioscope.operators.cleaning import clean_tickets
from prioscope.operators.rule_signal import rule_signal
from prioscope.operators.splitting import stratified_split
from prioscope.operators.text_signal import COPIES, ROW, numbered_texts, semantic_signal
from prioscope.operators.time_signal import fit_thresholds, time_signal
from prioscope.settings import FULL, Profile
from prioscope.sources import files
from prioscope.sources.runs import run_once
from prioscope.sources.staging import TEXT_GROUP, TEXT_KEY, distinct_texts, kept, text_rows, with_text_results

RULE_COLUMNS = ["rule_severity", "rule_score", "rule_features"]
TEXT_COLUMNS = ["semantic_severity", "semantic_score"]


def label_tickets(
    clean: DataFrame, weights: dict[str, float] | None = None, profile: Profile = FULL,
    thresholds: DataFrame | None = None, mode: str | None = None, text_col: str = "combined_text",
    **semantic,
) -> DataFrame:
    """All three signals, fused and compared with the assigned priority.

    Where texts are compared, the tickets are first stored bucketed by their texts (or come so from ``text_rows``);
    each text is scored once, and the scores join back without moving the tickets.
    """
    mode = mode or profile.text_signal
    if mode == "tfidf" and not semantic.get("row_col"):
        rows = _by_text(clean, text_col)
        texts = rule_signal(numbered_texts(rows, text_col), text_col, profile)
        texts = semantic_signal(texts, mode, text_col, row_col=ROW, count_col=COPIES, profile=profile)
        found = kept(texts.select(TEXT_KEY, *RULE_COLUMNS, *TEXT_COLUMNS), "text-scores")
        scored = time_signal(with_text_results(rows, found), thresholds=thresholds, profile=profile, filled=True)
        scored = scored.select(*[c for c in scored.columns if c not in TEXT_COLUMNS], *TEXT_COLUMNS)
    else:
        scored = _rules_once(clean, text_col, profile) if not semantic.get("row_col") else rule_signal(clean, text_col, profile)
        scored = time_signal(scored, thresholds=thresholds, profile=profile, filled=True)
        scored = semantic_signal(scored, mode, text_col, profile=profile, **semantic)
    return fusion.label_mismatch(fusion.fuse_signals(scored, weights))


def _by_text(clean: DataFrame, text_col: str) -> DataFrame:
    return clean if TEXT_KEY in clean.columns else text_rows(clean, text_col, "tickets")


def once_per_text(clean: DataFrame, score, text_col: str = "combined_text") -> DataFrame:
    """``score`` of the distinct texts, joined back to the tickets. It gets a table with ``text_col`` and adds columns by the text alone."""
    rows = _by_text(clean, text_col)
    texts = distinct_texts(rows, text_col).select(TEXT_GROUP, TEXT_KEY, text_col)
    return with_text_results(rows, score(texts).drop(text_col))


def _rules_once(clean: DataFrame, text_col: str, profile: Profile) -> DataFrame:
    return once_per_text(clean, lambda texts: rule_signal(texts, text_col, profile), text_col)


def audit_fast(
    clean: DataFrame, thresholds: DataFrame | None = None, profile: Profile = FULL,
    text_col: str = "combined_text",
) -> DataFrame:
    """Rule severity as the inferred one; hours only feed the evidence. Each text is scored once."""
    scored = _rules_once(clean, text_col, profile)
    scored = time_signal(scored, thresholds=thresholds, profile=profile, filled=True)
    return fusion.label_mismatch(fusion.fast_fusion(scored))


def audit_rows(df: DataFrame, model=None) -> DataFrame:
    """Tickets one by one: the hours are not compared with others, the label stays the rule's."""
    labeled = fusion.label_mismatch(fusion.fast_fusion(rule_signal(df)))
    if model is None:
        decided = fusion.rule_only_prediction(labeled)
    else:
        decided = classify.with_decision(model.predict(labeled))
    return evidence.with_record(decided)


def audit_one(spark: SparkSession, ticket: dict, model=None) -> DataFrame:
    """A single ticket through the same columns as a table."""
    given = {
        "ticket_id": "ADHOC-001", "channel": "Email", "ticket_type": "Technical Issue",
        "resolution_hours": 24.0, "customer_email": "user@example.com", "product": "Unknown", **ticket,
    }
    row = spark.createDataFrame([given]).withColumn(
        "combined_text", F.concat_ws(" ", F.lower("subject"), F.lower("description"))
    )
    return audit_rows(row, model)


@dataclass
class BatchAudit:
    audited: DataFrame
    records: DataFrame


def audit_batch(
    raw: DataFrame, model=None, model_name: str = "rule_based", thresholds: DataFrame | None = None,
    order_col: str | None = None, note: str = "",
) -> BatchAudit:
    """Clean, fast inference, model label, evidence.

    Without a model the rule label stays and the probability is the rule score. The audited
    table is stored once and both results read it: a filter on the label must not be pushed
    through the scoring, which would then run twice.
    """
    audited = audit_fast(clean_tickets(raw, order_col), thresholds)
    if model is None:
        decided = fusion.rule_only_prediction(audited).drop("prediction_confidence")
        decided = decided.withColumn("label_conflict", F.lit(False))
    else:
        decided = classify.adopt_prediction(
            classify.with_decision(model.predict(audited)).drop("prediction_confidence")
        )
    stored = kept(decided.withColumns({"model_used": F.lit(model_name), "model_note": F.lit(note)}), "audited")
    return BatchAudit(stored, evidence.evidence_records(stored))


def audit_file(
    spark: SparkSession, path: str, out: str, model=None, model_name: str = "rule_based", file_format: str = "csv",
    text_path: str | None = None, tagged_path: str | None = None, wanted: str | None = None,
) -> BatchAudit:
    """Audit a file and write predictions and evidence.

    With ``wanted`` the model of that name is loaded; if it is not there the first classifier
    takes its place, and ``model_note`` in the result says why.
    """
    note = ""
    if wanted is not None:
        model, model_name, note = classify.load_model(spark, text_path, tagged_path, wanted)
    made = audit_batch(files.read_tickets(spark, path, file_format), model, model_name, note=note)
    files.write_predictions(made.audited, f"{out}/predictions")
    files.write_json(made.records, f"{out}/dossiers")
    return made


def audit_run(spark: SparkSession, path: str, base: str, run_id: str | None = None, **options) -> BatchAudit:
    """``audit_file`` whose two outputs are published together; ``runs.outputs`` names the newest whole set."""
    return run_once(spark, base, lambda folder: audit_file(spark, path, folder, **options), run_id)


@dataclass
class Training:
    labeled: DataFrame
    text_model: classify.TextModel
    tagged_model: classify.TaggedModel | None
    reports: DataFrame
    records: DataFrame


def train(raw: DataFrame, out: str, profile: Profile = FULL, with_second: bool = True, order_col: str | None = None) -> Training:
    """Clean, label, split, fit, measure, explain. Each large step is stored once."""
    spark = raw.sparkSession
    files.write_table(clean_tickets(raw, order_col), f"{out}/cleaned")
    clean = spark.read.parquet(f"{out}/cleaned")
    files.write_table(label_tickets(clean, profile=profile), f"{out}/labeled")
    labeled = spark.read.parquet(f"{out}/labeled")
    files.write_csv(fusion.pairwise_agreement(labeled), f"{out}/ablation")
    files.write_csv(fusion.decisive_votes(labeled), f"{out}/contribution")
    files.write_json(fusion.signal_agreement(labeled), f"{out}/signal_agreement")
    fit_thresholds(clean, profile=profile).write.mode("overwrite").parquet(f"{out}/thresholds")

    parted = kept(stratified_split(labeled, validation=profile.validation_share), "split")
    part = {n: parted.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}
    first = classify.fit_text_model(part["train"], profile=profile)
    first.save(f"{out}/text_model")
    predicted = kept(first.predict(part["test"]), "test")
    reports = [evaluate.evaluate(predicted, "Baseline TF-IDF+LR", score="mismatch_probability")]
    second, chosen = None, predicted
    if with_second and part["validation"].isEmpty():
        raise ValueError("the second classifier needs a validation share; pass with_second=False")
    if with_second:
        second = classify.fit_tagged_model(part["train"], part["validation"])
        second.save(f"{out}/tagged_model")
        classify.training_history(spark, second).write.mode("overwrite").json(f"{out}/history")
        chosen = kept(second.predict(part["test"]), "test-tagged")
        reports.append(evaluate.evaluate(chosen, "Tagged text LR", score="mismatch_probability"))
    records = evidence.evidence_records(classify.label_from_prediction(chosen), profile)
    files.write_json(records, f"{out}/dossiers")
    report = kept(evaluate.compare_models(reports), "comparison")
    for name, one in zip(("baseline", "advanced"), reports):
        files.write_json(one, f"{out}/report_{name}")
    return Training(labeled, first, second, report, records)


def train_run(raw: DataFrame, base: str, run_id: str | None = None, **options) -> Training:
    """``train`` whose outputs are published together; a run that dies leaves the earlier set as it is."""
    return run_once(raw.sparkSession, base, lambda folder: train(raw, folder, **options), run_id)
