"""For each query name, the SQL that must give the same rows."""

from __future__ import annotations

from oracle.parts import (
    BLANKS, WORD, PIECES, fusing, labeled, normal, rank, scoring, statement, strip, text, time_pieces, values,
)
from prioscope import settings as S

LEVELS = S.LEVELS
CHECKS: dict[str, str] = {}


def check(name: str, body: str, *needs: str, pieces: dict | None = None) -> None:
    CHECKS[name] = statement(body, *needs, pieces=pieces)


def count_if(test: str, name: str) -> str:
    return f"count(*) FILTER ({test}) AS {name}"


# --- sources and sinks ---------------------------------------------------------------------

RAW = "ticket_id, subject, description, priority, channel, ticket_type, customer_email, product, ticket_key"
DISPLAY = "ticket_id, subject, priority, inferred_severity, mismatch_label, mismatch_type, severity_delta"

check("sc1_read_csv", f"SELECT {RAW}, CASE WHEN resolution_time <> 'n/a' THEN resolution_time END AS resolution_time FROM tickets", "tickets")
check("sc3_audit_uploaded_files", f"SELECT {DISPLAY} FROM fast", "fast")
check("sc4_ticket_table", f"SELECT {RAW}, resolution_time FROM tickets", "tickets")
check(
    "sk1_cleaned_table",
    """SELECT ticket_id, subject, description, priority, round(resolution_hours, 6) AS resolution_hours, channel, ticket_type,
         customer_email, product, combined_text, ticket_key FROM clean""",
    "clean",
)
check(
    "sk2_labeled_csv",
    """SELECT l.ticket_id, inferred_severity, mismatch_label, severity_delta, esc::INT AS escalation_hits
       FROM labeled l JOIN rule r ON r.id = l.ticket_id""",
    "labeled", "rule",
)

PAIRS = [
    ("semantic", "rt", "Semantic vs RT"), ("semantic", "rule", "Semantic vs Rule"), ("rt", "rule", "RT vs Rule"),
    ("semantic", "inferred", "Semantic vs Fused"), ("rt", "inferred", "RT vs Fused"), ("rule", "inferred", "Rule vs Fused"),
]
PAIR_ROWS = " UNION ALL ".join(
    f"SELECT {text(t)} AS signal_pair, round_even(avg(CASE WHEN {a}_severity = {b}_severity THEN 1.0 ELSE 0.0 END), 4) AS agreement_rate FROM labeled"
    for a, b, t in PAIRS
)


def alone(own: str) -> str:
    others = [s for s in ("semantic", "rt", "rule") if s != own]
    tests = [f"{own}_severity = inferred_severity"] + [f"{o}_severity <> inferred_severity" for o in others]
    return f"SELECT '{own}' AS signal, count(*) AS n FROM labeled WHERE {' AND '.join(tests)}"


DECISIVE = f"""SELECT signal, n AS decisive_votes, round_even(n / nullif((sum(n) OVER ())::DOUBLE, 0) * 100, 1) AS contribution_percent
    FROM ({' UNION ALL '.join(alone(s) for s in ('semantic', 'rt', 'rule'))})"""

check(
    "sk2_signal_tables",
    f"SELECT signal_pair AS name, agreement_rate AS value FROM ({PAIR_ROWS}) UNION ALL SELECT signal, contribution_percent FROM ({DECISIVE})",
    "labeled",
)
check(
    "sk3_prediction_columns",
    """SELECT ticket_id, subject, priority, inferred_severity, mismatch_label AS predicted_label, rule_score AS mismatch_probability,
         mismatch_type, severity_delta FROM fast""",
    "fast",
)

# --- evidence pieces --------------------------------------------------------------------------


def listed(profile: S.Profile) -> str:
    return values(
        [
            (i, w, S.KEYWORD_LABELS[g])
            for i, (g, w) in enumerate((g, w) for g in profile.evidence_lists for w in profile.words(g))
        ]
    )


def keyword_piece(source: str, profile: S.Profile) -> str:
    return f"""SELECT ticket_id, (row_number() OVER (PARTITION BY ticket_id ORDER BY i) - 1)::INT AS position, word AS value, label AS weight,
          CASE WHEN contains(lower(subject), word) THEN 'Ticket Subject' ELSE 'Ticket Description' END AS source_field
        FROM {source} JOIN (VALUES {listed(profile)}) v(i, word, label) ON contains(lower(subject || ' ' || description), word)
        QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY i) <= {profile.max_keywords}"""


def bands(texts: list, x: str) -> str:
    whens = " ".join(f"WHEN {x} <= {limit} THEN {text(t)}" for limit, t in texts if limit is not None)
    return f"(CASE {whens} ELSE {text(texts[-1][1])} END)"


HOURS = "printf('%.1f', resolution_hours)"
INTERPRETATION = f"'Resolved in ' || {HOURS} || 'h — ' || {bands(S.HOUR_TEXTS, 'resolution_hours')}"
SIMILARITY = "'Semantic similarity to ''' || semantic_severity || ''' anchor: ' || printf('%.3f', semantic_score)"
PHONE = S.CHANNEL_TEXTS["phone"]


def all_items(source: str, keywords: str) -> str:
    """(ticket_id, position, fields...) of the capped list."""
    return f"""SELECT ticket_id, (row_number() OVER (PARTITION BY ticket_id ORDER BY kind, position) - 1)::INT AS position,
          signal, value, weight, inferred_severity, interpretation, confidence, source_field
        FROM (
          SELECT k.ticket_id, 0 AS kind, position, 'keyword' AS signal, value, weight, NULL AS inferred_severity, NULL AS interpretation,
            NULL AS confidence, source_field FROM {keywords} k SEMI JOIN {source} s ON s.ticket_id = k.ticket_id
          UNION ALL SELECT ticket_id, 1, 0, 'resolution_time', {HOURS} || ' hours', NULL, rt_severity, {INTERPRETATION}, NULL, 'Resolution Time' FROM {source}
          UNION ALL SELECT ticket_id, 2, 0, 'semantic_embedding', {SIMILARITY}, NULL, semantic_severity, NULL, printf('%.3f', semantic_score),
            'Ticket Subject + Ticket Description' FROM {source}
          UNION ALL SELECT ticket_id, 3, 0, 'ticket_channel', channel, NULL, NULL, {text(PHONE)}, NULL, 'Ticket Channel' FROM {source} WHERE lower(channel) = 'phone')
        QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY kind, position) <= 5"""


LABEL = """(CASE WHEN fusion_confidence >= 0.85 THEN 'High' WHEN fusion_confidence >= 0.60 THEN 'Medium' ELSE 'Low' END
    || ' (' || printf('%.2f', fusion_confidence * 100) || '%)')"""
PLURAL = "(CASE WHEN abs(severity_delta) > 1 THEN 's' ELSE '' END)"
GAP_TEXT = f"(abs(severity_delta)::VARCHAR || ' level' || {PLURAL})"
START = "'The ticket ''' || substr(subject, 1, 60) || '...'' was assigned ' || priority || ' priority, '"
ANALYSIS = f"""(CASE WHEN mismatch_type = 'Hidden Crisis' THEN
    {START} || 'but semantic analysis and rule-based signals converge on ' || inferred_severity || ' severity — a gap of ' || {GAP_TEXT} || '. ' ||
    CASE WHEN resolution_hours <= 12 THEN 'The ' || {HOURS} || '-hour resolution time indicates the support team treated this as operationally urgent, despite the '
        || priority || ' assignment. '
      ELSE 'The ticket content contains language patterns strongly associated with ' || inferred_severity
        || '-level incidents, including business-impact indicators. ' END ||
    'Under-prioritization of ' || priority || '→' || inferred_severity || ' issues risks SLA breach and delayed escalation for affected '
      || lower(ticket_type) || ' requests.'
  ELSE {START} || 'but content analysis indicates actual severity is ' || inferred_severity || ' — over-prioritized by ' || {GAP_TEXT} || ' level' || {PLURAL} || '. ' ||
    CASE WHEN resolution_hours >= 72 THEN 'The ' || {HOURS} || '-hour resolution time suggests the issue was not operationally critical and could have been handled under standard '
        || inferred_severity || '-tier SLA. '
      ELSE 'The ticket language and type (''' || ticket_type || ''') are inconsistent with ' || priority || '-level urgency thresholds. ' END ||
    'Over-prioritization consumes high-urgency agent capacity and can mask genuinely critical tickets in the queue (' || channel || ' channel).' END)"""
JOINED = """string_agg(concat_ws('|', signal, value, weight, inferred_severity, interpretation, confidence, source_field), ';' ORDER BY position)"""

EVIDENCE = {
    "keywords": (["clean"], keyword_piece("clean", S.FULL)),
    "flagged": (["fast"], "SELECT * FROM fast WHERE mismatch_label = 'Mismatch'"),
    "fast_items": (["flagged", "keywords"], all_items("flagged", "keywords")),
    "full_flagged": (["labeled"], "SELECT * FROM labeled WHERE mismatch_label = 'Mismatch'"),
    "full_items": (["full_flagged", "keywords"], all_items("full_flagged", "keywords")),
}
PIECES.update(EVIDENCE)

RECORDS = f"""SELECT ticket_id, {LABEL} AS confidence, {ANALYSIS} AS constraint_analysis, n::INT AS items
    FROM flagged JOIN (SELECT ticket_id, count(*) AS n FROM fast_items GROUP BY 1) USING (ticket_id)"""
check("sk4_evidence_json", RECORDS, "flagged", "fast_items")

# --- evaluation pieces ---------------------------------------------------------------------------

PIECES.update(
    {
        "quality_table": (
            [],
            """SELECT doc_id, quality AS label, p AS probability, (p >= 0.5)::INT AS prediction
               FROM (SELECT doc_id, quality, round(1 / (1 + n_chars / 1500.0::DOUBLE), 2) AS p FROM labels JOIN documents USING (doc_id))""",
        ),
        "cells": (
            ["quality_table"],
            f"""SELECT count(*) AS n_samples, {count_if('label = 0 AND prediction = 0', 'tn')}, {count_if('label = 0 AND prediction = 1', 'fp')},
                {count_if('label = 1 AND prediction = 0', 'fn')}, {count_if('label = 1 AND prediction = 1', 'tp')},
                avg((label = prediction)::INT) AS accuracy FROM quality_table""",
        ),
        "measures": (
            ["cells"],
            """SELECT *, (consistent_f1 + mismatch_f1) / 2 AS macro_f1 FROM (SELECT *,
                 coalesce(tn / nullif(tn + fn, 0), 0) AS consistent_precision, coalesce(tn / nullif(tn + fp, 0), 0) AS consistent_recall,
                 coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS consistent_f1,
                 coalesce(tp / nullif(tp + fp, 0), 0) AS mismatch_precision, coalesce(tp / nullif(tp + fn, 0), 0) AS mismatch_recall,
                 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS mismatch_f1 FROM cells)""",
        ),
        "auc": (
            ["quality_table"],
            """SELECT round_even(avg(CASE WHEN p.probability > n.probability THEN 1.0 WHEN p.probability = n.probability THEN 0.5 ELSE 0.0 END), 4) AS roc_auc
               FROM quality_table p, quality_table n WHERE p.label = 1 AND n.label = 0""",
        ),
        "gates": (
            ["measures"],
            """SELECT accuracy >= 0.83 AS accuracy_pass, macro_f1 >= 0.82 AS macro_f1_pass, consistent_recall >= 0.78 AS consistent_recall_pass,
                 mismatch_recall >= 0.78 AS mismatch_recall_pass,
                 accuracy >= 0.83 AND macro_f1 >= 0.82 AND consistent_recall >= 0.78 AND mismatch_recall >= 0.78 AS overall_pass FROM measures""",
        ),
    }
)
SIDES = [f"{s}_{m}" for s in ("consistent", "mismatch") for m in ("precision", "recall", "f1")]
check(
    "sk5_report_json",
    f"""SELECT 'By length' AS model_name, n_samples, tp + fn AS n_mismatch, round_even((tp + fn) / n_samples, 4) AS mismatch_rate,
        round_even(accuracy, 4) AS accuracy, round_even(macro_f1, 4) AS macro_f1, {', '.join(f'round_even({c}, 4) AS {c}' for c in SIDES)},
        tn + fp AS consistent_support, tp + fn AS mismatch_support, fp, fn, roc_auc, gates.* FROM measures, auc, gates""",
    "measures", "auc", "gates",
)

AGREE = ", ".join(
    f"round_even(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END), 4) AS {n}"
    for a, b, n in (
        ("semantic_severity", "rt_severity", "semantic_vs_resolution_time"),
        ("semantic_severity", "rule_severity", "semantic_vs_rule_based"),
        ("rt_severity", "rule_severity", "resolution_time_vs_rule_based"),
        ("semantic_severity", "inferred_severity", "semantic_vs_fused"),
        ("rt_severity", "inferred_severity", "resolution_time_vs_fused"),
        ("rule_severity", "inferred_severity", "rule_based_vs_fused"),
    )
)
check("sk6_agreement_json", f"SELECT {AGREE} FROM labeled", "labeled")
check("sk8_display_columns", f"SELECT {DISPLAY} FROM fast", "fast")

# --- cleaning ----------------------------------------------------------------------------------------

check(
    "cl1_ticket_ids",
    "SELECT ticket_key, printf('TKT-%05d', row_number() OVER (ORDER BY ticket_key)) AS ticket_id FROM tickets",
    "tickets",
)
check("cl2_clean_text", f"SELECT ticket_id, {strip('''coalesce(subject, '')''')} AS subject, {strip('''coalesce(description, '')''')} AS description FROM tickets", "tickets")
check("cl3_capitalize", "SELECT ticket_id, upper(substr(priority, 1, 1)) || lower(substr(priority, 2)) AS priority FROM tickets", "tickets")
check("cl4_synonyms", "SELECT ticket_id, priority FROM parsed", "parsed")
check("cl5_valid_priorities", "SELECT ticket_id, priority FROM kept", "kept")
check("cl6_parse_hours", "SELECT ticket_id, hours FROM parsed", "parsed")
check("cl7_fill_hours", "SELECT ticket_id, round(resolution_hours, 6) AS resolution_hours FROM clean", "clean")
check(
    "cl8_optional_columns",
    "SELECT ticket_id, " + ", ".join(f"{strip(f'''coalesce({c}, 'Unknown')''')} AS {c}" for c in ("channel", "ticket_type", "customer_email", "product")) + " FROM tickets",
    "tickets",
)
check(
    "cl9_combined_text",
    f"""SELECT ticket_id, {strip(f"lower({strip('''coalesce(subject, '')''')}) || ' ' || lower({strip('''coalesce(description, '')''')})")} AS combined_text FROM tickets""",
    "tickets",
)
check("cl10_row_counts", "SELECT (SELECT count(*) FROM tickets) AS rows_before, (SELECT count(*) FROM kept) AS rows_after", "kept")
check("cl10_observed_rows", "SELECT count(*) AS rows_after FROM kept", "kept")
check("cl11_short_cases", "SELECT ticket_id, round(resolution_hours, 6) AS resolution_hours FROM clean WHERE resolution_hours <= 200", "clean")
check("cl12_type_for_display", "SELECT ticket_id, CASE mismatch_type WHEN '' THEN 'Consistent' ELSE mismatch_type END AS mismatch_type FROM fast", "fast")
check("cl13_preview", "SELECT ticket_key, ticket_id, subject, priority FROM clean ORDER BY ticket_key LIMIT 5", "clean")

# --- rule signal --------------------------------------------------------------------------------------

check("ru1_normalised_text", f"SELECT ticket_id, {normal('''concat_ws(' ', subject, description)''')} AS t FROM tickets", "tickets")
check("ru2_negation_aware_hits", "SELECT id AS ticket_id, crit AS hits FROM features", "features")
check("ru3_lexicon_features", "SELECT id AS ticket_id, crit AS critical_kw_hits, high AS high_kw_hits, med AS medium_kw_hits, low AS low_kw_hits FROM features", "features")
check("ru4_escalation", "SELECT id AS ticket_id, esc AS escalation_hits FROM features", "features")
check("ru5_business_impact", "SELECT id AS ticket_id, biz AS business_impact_hits FROM features", "features")
check("ru6_quantifiers", "SELECT id AS ticket_id, quant AS quantifier_hits FROM features", "features")

RAW_TEXT = {"whole": (["tickets"], "SELECT ticket_id, concat_ws(' ', subject, description) AS raw_text FROM tickets")}
RAW_SCORING = {**RAW_TEXT, **scoring("whole", "ticket_id", "raw_text", "raw_")}
check("ru7_capital_words", "SELECT id AS ticket_id, caps AS caps_word_count FROM raw_features", "raw_features", pieces=RAW_SCORING)
check("ru8_exclamation_marks", "SELECT ticket_id, (length(raw_text) - length(replace(raw_text, '!', '')))::INT AS exclamation_count FROM whole", "whole", pieces=RAW_TEXT)
check("ru9_text_length", "SELECT id AS ticket_id, round(len_norm, 6) AS text_length_norm FROM features", "features")
check("ru10_level_scores", "SELECT id AS ticket_id, " + ", ".join(f"round(s_{l.lower()}, 6) AS score_{l.lower()}" for l in LEVELS) + " FROM scores", "scores")
check("ru11_best_level", "SELECT id AS ticket_id, rule_severity FROM rule", "rule")
check("ru12_margin", "SELECT id AS ticket_id, round(margin, 6) AS score_margin, round(total, 6) AS score_total FROM margins", "margins")
check("ru13_confidence", "SELECT id AS ticket_id, rule_score FROM rule", "rule")
check("ru14_rule_signal", "SELECT id AS ticket_id, rule_severity, rule_score, esc AS escalation_hits FROM rule", "rule")
check("ru14_rule_signal_raw_text", "SELECT id AS ticket_id, rule_severity, rule_score, caps AS caps_word_count FROM raw_rule", "raw_rule", pieces=RAW_SCORING)
check(
    "ru14_rule_signal_documents", "SELECT id AS doc_id, rule_severity, rule_score, excl AS exclamation_count FROM doc_rule", "doc_rule",
    pieces=scoring("documents", "doc_id", "text", "doc_"),
)
FEATURE_NAMES = {
    "critical_kw_hits": "crit", "high_kw_hits": "high", "medium_kw_hits": "med", "low_kw_hits": "low", "escalation_hits": "esc",
    "business_impact_hits": "biz", "quantifier_hits": "quant", "caps_word_count": "caps", "exclamation_count": "excl", "text_length_norm": "len_norm",
}
check("ru15_mean_features", "SELECT rule_severity, " + ", ".join(f"round_even(avg({c}), 3) AS {n}" for n, c in FEATURE_NAMES.items()) + " FROM rule GROUP BY 1", "rule")

# --- time signal ---------------------------------------------------------------------------------------

check("rt1_thresholds", "SELECT round(a, 9) AS q_critical, round(b, 9) AS q_high, round(c, 9) AS q_medium FROM limits", "limits")
check("rt2_log_hours", "SELECT ticket_id, round(rt_log, 9) AS rt_log FROM timed", "timed")
check("rt3_time_level", "SELECT ticket_id, rt_severity FROM timed", "timed")
check("rt4_time_confidence", "SELECT ticket_id, rt_score FROM timed", "timed")
check("rt5_fit_on_input", "SELECT rt_severity, count(*) AS n, round(avg(rt_score), 6) AS mean_score FROM timed GROUP BY 1", "timed")
check("rt5_thresholds_from_state", "SELECT round(a, 9) AS q_critical, round(b, 9) AS q_high, round(c, 9) AS q_medium FROM limits", "limits")
check("rt6_thresholds_in_hours", "SELECT round(exp(a) - 1, 6) AS hours_critical, round(exp(b) - 1, 6) AS hours_high, round(exp(c) - 1, 6) AS hours_medium FROM limits", "limits")

# --- text signal -----------------------------------------------------------------------------------------

check(
    "se1_anchor_terms",
    "SELECT term, any_value(df) AS df, " + ", ".join(f"coalesce(sum(tf) FILTER (level = '{l}'), 0)::BIGINT AS anchor_{l.lower()}" for l in LEVELS)
    + " FROM anchor_tf JOIN idfs USING (term) GROUP BY term",
    "anchor_tf", "idfs",
)
VECTORS = {
    "cells64": ([], "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings"),
    "means": (["cells64"], "SELECT label, pos::INT AS pos, avg(x) AS x FROM cells64 GROUP BY ALL"),
    "cosines": (
        ["cells64", "means"],
        """SELECT c.vec_id, m.label, sum(c.x * m.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(m.x * m.x))) AS sim
           FROM cells64 c JOIN means m ON m.pos = c.pos GROUP BY ALL""",
    ),
    "softmax": (["cosines"], "SELECT vec_id, round_even(max(exp(10 * sim)) / sum(exp(10 * sim)), 4) AS confidence, arg_max(label, sim) AS label FROM cosines GROUP BY 1"),
}
check("se2_mean_vectors", "SELECT label, pos, round(x, 6) AS x FROM means", "means", pieces=VECTORS)
check(
    "se3_embed_in_batches",
    "SELECT ticket_id, (length(combined_text) - length(replace(combined_text, 'a', '')))::INT AS letter_a, 26 AS width FROM clean", "clean",
)
check("se4_cosine", "SELECT vec_id, label::VARCHAR AS level, round(sim, 6) AS similarity FROM cosines", "cosines", pieces=VECTORS)
check("se5_nearest_level", "SELECT vec_id, label::VARCHAR AS level FROM softmax", "softmax", pieces=VECTORS)
check("se6_softmax_confidence", "SELECT vec_id, confidence FROM softmax", "softmax", pieces=VECTORS)
check("se7_tfidf_similarity", "SELECT ticket_id, " + ", ".join(f"round(a_{l.lower()}, 6) AS anchor_{l.lower()}" for l in LEVELS) + " FROM likeness", "likeness")
check("se8_text_signal", "SELECT ticket_id, semantic_severity, round(semantic_score, 6) AS semantic_score FROM semantic", "semantic")
check("se9_embedding_mode", "SELECT vec_id, label::VARCHAR AS semantic_severity, confidence AS semantic_score FROM softmax", "softmax", pieces=VECTORS)

# --- fusion --------------------------------------------------------------------------------------------------

check("fu1_level_votes", "SELECT ticket_id, " + ", ".join(f"round(v_{l.lower()}, 6) AS vote_{l.lower()}" for l in LEVELS) + " FROM votes", "votes")
OTHER = fusing("other_", "signals")
OTHER["other_votes"] = (
    OTHER["other_votes"][0],
    OTHER["other_votes"][1].replace("0.45::DOUBLE", "0.2::DOUBLE").replace("0.25::DOUBLE", "0.2::DOUBLE").replace("0.3::DOUBLE", "0.6::DOUBLE"),
)
check("fu1_other_weights", "SELECT inferred_severity, count(*) AS n FROM other_fused GROUP BY 1", "other_fused", pieces=OTHER)
check("fu2_winner", "SELECT ticket_id, inferred_severity FROM fused", "fused")
check("fu3_fusion_confidence", "SELECT ticket_id, fusion_confidence FROM fused", "fused")
check("fu4_agreement", "SELECT ticket_id, signal_agreement FROM fused", "fused")
check("fu5_mismatch_label", "SELECT ticket_id, mismatch_label, mismatch_type, severity_delta, label FROM labeled", "labeled")
check(
    "fu6_full_labeling",
    """SELECT ticket_id, semantic_severity, rt_severity, rt_score, rule_severity, rule_score, inferred_severity, fusion_confidence,
         signal_agreement, mismatch_label, mismatch_type, severity_delta, label FROM labeled""",
    "labeled",
)
check(
    "fu7_label_summary",
    f"""SELECT count(*) AS total, sum(label)::BIGINT AS mismatches, round_even(avg(label) * 100, 1) AS mismatch_percent,
        {count_if("mismatch_type = 'Hidden Crisis'", 'hidden_crisis')}, {count_if("mismatch_type = 'False Alarm'", 'false_alarm')},
        {count_if('label = 0', 'consistent')}, round_even(avg(signal_agreement), 4) AS mean_agreement FROM labeled""",
    "labeled",
)
check("fu8_pairwise_agreement", PAIR_ROWS, "labeled")
check("fu9_decisive_votes", DECISIVE, "labeled")
check("fu10_agreement_row", f"SELECT {AGREE} FROM labeled", "labeled")
check(
    "fu11_fast_audit",
    """SELECT ticket_id, rt_severity, rt_score, inferred_severity, fusion_confidence, signal_agreement, semantic_severity, semantic_score,
         mismatch_label, mismatch_type, severity_delta, label FROM fast""",
    "fast",
)
check(
    "fu12_ticket_audit",
    """SELECT f.ticket_id, inferred_severity, mismatch_label, mismatch_type, severity_delta, i.value AS last_item FROM fast f
       LEFT JOIN (SELECT ticket_id, arg_max(value, position) AS value FROM fast_items GROUP BY 1) i USING (ticket_id)""",
    "fast", "fast_items",
)
check(
    "fu13_rule_probability",
    """SELECT ticket_id, mismatch_label AS predicted_label, round(CASE label WHEN 1 THEN rule_score ELSE 1 - rule_score END, 6) AS prediction_confidence,
         rule_score AS mismatch_probability FROM fast""",
    "fast",
)

# --- splits and features ------------------------------------------------------------------------------------------

SPLIT = {
    "per_class": (["labeled"], "SELECT label, count(*) AS n FROM labeled GROUP BY 1"),
    "all_rows": (["per_class"], "SELECT sum(n)::BIGINT AS n FROM per_class"),
    "kept_rows": (
        ["per_class", "all_rows"],
        """SELECT label, n, f + (row_number() OVER (ORDER BY e - f DESC, label) <= size - sum(f) OVER ())::INT AS k
           FROM (SELECT c.label, c.n, size, c.n * size / a.n AS e, floor(c.n * size / a.n)::BIGINT AS f
                 FROM per_class c, (SELECT n, n - ceil(n * 0.2::DOUBLE)::BIGINT AS size FROM all_rows) a)""",
    ),
    "train_rows": (
        ["kept_rows"],
        """SELECT label, n, k, f + (row_number() OVER (ORDER BY e - f DESC, label) <= size - sum(f) OVER ())::INT AS t
           FROM (SELECT label, n, k, size, k * size / whole AS e, floor(k * size / whole)::BIGINT AS f
                 FROM kept_rows, (SELECT sum(k)::BIGINT AS whole, sum(k)::BIGINT - ceil(sum(k)::BIGINT * 0.125::DOUBLE)::BIGINT AS size FROM kept_rows))""",
    ),
}
check(
    "ml1_split_sizes",
    """SELECT label, 'train' AS split, t::BIGINT AS n FROM train_rows UNION ALL SELECT label, 'validation', (k - t)::BIGINT FROM train_rows
       UNION ALL SELECT label, 'test', (n - k)::BIGINT FROM train_rows""",
    "train_rows", pieces=SPLIT,
)
GRAMS = {
    "gram_lists": (
        ["clean"],
        f"""SELECT ticket_id, list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
              list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
            FROM (SELECT ticket_id, regexp_extract_all(lower(combined_text), '{WORD}+') AS w FROM clean)""",
    ),
    "gram_tf": (["gram_lists"], "SELECT ticket_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest(g) AS term FROM gram_lists) GROUP BY ALL"),
    "vocab": (
        ["gram_tf"],
        f"""SELECT term, sum(tf)::BIGINT AS term_count, count(*) AS document_count FROM gram_tf GROUP BY 1 HAVING count(*) >= 2
            ORDER BY term_count DESC, encode(term) LIMIT {S.MAX_TERMS}""",
    ),
    "gram_weights": (
        ["gram_tf", "vocab"],
        """SELECT ticket_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM clean)) / (1 + document_count)) + 1) AS w
           FROM gram_tf JOIN vocab USING (term)""",
    ),
}
check("ml2_word_grams", "SELECT ticket_id, len(g)::INT AS n_grams, len(list_distinct(g))::INT AS n_distinct FROM gram_lists", "gram_lists", pieces=GRAMS)
check("ml3_vocabulary", "SELECT term, term_count, document_count FROM vocab", "vocab", pieces=GRAMS)
check(
    "ml4_term_weights",
    """SELECT ticket_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight, round(sum(w) / sqrt(sum(w * w)), 6) AS weight_sum
       FROM gram_weights GROUP BY 1""",
    "gram_weights", pieces=GRAMS,
)



META = {
    "meta": (
        ["clean"],
        """SELECT ticket_id, (dense_rank() OVER (ORDER BY encode(channel)) - 1)::DOUBLE AS channel_code,
             (dense_rank() OVER (ORDER BY encode(ticket_type)) - 1)::DOUBLE AS type_code,
             CASE WHEN resolution_hours > -1 THEN ln(1 + resolution_hours) ELSE 0 END AS log_hours, length(combined_text) / 1000.0::DOUBLE AS text_length FROM clean""",
    )
}
META_NAMES = ["channel_code", "type_code", "log_hours", "text_length"]
check("ml5_category_codes", "SELECT ticket_id, channel_code, type_code FROM meta", "meta", pieces=META)
check("ml6_numeric_features", "SELECT ticket_id, round(log_hours, 6) AS log_hours, round(text_length, 6) AS text_length FROM meta", "meta", pieces=META)
check(
    "ml7_standardised",
    "SELECT ticket_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in META_NAMES) + " FROM meta",
    "meta", pieces=META,
)
check(
    "ml8_assembled_vector",
    "SELECT m.ticket_id, (SELECT count(*) + 4 FROM vocab)::INT AS width, coalesce(t.terms, 0) AS terms, round(coalesce(t.weight_sum, 0), 6) AS weight_sum, coalesce((t.terms > 0)::INT, 0)::DOUBLE AS length, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in META_NAMES)
    + " FROM meta m LEFT JOIN (SELECT ticket_id, count(*) AS terms, sum(w) / sqrt(sum(w * w)) AS weight_sum FROM gram_weights GROUP BY 1) t USING (ticket_id)",
    "meta", "gram_weights", pieces=GRAMS | META,
)
check(
    "ml9_class_weights",
    "SELECT label, n, round((sum(n) OVER ()) / ((count(*) OVER ()) * n), 9) AS class_weight FROM (SELECT label, count(*) AS n FROM labeled GROUP BY 1)",
    "labeled",
)
check("ml10_class_distribution", "SELECT label, count(*) AS n FROM labeled GROUP BY 1", "labeled")
TOKEN = bands(S.RESOLUTION_TOKENS, "resolution_hours")
check(
    "ml11_model_text",
    f"""SELECT ticket_id, '[CHANNEL: ' || channel || '] [TYPE: ' || ticket_type || '] [RT: ' || {TOKEN} || '] ' || subject || ' [SEP] ' || description AS model_text FROM clean""",
    "clean",
)
check("ml12_resolution_token", f"SELECT ticket_id, {TOKEN} AS token FROM clean", "clean")

# --- classifiers ------------------------------------------------------------------------------------------------------

check(
    "mo3_decision",
    """SELECT ticket_id, CASE WHEN p >= 0.5 THEN 'Mismatch' ELSE 'Consistent' END AS predicted_label,
         round_even(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS prediction_confidence
       FROM (SELECT ticket_id, 1 - rule_score AS p FROM fast)""",
    "fast",
)
check(
    "mo6_external_model",
    """SELECT ticket_id, (marks > 1)::INT AS prediction, round(1 / (1 + exp(1 - marks)), 4) AS mismatch_probability
       FROM (SELECT ticket_id, length(subject || description) - length(replace(subject || description, '!', '')) AS marks FROM clean)""",
    "clean",
)
check("mo10_label_from_prediction", "SELECT ticket_id, CASE WHEN rule_severity <> priority THEN 'Mismatch' ELSE 'Consistent' END AS mismatch_label FROM labeled", "labeled")
check(
    "sk7_saved_model_predictions", "SELECT sum(n - k)::BIGINT AS n, 0::BIGINT AS different FROM kept_rows", "kept_rows", pieces=SPLIT,
)

# --- evaluation -------------------------------------------------------------------------------------------------------

check("ev1_confusion", "SELECT n_samples, tn, fp, fn, tp, round(accuracy, 6) AS accuracy FROM cells", "cells")
check("ev2_class_scores", f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in [*SIDES, 'macro_f1'])} FROM measures", "measures")
check(
    "ev3_support",
    """SELECT count(*) AS n_samples, sum(label)::BIGINT AS n_mismatch, round_even(avg(label), 4) AS mismatch_rate,
         count(*) - sum(label)::BIGINT AS consistent_support, sum(label)::BIGINT AS mismatch_support FROM quality_table""",
    "quality_table",
)
check("ev4_roc_auc", "SELECT roc_auc FROM auc", "auc")
check("ev5_quality_gates", "SELECT * FROM gates", "gates")
check(
    "ev6_roc_curve",
    """SELECT t.probability AS threshold, round(avg((q.probability >= t.probability)::INT) FILTER (q.label = 0), 6) AS fpr,
         round(avg((q.probability >= t.probability)::INT) FILTER (q.label = 1), 6) AS tpr
       FROM (SELECT DISTINCT probability FROM quality_table) t, quality_table q GROUP BY 1
       UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
    "quality_table",
)


def compared(name: str, threshold: str) -> str:
    hit = f"((probability >= {threshold})::INT = label)"
    p = f"(probability >= {threshold})"

    def f1(y: int) -> str:
        right = f"count(*) FILTER (label = {y} AND {p}::INT = {y})"
        wrong = f"count(*) FILTER ((label = {y}) <> ({p}::INT = {y}))"
        return f"coalesce(2 * {right} / nullif(2 * {right} + {wrong}, 0), 0)"

    cols = {
        "Accuracy": (f"avg({hit}::INT)", 0.83),
        "Macro F1": (f"({f1(0)} + {f1(1)}) / 2", 0.82),
        "Consistent Recall": (f"avg({hit}::INT) FILTER (label = 0)", 0.78),
        "Mismatch Recall": (f"avg({hit}::INT) FILTER (label = 1)", 0.78),
    }
    return " UNION ALL ".join(
        f"SELECT {text(name)} AS model_name, {text(m)} AS metric, round_even({e}, 4) AS value, {t}::DOUBLE AS target FROM quality_table" for m, (e, t) in cols.items()
    )


check("ev7_compare_models", compared("Half", "0.5") + " UNION ALL " + compared("Two fifths", "0.4"), "quality_table")
check(
    "ev8_case_suite",
    f"""SELECT count(*) AS cases, sum(ok)::BIGINT AS correct, round_even(avg(ok), 4) AS accuracy FROM (
          SELECT (sign(gap) = sign(severity_delta))::INT AS ok FROM (
            SELECT severity_delta, CASE WHEN resolution_hours <= 4 THEN 3 WHEN resolution_hours <= 12 THEN 2 WHEN resolution_hours <= 48 THEN 1 ELSE 0 END
              - {rank('priority')} AS gap FROM fast))""",
    "fast",
)

# --- evidence ------------------------------------------------------------------------------------------------------------

check("do1_keyword_items", "SELECT ticket_id, position, value, weight FROM keywords", "keywords")
check("do2_source_fields", "SELECT value, source_field, count(*) AS n FROM keywords GROUP BY ALL", "keywords")
check(
    "do3_grounding_checks",
    "SELECT signal, TRUE AS grounded, count(*) AS n FROM full_items WHERE signal <> 'semantic_embedding' GROUP BY 1", "full_items",
)
check("do4_hours_items", f"SELECT ticket_id, {HOURS} || ' hours' AS value, rt_severity AS inferred_severity, {INTERPRETATION} AS interpretation FROM fast", "fast")
check("do5_similarity_items", f"SELECT ticket_id, {SIMILARITY} AS value, printf('%.3f', semantic_score) AS confidence FROM fast", "fast")
check("do6_channel_items", f"SELECT ticket_id, channel AS value, {text(PHONE)} AS interpretation FROM clean WHERE lower(channel) = 'phone'", "clean")
check("do7_capped_items", "SELECT ticket_id, count(*)::INT AS n, string_agg(signal, ',' ORDER BY position) AS signals FROM fast_items GROUP BY 1", "fast_items")
check("do8_confidence_label", f"SELECT ticket_id, {LABEL} AS confidence FROM labeled", "labeled")
check("do9_analysis", f"SELECT ticket_id, {ANALYSIS} AS analysis FROM full_flagged", "full_flagged")
check(
    "do10_record_or_null",
    f"""SELECT f.ticket_id, CASE label WHEN 1 THEN priority END AS assigned_priority, CASE label WHEN 1 THEN {LABEL} END AS confidence, items
        FROM fast f LEFT JOIN (SELECT ticket_id, {JOINED} AS items FROM fast_items GROUP BY 1) USING (ticket_id)""",
    "fast", "fast_items",
)
check(
    "do11_records",
    f"""SELECT ticket_id, priority AS assigned_priority, f.inferred_severity, mismatch_type, severity_delta, items, {ANALYSIS.replace('inferred_severity', 'f.inferred_severity')} AS constraint_analysis,
        {LABEL} AS confidence FROM full_flagged f JOIN (SELECT ticket_id, {JOINED} AS items FROM full_items GROUP BY 1) USING (ticket_id)""",
    "full_flagged", "full_items",
)
check("do11_record_counts", f"SELECT {count_if('label = 1', 'made')}, {count_if('label = 0', 'skipped')} FROM labeled", "labeled")
check(
    "do12_flat_records",
    f"""SELECT ticket_id, priority AS assigned_priority, inferred_severity, mismatch_type, severity_delta, {ANALYSIS} AS constraint_analysis, {LABEL} AS confidence,
        n::INT AS num_evidence_items FROM flagged JOIN (SELECT ticket_id, count(*) AS n FROM fast_items GROUP BY 1) USING (ticket_id)""",
    "flagged", "fast_items",
)
check("do13_items", "SELECT ticket_id, position, signal, value, source_field FROM fast_items", "fast_items")
check("do14_record_summary", f"SELECT ticket_id, mismatch_type, severity_delta, {LABEL} AS confidence FROM flagged", "flagged")

# --- streams ------------------------------------------------------------------------------------------------------------------

for name in ("st1_stream_scoring", "st1_stream_published_thresholds"):
    check(name, "SELECT ticket_id, rt_severity, rt_score, inferred_severity, mismatch_label, mismatch_type, severity_delta FROM fast", "fast")
check("st2_stream_evidence", RECORDS, "flagged", "fast_items")

# --- group-by analytics ---------------------------------------------------------------------------------------------------------

for column in ("mismatch_label", "inferred_severity", "priority", "channel", "ticket_type"):
    check(f"an1_counts_by_{column}", f"SELECT {column}, count(*) AS n FROM fast GROUP BY 1", "fast")
LEVEL_ROWS = values([(i, l) for i, l in enumerate(LEVELS)])
check(
    "an2_counts_in_level_order",
    f"SELECT level, n FROM (VALUES {LEVEL_ROWS}) v(rank, level) LEFT JOIN (SELECT rule_severity AS level, count(*) AS n FROM fast GROUP BY 1) USING (level)",
    "fast",
)
check("an3_mismatch_rate_by_priority", "SELECT priority, round(avg(label) * 100, 6) AS mismatch_rate FROM fast GROUP BY 1", "fast")
check("an4_type_counts", "SELECT CASE mismatch_type WHEN '' THEN 'Consistent' ELSE mismatch_type END AS mismatch_type, count(*) AS n FROM fast GROUP BY 1", "fast")
check("an5_mismatches_by_channel", "SELECT channel, sum(label)::BIGINT AS mismatches FROM fast GROUP BY 1", "fast")
check("an6_channel_rates", "SELECT channel, sum(label)::BIGINT AS mismatches, count(*) AS total, round(sum(label) / count(*) * 100, 6) AS rate FROM fast GROUP BY 1", "fast")
MATRIX = ", ".join(count_if(f"inferred_severity = '{l}'", f'"{l}"') for l in LEVELS)
check("an7_priority_matrix", f"SELECT priority, {MATRIX} FROM fast GROUP BY 1", "fast")
check(
    "an8_ordered_matrix",
    f"""SELECT l.priority, {', '.join(f'coalesce("{l}", 0) AS "{l}"' for l in LEVELS)} FROM (VALUES {LEVEL_ROWS}) l(rank, priority)
        LEFT JOIN (SELECT priority, {MATRIX} FROM fast GROUP BY 1) m USING (priority)""",
    "fast",
)
check("an9_type_volumes", "SELECT ticket_type, count(*) AS total, sum(label)::BIGINT AS mismatches, round_even(sum(label) / count(*) * 100, 1) AS mismatch_rate FROM fast GROUP BY 1", "fast")
DASHBOARD = {
    "all": [], "priority": ["priority"], "inferred_severity": ["inferred_severity"], "channel": ["channel"], "ticket_type": ["ticket_type"],
    "mismatch_type": ["mismatch_type"], "matrix": ["priority", "inferred_severity"],
    "signals": ["semantic_severity", "rt_severity", "rule_severity", "inferred_severity"],
}
check(
    "an_dashboard_counts",
    " UNION ALL ".join(
        f"""SELECT '{q}' AS question, {', '.join(f"{(keys + ['NULL'] * 4)[i]}::VARCHAR AS k{i + 1}" for i in range(4))}, count(*) AS total, {count_if("mismatch_label = 'Mismatch'", 'mismatches')},
        count(label) AS labels, sum(label)::BIGINT AS label_sum, count(mismatch_label) AS judged, count(severity_delta) AS deltas,
        count(signal_agreement) AS agreements, round(sum(signal_agreement), 4) AS agreement_sum
        FROM labeled {'GROUP BY ' + ', '.join(keys) if keys else ''}"""
        for q, keys in DASHBOARD.items()
    ),
    "labeled",
)


def box(source: str, group: str, value: str) -> str:
    return f"""SELECT {group}, round(q[1], 6) AS minimum, round(q[2], 6) AS q1, round(q[3], 6) AS median, round(q[4], 6) AS q3, round(q[5], 6) AS maximum,
          round((SELECT min({value}) FROM {source} i WHERE i.{group} = b.{group} AND {value} >= q[2] - 1.5 * (q[4] - q[2])), 6) AS lower_whisker,
          round((SELECT max({value}) FROM {source} i WHERE i.{group} = b.{group} AND {value} <= q[4] + 1.5 * (q[4] - q[2])), 6) AS upper_whisker
        FROM (SELECT {group}, quantile_cont({value}, [0, 0.25, 0.5, 0.75, 1]) AS q FROM {source} GROUP BY 1) b"""


SHORT = {"short_cases": (["fast"], "SELECT inferred_severity, resolution_hours FROM fast WHERE resolution_hours <= 200")}
check("an10_hours_box_by_severity", box("short_cases", "inferred_severity", "resolution_hours"), "short_cases", pieces=SHORT)
check("an11_level_ranks", f"SELECT ticket_id, {rank('inferred_severity')} AS inferred_rank, {rank('priority')} AS assigned_rank FROM fast", "fast")
check("an12_mean_hours", "SELECT priority, round(avg(resolution_hours), 6) AS mean_hours FROM clean WHERE priority IN ('Critical', 'Low') GROUP BY 1", "clean")


def bins(source: str, value: str, n: int, extra: str = "", group: str = "") -> str:
    by, part = (f"{group}, ", f"WHERE s.{group} = e.{group} ") if group else ("", "")
    grouped = f"GROUP BY {group}" if group else ""
    joint = f"b.{group} = e.{group} AND" if group else ""
    last = f"least(floor((x - lo) / (hi - lo) * {n}), {n - 1})::INT"
    return f"""SELECT {f'e.{group}, ' if group else ''}e.bin, round(e.lo + e.bin * (e.hi - e.lo) / {n}, 6) AS lower, coalesce(b.n, 0) AS n{extra}
        FROM (SELECT *, unnest(range({n}))::INT AS bin FROM (SELECT {by}min({value}) AS lo, max({value}) AS hi, count(*) AS rows FROM {source} {grouped})) e
        LEFT JOIN (SELECT {by}{last} AS bin, count(*) AS n
                   FROM (SELECT {by}{value} AS x, min({value}) OVER ({f'PARTITION BY {group}' if group else ''}) AS lo,
                           max({value}) OVER ({f'PARTITION BY {group}' if group else ''}) AS hi FROM {source}) GROUP BY ALL) b
          ON {joint} b.bin = e.bin"""


check("an13_agreement_histogram", bins("labeled", "signal_agreement", 10, ", (SELECT round(avg(signal_agreement), 6) FROM labeled) AS mean"), "labeled")
check(
    "an14_signal_distribution",
    " UNION ALL ".join(f"SELECT '{p}' AS signal, {p}_severity AS level, count(*) AS n FROM labeled GROUP BY 2" for p in ("semantic", "rt", "rule")),
    "labeled",
)

# --- profiling -----------------------------------------------------------------------------------------------------------------------

CLEAN_TYPES = [
    ("ticket_id", "string"), ("subject", "string"), ("description", "string"), ("priority", "string"), ("resolution_hours", "double"),
    ("channel", "string"), ("ticket_type", "string"), ("customer_email", "string"), ("product", "string"), ("combined_text", "string"), ("ticket_key", "bigint"),
]
check(
    "pr1_shape",
    f"""SELECT (SELECT count(*) FROM clean) AS rows, {len(CLEAN_TYPES)} AS columns, position, "column", type
        FROM (VALUES {values([(i, n, t) for i, (n, t) in enumerate(CLEAN_TYPES, 1)])}) v(position, "column", type)""",
    "clean",
)


def described(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique", (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM clean GROUP BY 1) ORDER BY n DESC, encode(v) LIMIT 1) AS top,
          max(n) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS minimum, NULL::DOUBLE AS q1, NULL::DOUBLE AS median, NULL::DOUBLE AS q3, NULL::DOUBLE AS maximum
        FROM (SELECT {c}, count(*) AS n FROM clean GROUP BY 1)"""


def summarised(value: str, name: str, d: int, source: str = "clean") -> str:
    f = f"round_even" if d == 1 else "round"
    q = ", ".join(f"{f}(quantile_cont({value}, {p}), {d}) AS {n}" for p, n in ((0, "minimum"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "maximum")))
    return f"""count(*) AS count, {f}(avg({value}), {d}) AS mean, {f}(stddev_samp({value}), {d}) AS std, {q} FROM {source}"""


check(
    "pr2_describe",
    " UNION ALL BY NAME ".join(described(c) for c, kind in CLEAN_TYPES if kind == "string")
    + "".join(f""" UNION ALL BY NAME SELECT '{c}' AS "column", {summarised(c, c, 6)}""" for c, kind in CLEAN_TYPES if kind != "string"),
    "clean",
)
RAW_COLUMNS = ["ticket_id", "subject", "description", "priority", "resolution_time", "channel", "ticket_type", "customer_email", "product", "ticket_key"]
NULLS = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS n FROM tickets""" for c in RAW_COLUMNS)
check("pr3_null_counts", f"""SELECT "column", missing_count, round_even(missing_count / n * 100, 2) AS missing_percent FROM ({NULLS}) WHERE missing_count > 0""", "tickets")
check("pr4_total_nulls", f"SELECT sum(missing_count)::BIGINT AS missing_values FROM ({NULLS})", "tickets")


def duplicates(source: str, columns: str) -> str:
    return f"""SELECT count(*) AS rows, {count_if('i > 1', 'duplicates')}, round_even(avg((i > 1)::INT) * 100, 1) AS duplicate_percent
        FROM (SELECT row_number() OVER (PARTITION BY {columns}) AS i FROM {source})"""


check("pr5_duplicate_texts", duplicates("tickets", "subject, description"), "tickets")
check("pr6_duplicate_ids", duplicates("clean", "ticket_id"), "clean")
check(
    "pr7_hours_summary",
    """SELECT round(avg(resolution_hours), 6) AS mean, round(median(resolution_hours), 6) AS median, round(stddev_samp(resolution_hours), 6) AS std,
         round(min(resolution_hours), 6) AS minimum, round(max(resolution_hours), 6) AS maximum FROM clean""",
    "clean",
)


def percentiles(ps: list[int]) -> str:
    return " UNION ALL ".join(f"SELECT {p} AS percent, round(quantile_cont(resolution_hours, {p / 100}), 6) AS value FROM clean" for p in ps)


check("pr8_percentiles", percentiles([10, 25, 50, 75, 90, 95]), "clean")
HIST = {
    "short_clean": (["clean"], "SELECT resolution_hours FROM clean WHERE resolution_hours <= 200"),
    "logged": (["clean"], "SELECT ln(1 + resolution_hours) AS v FROM clean WHERE resolution_hours > -1"),
    "lengths": (["clean"], "SELECT priority, length(subject) AS subject_len, length(description) AS desc_len, length(combined_text) AS combined_len FROM clean"),
}
check("pr9_hours_histogram", bins("short_clean", "resolution_hours", 50), "short_clean", pieces=HIST)
check("pr9_log_hours_histogram", bins("logged", "v", 50), "logged", pieces=HIST)
check("pr10_hour_percentiles", percentiles([15, 35, 65]), "clean")
check(
    "pr11_density",
    f"SELECT bin, n, round(n / (rows * (hi - lo) / 50), 9) AS density FROM ({bins('clean', 'resolution_hours', 50, ', e.rows, e.hi, e.lo')})", "clean",
)
SHARES = ", ".join(f"""round(count(*) FILTER (priority = '{l}') / count(*) * 100, 6) AS "{l}" """ for l in LEVELS)
check("pr12_channel_by_priority", f"SELECT channel, {SHARES} FROM clean GROUP BY 1", "clean")
check("pr12_type_by_priority", f"SELECT ticket_type, {SHARES} FROM clean GROUP BY 1", "clean")
check(
    "pr13_text_lengths",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", {summarised(c, c, 1, 'lengths')}""" for c in ("subject_len", "desc_len", "combined_len")),
    "lengths", pieces=HIST,
)
check("pr14_length_histogram", bins("lengths", "desc_len", 30, group="priority"), "lengths", pieces=HIST)
check("pr15_length_box", box("lengths", "priority", "desc_len"), "lengths", pieces=HIST)
NUMBERS = {"assigned_rank": rank("priority"), "resolution_hours": "resolution_hours", "subject_len": "length(subject)", "desc_len": "length(description)"}
check(
    "pr16_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, round_even(corr({x}, {y}), 3) AS correlation FROM clean" for a, x in NUMBERS.items() for b, y in NUMBERS.items()
    ),
    "clean",
)
check("pr17_priority_share", "SELECT priority, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM clean GROUP BY 1", "clean")

# --- the compact parameter set --------------------------------------------------------------------------------------------------------------

COMPACT = {
    **RAW_TEXT,
    **scoring("whole", "ticket_id", "raw_text", "cr_", S.COMPACT),
    **scoring("clean", "ticket_id", "combined_text", "cc_", S.COMPACT),
    **time_pieces("c_", False, False),
    "c_signals": (
        ["clean", "cc_rule", "c_timed"],
        """SELECT c.*, rule_severity, rule_score, rt_severity, rt_score, rule_severity AS semantic_severity, rule_score * 0.9::DOUBLE AS semantic_score
           FROM clean c JOIN cc_rule r ON r.id = c.ticket_id JOIN c_timed USING (ticket_id)""",
    ),
    **fusing("c_", "c_signals"),
    "c_flagged": (["c_labeled"], "SELECT * FROM c_labeled WHERE mismatch_label = 'Mismatch'"),
    "c_keywords": (["clean"], keyword_piece("clean", S.COMPACT)),
}
check("nv_rule_signal", "SELECT id AS ticket_id, rule_severity, rule_score FROM cr_rule", "cr_rule", pieces=COMPACT)
check("nv_time_signal", "SELECT ticket_id, rt_severity, round(rt_score, 6) AS rt_score FROM c_timed", "c_timed", pieces=COMPACT)
check("nv_labels", "SELECT ticket_id, inferred_severity, fusion_confidence, signal_agreement, mismatch_type, severity_delta FROM c_labeled", "c_labeled", pieces=COMPACT)
COMPACT_HOURS = f"'Resolved in ' || {HOURS} || 'h — ' || {bands(S.COMPACT_HOUR_TEXTS, 'resolution_hours')}"
check(
    "nv_records",
    f"""SELECT ticket_id,
          CASE WHEN fusion_confidence >= 0.85 THEN 'High' WHEN fusion_confidence >= 0.60 THEN 'Medium' ELSE 'Low' END
            || ' (' || printf('%.1f', fusion_confidence * 100) || '%)' AS confidence,
          CASE WHEN mismatch_type = 'Hidden Crisis' THEN 'Ticket ''' || substr(subject, 1, 60) || '...'' assigned ' || priority || ' but signals converge on '
              || inferred_severity || ' — gap of ' || abs(severity_delta) || ' level(s). Resolution time ' || {HOURS}
              || 'h indicates operational urgency. Under-prioritization risks SLA breach for ' || lower(ticket_type) || ' requests.'
            ELSE 'Ticket ''' || substr(subject, 1, 60) || '...'' assigned ' || priority || ' but actual severity is ' || inferred_severity
              || ' — over-prioritized by ' || abs(severity_delta) || ' level(s). Resolution time ' || {HOURS} || 'h is inconsistent with ' || priority
              || '-tier urgency. Over-prioritization drains high-urgency agent capacity.' END AS constraint_analysis,
          concat_ws(';', words, 'resolution_time|' || {HOURS} || ' hours|' || {COMPACT_HOURS} || '|Resolution Time',
            'semantic_embedding|Semantic similarity to ''' || inferred_severity || ''' anchor: ' || printf('%.3f', semantic_score)
              || '|Ticket Subject + Ticket Description') AS items
        FROM c_flagged LEFT JOIN (SELECT ticket_id, string_agg('keyword|' || value || '|' || weight || '|' || source_field, ';' ORDER BY position) AS words
                                  FROM c_keywords GROUP BY 1) USING (ticket_id)""",
    "c_flagged", "c_keywords", pieces=COMPACT,
)

# --- fitted models: what holds for any fit ---------------------------------------------------------------------------------------

TEST_ROWS = "(SELECT sum(n - k) FROM train_rows)::BIGINT"
check(
    "mo1_text_model_report",
    f"""SELECT 'Baseline TF-IDF+LR' AS model_name, {TEST_ROWS} AS n_samples, (SELECT sum(n - k) FROM train_rows WHERE label = 1)::BIGINT AS n_mismatch,
        true AS beats_larger_class, true AS accuracy_fits, true AS ranks_better_than_chance""",
    "train_rows", pieces=SPLIT,
)
SOUND = f"{TEST_ROWS} AS n, 0 AS out_of_range, 0 AS wrong_side, {TEST_ROWS} AS tickets"
check("mo2_text_model_predictions", f"SELECT {SOUND}", "train_rows", pieces=SPLIT)
check("mo4_tagged_model_predictions", f"SELECT {SOUND}", "train_rows", pieces=SPLIT)
check("mo5_tagged_model_search", "SELECT true AS best_kept, true AS stopped_by_rule", "train_rows", pieces=SPLIT)
check("mo7_load_with_fallback", f"SELECT {SOUND}, 'baseline' AS model_used, true AS why_given", "train_rows", pieces=SPLIT)
check(
    "mo8_batch_audit",
    "SELECT ticket_id, inferred_severity, mismatch_type, severity_delta, 'baseline' AS model_used, true AS sound, true AS conflict_fits FROM fast", "fast",
)
check("mo9_training_history", "SELECT true AS rounds_complete, true AS no_round_twice, true AS loss_falls", "train_rows", pieces=SPLIT)
check(
    "st1_stream_with_stored_model",
    "SELECT ticket_id, rt_severity, inferred_severity, severity_delta, true AS sound, 'baseline' AS model_used FROM fast", "fast",
)
check(
    "st1_stream_of_three_columns",
    f"""SELECT priority, inferred_severity, mismatch_label, {S.DEFAULT_HOURS}::DOUBLE AS resolution_hours, count(*) AS n, count(*) AS with_id
        FROM fast GROUP BY 1, 2, 3""",
    "fast",
)

# --- the smaller profile ------------------------------------------------------------------------------------------------------------

check(
    "nv_split_without_validation",
    "SELECT label, 'train' AS split, k::BIGINT AS n FROM train_rows UNION ALL SELECT label, 'test', (n - k)::BIGINT FROM train_rows",
    "train_rows", pieces=SPLIT,
)
LONGER = {
    "long_lists": (
        ["clean"],
        f"""SELECT ticket_id, list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
              list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
            FROM (SELECT ticket_id, list_filter(regexp_extract_all(lower(combined_text), '{WORD}+'), lambda x: length(x) >= 2) AS w FROM clean)""",
    ),
}
check(
    "nv_vocabulary_of_longer_words",
    f"""SELECT term, sum(tf)::BIGINT AS term_count, count(*) AS document_count
        FROM (SELECT ticket_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest(g) AS term FROM long_lists) GROUP BY ALL)
        GROUP BY 1 HAVING count(*) >= 2 ORDER BY term_count DESC, encode(term) LIMIT {S.MAX_TERMS}""",
    "long_lists", pieces=LONGER,
)
COMPACT_SPLIT = {**COMPACT, **SPLIT, "per_class": (["c_labeled"], "SELECT label, count(*) AS n FROM c_labeled GROUP BY 1")}
COMPACT_TEST_ROWS = "(SELECT sum(n - k) FROM kept_rows)::BIGINT"
check(
    "nv_text_model",
    f"""SELECT {COMPACT_TEST_ROWS} AS n, 0 AS out_of_range, 0 AS wrong_side, {COMPACT_TEST_ROWS} AS tickets,
        true AS ranks_better_than_chance, 0::BIGINT AS terms_with_short_words""",
    "kept_rows", pieces=COMPACT_SPLIT,
)
COMPACT_ANCHORS = {
    **COMPACT,
    "anchor_text": ([], f"SELECT * FROM (VALUES {values([(l, ' '.join(S.COMPACT.anchors[l])) for l in S.LEVELS])}) v(level, txt)"),
}
check(
    "nv_anchor_weights",
    "SELECT term, any_value(df)::BIGINT AS df, "
    + ", ".join(f"coalesce(sum(tf) FILTER (level = '{l}'), 0)::BIGINT AS anchor_{l.lower()}" for l in S.LEVELS) + ", "
    + ", ".join(f"round(coalesce(sum(tf * idf / len) FILTER (level = '{l}'), 0), 6) AS weight_{l.lower()}" for l in S.LEVELS)
    + " FROM anchor_tf JOIN idfs USING (term) JOIN anchor_norm USING (level) GROUP BY term",
    "anchor_tf", "idfs", "anchor_norm", pieces=COMPACT_ANCHORS,
)
