"""Named pieces of SQL (common table expressions) and the ones each of them reads."""

from __future__ import annotations

import re

from prioscope import settings as S
from prioscope.sources.phrases import CHANNELS, OPENINGS, TYPES

WORD = r"[\p{L}\p{N}_]"
GAP = r"[^\p{L}\p{N}_]"
BLANKS = "concat(" + ", ".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace()) + ")"
BLANK_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def normal(x: str) -> str:
    return (
        f"trim(regexp_replace(lower(regexp_replace({x}, '<[^>]+>', ' ', 'g')), '{BLANK_CLASS}+', ' ', 'g'))"
    )


def rank(x: str) -> str:
    return f"(CASE {x} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 ELSE 1 END)"


def pick(names: list[str], position: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {text(n)}" for i, n in enumerate(names))
    return f"(CASE {position} {whens} END)"


def values(rows: list[tuple]) -> str:
    def cell(v):
        return text(v) if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def lexicon_rows(profile: S.Profile) -> str:
    groups = {"crit": profile.critical, "high": profile.high, "med": profile.medium, "low": profile.low}
    return values([(g, w) for g, words in groups.items() for w in words])


NEGATION = "(^|" + GAP + ")(" + "|".join(S.NEGATIONS) + ")($|" + GAP + ")"

# RE2 has no look-around and an ASCII word edge, so edges are consumed here.
QUANTIFIERS_RE2 = [
    f"(^|{GAP})100%{WORD}",
    f"(^|{GAP})all({GAP}|{GAP}.{{0,18}}{GAP})(down|fail|broken|crash)",
    f"(^|{GAP})no (one|users?|customers?){GAP}.{{0,19}}(access|login|purchase)",
    f"(^|{GAP})everyone{GAP}.{{0,19}}(affected|blocked)",
]


def matched(x: str, patterns: list[str]) -> str:
    if not patterns:
        return "0"
    return " + ".join(f"regexp_matches({x}, {text(p)})::INT" for p in patterns)


def whole_words(x: str, words: list[str]) -> str:
    return matched(x, [f"(^|{GAP}){re.escape(w).replace(chr(92) + ' ', ' ')}($|{GAP})" for w in words])


def contained(x: str, words: list[str]) -> str:
    return " + ".join(f"contains({x}, {text(w)})::INT" for w in words)


def scoring(source: str, id_col: str, text_col: str, prefix: str = "", profile: S.Profile = S.FULL) -> dict:
    """Pieces that score the texts of a table by lexicons and patterns, by position."""
    p = prefix
    clean = normal("raw") if profile.normalise_text else "lower(raw)"
    if profile.escalation_whole_word:
        escalation = whole_words("t", profile.escalation)
    else:
        escalation = contained("t", profile.escalation)
    impact = [q.replace(r"\b100%\b", f"(^|{GAP})100%{WORD}") for q in profile.impact]
    quantifiers = QUANTIFIERS_RE2 if profile.quantifiers else []
    extra_critical = " + quant * 2.0" if profile.quantifiers else ""
    extra_marks = " + excl * 0.2" if profile.quantifiers else ""
    high_marks = " + excl * 0.3" if profile.quantifiers else ""
    length = " + len_norm * 0.5" if profile.quantifiers else ""
    score = {
        "critical": f"crit * 3.0 + biz * 2.0{extra_critical} + esc * 1.5 + caps * 0.3{extra_marks}",
        "high": f"high * 2.0 + esc * 1.0 + caps * 0.4{high_marks}",
        "medium": f"med * 1.5{length}",
        "low": "low * 2.0 + CASE WHEN crit = 0 AND high = 0 THEN 1.5 ELSE 0 END",
    }
    return {
        f"{p}texts": ([source], f"SELECT {id_col} AS id, raw, {clean} AS t FROM (SELECT {id_col}, {text_col} AS raw FROM {source})"),
        f"{p}lexicon": ([], f"SELECT * FROM (VALUES {lexicon_rows(profile)}) v(lex, kw)"),
        f"{p}starts": (
            [f"{p}texts", f"{p}lexicon"],
            f"""SELECT id, lex, kw, t, unnest(list_transform(range(1, len(parts)),
                  lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(kw) + 1)) AS s
                FROM (SELECT id, lex, kw, t, string_split(t, kw) AS parts
                      FROM {p}texts JOIN {p}lexicon ON contains(t, kw))""",
        ),
        f"{p}hits": (
            [f"{p}starts"],
            f"""SELECT id, lex, regexp_matches(substr(t, greatest(1, s - 40), least(40, s - 1)), {text(NEGATION)}) AS negated
                FROM {p}starts
                WHERE NOT (s > 1 AND regexp_matches(substr(t, s - 1, 1), '{WORD}'))
                  AND NOT regexp_matches(substr(t, s + length(kw), 1), '{WORD}')""",
        ),
        f"{p}weighted": (
            [f"{p}hits"],
            "SELECT id, " + ", ".join(
                f"(count(*) FILTER (lex = '{g}' AND NOT negated))::DOUBLE"
                f" + 0.2::DOUBLE * count(*) FILTER (lex = '{g}' AND negated) AS {g}"
                for g in ("crit", "high", "med", "low")
            ) + f" FROM {p}hits GROUP BY id",
        ),
        f"{p}features": (
            [f"{p}texts", f"{p}weighted"],
            f"""SELECT id, t, coalesce(crit, 0) AS crit, coalesce(high, 0) AS high, coalesce(med, 0) AS med,
                  coalesce(low, 0) AS low, ({escalation}) AS esc, ({matched('t', impact)}) AS biz,
                  ({matched('t', quantifiers)}) AS quant,
                  len(regexp_extract_all(regexp_replace(raw, '[^\\x00-\\x7f\\P{{L}}]|[^\\x00-\\x7f\\P{{N}}]', 'z', 'g'), '\\b[A-Z]{{3,}}\\b'))::INT AS caps,
                  (length(raw) - length(replace(raw, '!', '')))::INT AS excl,
                  least(length(t) / 500.0::DOUBLE, 1.0) AS len_norm
                FROM {p}texts LEFT JOIN {p}weighted USING (id)""",
        ),
        f"{p}scores": (
            [f"{p}features"],
            "SELECT *, " + ", ".join(f"({e})::DOUBLE AS s_{k}" for k, e in score.items()) + f" FROM {p}features",
        ),
        f"{p}margins": (
            [f"{p}scores"],
            f"""SELECT *, s_critical + s_high + s_medium + s_low + 1e-9 AS total,
                  list_sort([s_critical, s_high, s_medium, s_low], 'DESC')[1]
                  - list_sort([s_critical, s_high, s_medium, s_low], 'DESC')[2] AS margin
                FROM {p}scores""",
        ),
        f"{p}rule": (
            [f"{p}margins"],
            f"""SELECT *, CASE WHEN s_critical >= greatest(s_high, s_medium, s_low) THEN 'Critical'
                  WHEN s_high >= greatest(s_medium, s_low) THEN 'High'
                  WHEN s_medium >= s_low THEN 'Medium' ELSE 'Low' END AS rule_severity,
                  round_even(greatest(0.40, least(0.95, 0.50 + (margin / (total + 1e-9)) * 2.0)), 4) AS rule_score
                FROM {p}margins""",
        ),
    }


def time_pieces(prefix: str, positive: bool, rounded: bool) -> dict:
    p = prefix
    where = f"WHERE resolution_hours > {0 if positive else -1}"
    usable = "CASE WHEN resolution_hours <= 0 THEN 0.1 ELSE resolution_hours END" if positive else "greatest(resolution_hours, 0.1)"
    wrap = ("round_even(", ", 4)") if rounded else ("", "")
    return {
        f"{p}limits": (
            ["clean"],
            f"""SELECT q[1] AS a, q[2] AS b, q[3] AS c FROM (
                  SELECT quantile_cont(ln(1 + resolution_hours), [0.15, 0.35, 0.65]) AS q FROM clean {where})""",
        ),
        f"{p}timed": (
            ["clean", f"{p}limits"],
            f"""SELECT ticket_id, v AS rt_log,
                  CASE WHEN v <= a THEN 'Critical' WHEN v <= b THEN 'High' WHEN v <= c THEN 'Medium' ELSE 'Low' END AS rt_severity,
                  {wrap[0]}CASE WHEN v <= a THEN least(0.95, 0.70 + (a - v) / (a + 1e-9) * 0.25)
                    WHEN v <= b THEN least(0.90, 0.60 + (b - v) / (b - a + 1e-9) * 0.30)
                    WHEN v <= c THEN least(0.85, 0.55 + (c - v) / (c - b + 1e-9) * 0.25)
                    ELSE least(0.85, 0.55 + (v - c) / (v + 1e-9) * 0.20) END{wrap[1]} AS rt_score
                FROM (SELECT ticket_id, ln(1 + {usable}) AS v FROM clean), {p}limits""",
        ),
    }


def fusing(prefix: str, source: str) -> dict:
    """Votes, winner and label over a table with the six signal columns and the priority."""
    p = prefix

    def vote(level: str) -> str:
        return " + ".join(
            f"CASE WHEN {c}_severity = '{level}' THEN {w}::DOUBLE * {c}_score ELSE 0 END"
            for c, w in (("semantic", 0.45), ("rt", 0.25), ("rule", 0.30))
        )

    return {
        f"{p}votes": (
            [source],
            "SELECT *, " + ", ".join(f"{vote(l)} AS v_{l.lower()}" for l in S.LEVELS) + f" FROM {source}",
        ),
        f"{p}fused": (
            [f"{p}votes"],
            f"""SELECT *, round_even(greatest(v_low, v_medium, v_high, v_critical)
                    / (v_low + v_medium + v_high + v_critical + 1e-9), 4) AS fusion_confidence,
                  round_even(((semantic_severity = inferred_severity)::INT + (rt_severity = inferred_severity)::INT
                    + (rule_severity = inferred_severity)::INT) / 3.0::DOUBLE, 4) AS signal_agreement
                FROM (SELECT *, CASE WHEN v_low >= greatest(v_medium, v_high, v_critical) THEN 'Low'
                    WHEN v_medium >= greatest(v_high, v_critical) THEN 'Medium'
                    WHEN v_high >= v_critical THEN 'High' ELSE 'Critical' END AS inferred_severity FROM {p}votes)""",
        ),
        f"{p}labeled": ([f"{p}fused"], labeled(f"{p}fused")),
    }


def labeled(source: str) -> str:
    return f"""SELECT *, CASE WHEN d = 0 THEN 'Consistent' ELSE 'Mismatch' END AS mismatch_label,
          CASE WHEN d = 0 THEN '' WHEN d > 0 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
          d::INT AS severity_delta, (d <> 0)::INT AS label
        FROM (SELECT *, {rank('inferred_severity')} - {rank('priority')} AS d FROM {source})"""


def gram_rows(source: str, key: str, text_col: str) -> str:
    return f"""SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT {key}, regexp_extract_all(lower({text_col}), '{WORD}{{2,}}') AS w FROM {source})"""


ANCHOR_SUMS = ", ".join(
    f"sum(CASE WHEN a.level = '{l}' THEN t.tf * i.idf * a.tf * i.idf ELSE 0 END) AS dot_{l.lower()}" for l in S.LEVELS
)

PIECES: dict[str, tuple[list[str], str]] = {
    "phrases": ([], f"SELECT * FROM (VALUES {values([(k, *o) for k, o in enumerate(OPENINGS)])}) v(k, opening_subject, phrase, base_hours)"),
    "talk_lengths": ([], "SELECT conv_id AS talk, count(*) AS n_turns FROM conversations GROUP BY 1"),
    "spine": (
        ["talk_lengths"],
        f"""SELECT k.*, k.o_orderkey % n_turns AS step FROM (
              SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % {len(OPENINGS)} AS opening,
                o_custkey % (SELECT max(conv_id) + 1 FROM conversations) AS talk,
                o_orderkey % (SELECT count(*) FROM events) AS event, o_orderkey % (SELECT count(*) FROM part) AS part
              FROM orders) k JOIN talk_lengths USING (talk)""",
    ),
    "tickets": (
        ["phrases", "spine"],
        f"""SELECT printf('TKT-%05d', o_orderkey + 1) AS ticket_id,
              CASE WHEN o_orderkey % 101 <> 0 THEN opening_subject END AS subject,
              CASE WHEN o_orderkey % 103 <> 0 THEN phrase || ' ' || t.text END AS description,
              regexp_replace(o_orderpriority, '^[0-9]+-', '') AS priority,
              CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'n/a'
                WHEN o_orderkey % 83 = 0 THEN '12 hours' WHEN o_orderkey % 79 = 0 THEN '-3'
                WHEN o_orderkey % 73 = 0 THEN '0' WHEN o_orderkey % 71 = 0 THEN ' 1e1 '
                ELSE (floor(base_hours::DOUBLE * (0.5::DOUBLE + value / 70) * 100 + 0.5::DOUBLE) / 100)::VARCHAR END AS resolution_time,
              CASE WHEN o_orderkey % 53 <> 0 THEN {pick(CHANNELS, '(o_custkey % 5)')} END AS channel,
              CASE WHEN o_orderkey % 59 <> 0 THEN {pick(TYPES, '((o_orderkey // 200) % 5)')} END AS ticket_type,
              lower(replace(c_name, '#', '.')) || '@example.com' AS customer_email,
              p_type AS product, o_orderkey AS ticket_key
            FROM spine
            JOIN phrases ON k = opening
            JOIN conversations t ON t.conv_id = talk AND t.turn = step
            JOIN events ON event_id = event
            JOIN part p ON p_partkey = spine.part
            JOIN customer ON c_custkey = o_custkey""",
    ),
    "parsed": (
        ["tickets"],
        f"""SELECT * REPLACE (CASE level WHEN 'Urgent' THEN 'Critical' WHEN 'Very high' THEN 'Critical'
                WHEN 'Normal' THEN 'Medium' WHEN 'Low priority' THEN 'Low' ELSE level END AS priority),
              CASE WHEN regexp_full_match(bare, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                THEN try_cast(bare AS DOUBLE) END AS hours
            FROM (SELECT *, upper(substr(p, 1, 1)) || lower(substr(p, 2)) AS level, {strip('resolution_time')} AS bare
                  FROM (SELECT *, {strip('priority')} AS p FROM tickets))""",
    ),
    "kept": (["parsed"], "SELECT * FROM parsed WHERE priority IN ('Low', 'Medium', 'High', 'Critical')"),
    "clean": (
        ["kept"],
        f"""SELECT *, {strip("lower(subject) || ' ' || lower(description)")} AS combined_text FROM (
              SELECT ticket_id, {strip("coalesce(subject, '')")} AS subject, {strip("coalesce(description, '')")} AS description,
                priority, coalesce(hours, (SELECT median(hours) FROM kept)) AS resolution_hours,
                {', '.join(f"{strip(f'''coalesce({c}, 'Unknown')''')} AS {c}" for c in ('channel', 'ticket_type', 'customer_email', 'product'))},
                ticket_key
              FROM kept)""",
    ),
    **scoring("clean", "ticket_id", "combined_text"),
    **time_pieces("", True, True),
    "anchor_text": ([], f"SELECT * FROM (VALUES {values([(l, ' '.join(S.ANCHORS[l])) for l in S.LEVELS])}) v(level, txt)"),
    "anchor_tf": (["anchor_text"], f"SELECT level, term, count(*) AS tf FROM ({gram_rows('anchor_text', 'level', 'txt')}) GROUP BY ALL"),
    "ticket_tf": (["clean"], f"SELECT ticket_id, term, count(*) AS tf FROM ({gram_rows('clean', 'ticket_id', 'combined_text')}) GROUP BY ALL"),
    "idfs": (
        ["anchor_tf", "ticket_tf"],
        f"""SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) + {len(S.LEVELS)} FROM clean)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
            FROM (SELECT term, count(*) AS df FROM
                   (SELECT term FROM ticket_tf UNION ALL SELECT term FROM anchor_tf) GROUP BY term)""",
    ),
    "anchor_norm": (
        ["anchor_tf", "idfs"],
        "SELECT level, sqrt(sum((tf * idf) * (tf * idf))) AS len FROM anchor_tf JOIN idfs USING (term) GROUP BY level",
    ),
    "likeness": (
        ["ticket_tf", "idfs", "anchor_tf", "anchor_norm"],
        "SELECT c.ticket_id, " + ", ".join(
            f"round(coalesce(dot_{l.lower()} / (len * (SELECT n.len FROM anchor_norm n WHERE n.level = '{l}')), 0), 12) AS a_{l.lower()}"
            for l in S.LEVELS
        ) + f""" FROM clean c
            LEFT JOIN (SELECT ticket_id, sqrt(sum((tf * idf) * (tf * idf))) AS len FROM ticket_tf JOIN idfs USING (term) GROUP BY 1) USING (ticket_id)
            LEFT JOIN (SELECT t.ticket_id, {ANCHOR_SUMS} FROM ticket_tf t JOIN idfs i ON i.term = t.term JOIN anchor_tf a ON a.term = t.term GROUP BY 1) USING (ticket_id)""",
    ),
    "semantic": (
        ["likeness"],
        """SELECT ticket_id, CASE WHEN a_low >= greatest(a_medium, a_high, a_critical) THEN 'Low'
              WHEN a_medium >= greatest(a_high, a_critical) THEN 'Medium'
              WHEN a_high >= a_critical THEN 'High' ELSE 'Critical' END AS semantic_severity,
              greatest(a_low, a_medium, a_high, a_critical) AS semantic_score FROM likeness""",
    ),
    "signals": (
        ["clean", "rule", "timed", "semantic"],
        """SELECT c.*, rule_severity, rule_score, rt_severity, rt_score, rt_log, semantic_severity, semantic_score
            FROM clean c JOIN rule r ON r.id = c.ticket_id JOIN timed USING (ticket_id) JOIN semantic USING (ticket_id)""",
    ),
    **fusing("", "signals"),
    "fast_signals": (
        ["clean", "rule", "timed"],
        """SELECT c.*, rule_severity, rule_score, rt_severity, rt_score, rt_log, rule_severity AS semantic_severity,
              rule_score AS semantic_score, rule_severity AS inferred_severity, rule_score AS fusion_confidence,
              0.67::DOUBLE AS signal_agreement
            FROM clean c JOIN rule r ON r.id = c.ticket_id JOIN timed USING (ticket_id)""",
    ),
    "fast": (["fast_signals"], labeled("fast_signals")),
}


def statement(body: str, *needs: str, pieces: dict | None = None) -> str:
    """A statement that defines the pieces it needs, in order, each computed once."""
    known = {**PIECES, **(pieces or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in known:
            return
        for other in known[name][0]:
            visit(other)
        ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in ordered) + "\n" + body
