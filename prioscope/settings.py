"""Fixed values of the audit and the two named parameter sets built from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- Fixed values: levels, column names, weights, thresholds -----------------

LEVELS = ["Low", "Medium", "High", "Critical"]

SOURCE_COLUMNS = {
    "Ticket ID": "ticket_id",
    "Ticket Subject": "subject",
    "Ticket Description": "description",
    "Ticket Priority": "priority",
    "Ticket Channel": "channel",
    "Resolution Time": "resolution_time",
    "Ticket Type": "ticket_type",
    "Customer Email": "customer_email",
    "Product Purchased": "product",
}

PRIORITY_SYNONYMS = {
    "Urgent": "Critical",
    "Very high": "Critical",
    "Normal": "Medium",
    "Low priority": "Low",
}

SIGNAL_WEIGHTS = {"semantic": 0.45, "resolution_time": 0.25, "rule_based": 0.30}

DEFAULT_HOURS = 24.0
FAST_AGREEMENT = 0.67
MAX_EVIDENCE = 5
HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.60

MIN_ACCURACY = 0.83
MIN_MACRO_F1 = 0.82
MIN_RECALL = 0.78

TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
SPLIT_SEED = 42
MAX_TERMS = 15000
MIN_DOCUMENTS = 2
MAX_NGRAM = 3
LR_ITERATIONS = 1000
LR_C = 1.0

# --- Fixed values: text tokens that a CSV reader treats as missing ------------

NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Fixed values: lexicons ---------------------------------------------------

CRITICAL_WORDS = [
    "server down", "production outage", "payment failed", "payment gateway",
    "security breach", "data loss", "data breach", "system failure",
    "complete outage", "cannot access", "database down", "critical failure",
    "service unavailable", "complete downtime", "emergency", "urgent",
    "immediately", "asap", "all users affected", "entire system",
    "revenue loss", "financial impact", "sla breach", "compliance violation",
    "ransomware", "hack", "intrusion", "credentials compromised",
]
HIGH_WORDS = [
    "not working", "broken", "error", "bug", "crash", "slow", "performance",
    "degraded", "intermittent", "partial outage", "some users", "login issue",
    "authentication", "cannot login", "feature broken", "api error",
    "timeout", "connection refused", "502", "503", "500 error",
]
MEDIUM_WORDS = [
    "help", "issue", "problem", "question", "inquiry", "request",
    "not sure", "confused", "clarification", "assistance", "support",
    "how to", "unable to", "unexpected behavior", "wrong result",
]
LOW_WORDS = [
    "feature request", "suggestion", "feedback", "profile", "settings",
    "change password", "update email", "notification", "preference",
    "cosmetic", "ui improvement", "minor", "nice to have",
    "change picture", "profile picture", "username change",
]
ESCALATION_PHRASES = [
    "escalate", "manager", "legal action", "report", "lawsuit",
    "unacceptable", "this is ridiculous", "worst", "terrible",
    "not the first time", "repeatedly", "still not fixed",
]
NEGATIONS = ["not", "never", "no", "cannot", "can't", "won't", "doesn't", "don't"]
NEGATION_WINDOW = 40
NEGATED_HIT = 0.2

# --- Fixed values: pattern features -------------------------------------------

IMPACT_PATTERNS = [
    r"revenue (loss|impact|drop)",
    r"customers? (cannot|can't|unable to)",
    r"all users? (affected|blocked|locked)",
    r"entire (company|team|organization)",
    r"(legal|regulatory|compliance) (action|violation|issue)",
    r"sla (breach|violation|penalty)",
    r"(losing|lost) (money|revenue|customers?)",
    r"financial impact",
    r"business critical",
]
QUANTIFIER_PATTERNS = [
    r"\b100%\b",
    r"\ball\b.{0,20}\b(down|fail|broken|crash)",
    r"\bno (one|users?|customers?)\b.{0,20}(access|login|purchase)",
    r"\beveryone\b.{0,20}(affected|blocked)",
]

# --- Fixed values: weight of each feature in each level score, in order --------

RULE_WEIGHTS = {
    "Critical": [
        ("critical_kw_hits", 3.0), ("business_impact_hits", 2.0),
        ("quantifier_hits", 2.0), ("escalation_hits", 1.5),
        ("caps_word_count", 0.3), ("exclamation_count", 0.2),
    ],
    "High": [
        ("high_kw_hits", 2.0), ("escalation_hits", 1.0),
        ("caps_word_count", 0.4), ("exclamation_count", 0.3),
    ],
    "Medium": [("medium_kw_hits", 1.5), ("text_length_norm", 0.5)],
    "Low": [("low_kw_hits", 2.0)],
}
QUIET_BONUS = 1.5

# --- Fixed values: anchor sentences -------------------------------------------

ANCHORS = {
    "Low": [
        "I want to change my profile picture.",
        "Please update my notification preferences.",
        "I have a minor suggestion for the user interface.",
        "Can you help me find the documentation?",
        "I would like to update my account settings.",
    ],
    "Medium": [
        "I cannot access a specific feature in the application.",
        "The report is generating incorrect data for some entries.",
        "I am experiencing intermittent login issues.",
        "Some users are unable to see the updated content.",
        "The API is returning unexpected results occasionally.",
    ],
    "High": [
        "The application is crashing repeatedly for multiple users.",
        "Authentication is broken and users cannot log in.",
        "The integration with our payment system is failing.",
        "Performance is severely degraded and the service is very slow.",
        "A major feature is completely broken affecting our workflow.",
    ],
    "Critical": [
        "Our production server is completely down and no one can access the system.",
        "The payment gateway has failed and customers cannot complete purchases.",
        "We have detected a security breach and customer data may be compromised.",
        "Complete service outage affecting all users with severe revenue impact.",
        "Database corruption detected and data loss is occurring in production.",
    ],
}

# --- Fixed values: evidence texts ----------------------------------------------

KEYWORD_LABELS = {
    "critical": "Critical severity indicator",
    "high": "High severity indicator",
    "low": "Low severity indicator (counter-evidence)",
    "escalation": "Escalation phrase",
}
HOUR_TEXTS = [
    (4.0, "extremely fast, indicating the issue was treated as production-critical by support staff."),
    (12.0, "fast resolution suggesting high operational urgency."),
    (48.0, "moderate resolution time consistent with medium-severity handling."),
    (None, "slow resolution time consistent with low-severity or deprioritized handling."),
]
CHANNEL_TEXTS = {"phone": "Direct phone contact often indicates urgency."}

RESOLUTION_TOKENS = [
    (4.0, "RESOLVED-FAST"),
    (24.0, "RESOLVED-NORMAL"),
    (72.0, "RESOLVED-SLOW"),
    (None, "RESOLVED-VERY-SLOW"),
]

# --- Fixed values: the compact parameter set ------------------------------------

COMPACT_CRITICAL = [
    "server down", "payment failed", "payment gateway", "security breach",
    "production outage", "data loss", "data breach", "system failure",
    "complete outage", "cannot access", "database down", "critical failure",
    "service unavailable", "emergency", "revenue loss", "sla breach",
    "ransomware", "intrusion", "credentials compromised", "all users affected",
]
COMPACT_HIGH = [
    "not working", "broken", "error", "bug", "crash", "slow", "performance",
    "degraded", "login issue", "cannot login", "api error", "timeout", "500 error",
]
COMPACT_MEDIUM = [
    "help", "issue", "problem", "question", "unable to", "unexpected behavior",
]
COMPACT_LOW = [
    "feature request", "suggestion", "feedback", "profile", "settings",
    "change password", "notification", "profile picture", "username change",
]
COMPACT_ESCALATION = [
    "escalate", "manager", "legal action", "lawsuit", "unacceptable",
    "not the first time", "repeatedly", "still not fixed",
]
COMPACT_IMPACT = [
    r"revenue (loss|impact)", r"customers? (cannot|unable to)",
    r"all users? (affected|blocked)", r"entire (company|team)",
    r"sla (breach|violation)", r"financial impact", r"\b100%\b",
]
COMPACT_WEIGHTS = {
    "Critical": [
        ("critical_kw_hits", 3.0), ("business_impact_hits", 2.0),
        ("escalation_hits", 1.5), ("caps_word_count", 0.3),
    ],
    "High": [
        ("high_kw_hits", 2.0), ("escalation_hits", 1.0), ("caps_word_count", 0.4),
    ],
    "Medium": [("medium_kw_hits", 1.5)],
    "Low": [("low_kw_hits", 2.0)],
}
COMPACT_DROPPED_ANCHORS = [
    "Some users are unable to see the updated content.",
    "The integration with our payment system is failing.",
    "Database corruption detected and data loss is occurring in production.",
]
COMPACT_HOUR_TEXTS = [
    (4.0, "extremely fast, production-critical handling."),
    (24.0, "fast, operationally urgent."),
    (72.0, "moderate urgency."),
    (None, "slow, low operational urgency."),
]


@dataclass(frozen=True)
class Profile:
    """One consistent set of lexicons, patterns, weights and evidence rules."""

    name: str = "full"
    critical: list = field(default_factory=lambda: CRITICAL_WORDS)
    high: list = field(default_factory=lambda: HIGH_WORDS)
    medium: list = field(default_factory=lambda: MEDIUM_WORDS)
    low: list = field(default_factory=lambda: LOW_WORDS)
    escalation: list = field(default_factory=lambda: ESCALATION_PHRASES)
    escalation_whole_word: bool = True
    impact: list = field(default_factory=lambda: IMPACT_PATTERNS)
    quantifiers: list = field(default_factory=lambda: QUANTIFIER_PATTERNS)
    weights: dict = field(default_factory=lambda: RULE_WEIGHTS)
    normalise_text: bool = True
    anchors: dict = field(default_factory=lambda: ANCHORS)
    text_signal: str = "tfidf"
    fit_positive_only: bool = True
    round_time_score: bool = True
    shortest_token: int = 1
    validation_share: float = VALIDATION_SHARE
    evidence_lists: tuple = ("critical", "high", "low", "escalation")
    max_keywords: int = MAX_EVIDENCE
    hour_texts: list = field(default_factory=lambda: HOUR_TEXTS)
    confidence_decimals: int = 2
    long_analysis: bool = True

    def words(self, group: str) -> list:
        return getattr(self, group)


FULL = Profile()

COMPACT = replace(
    FULL,
    name="compact",
    critical=COMPACT_CRITICAL,
    high=COMPACT_HIGH,
    medium=COMPACT_MEDIUM,
    low=COMPACT_LOW,
    escalation=COMPACT_ESCALATION,
    escalation_whole_word=False,
    impact=COMPACT_IMPACT,
    quantifiers=[],
    weights=COMPACT_WEIGHTS,
    normalise_text=False,
    anchors={
        level: [s for s in sentences if s not in COMPACT_DROPPED_ANCHORS]
        for level, sentences in ANCHORS.items()
    },
    text_signal="rule",
    fit_positive_only=False,
    round_time_score=False,
    shortest_token=2,
    validation_share=0.0,
    evidence_lists=("critical", "high"),
    max_keywords=3,
    hour_texts=COMPACT_HOUR_TEXTS,
    confidence_decimals=1,
    long_analysis=False,
)
