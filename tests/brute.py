"""Slow, plain Python versions of a few definitions, for comparison on small inputs."""

import math
import re
from collections import Counter

from prioscope import settings as S


def is_word(ch):
    return ch.isalnum() or ch == "_"


def starts(text, keyword):
    """Positions of whole-word occurrences, overlapping ones included."""
    found = []
    for i in range(len(text) - len(keyword) + 1):
        end = i + len(keyword)
        if text[i:end] != keyword:
            continue
        left_ok = i == 0 or not is_word(text[i - 1])
        right_ok = end == len(text) or not is_word(text[end])
        if left_ok and right_ok:
            found.append(i)
    return found


def negated(text, start):
    window = text[max(0, start - 40):start]
    return any(starts(window, word) for word in S.NEGATIONS)


def weighted(text, keywords):
    flags = [negated(text, i) for k in keywords for i in starts(text, k)]
    return (len(flags) - sum(flags)) + 0.2 * sum(flags)


def normal(text):
    return " ".join(re.sub(r"<[^>]+>", " ", text).lower().split())


def patterns(text, listed):
    return sum(1 for p in listed if re.search(p, text))


def features(raw):
    t = normal(raw)
    return {
        "critical_kw_hits": weighted(t, S.CRITICAL_WORDS),
        "high_kw_hits": weighted(t, S.HIGH_WORDS),
        "medium_kw_hits": weighted(t, S.MEDIUM_WORDS),
        "low_kw_hits": weighted(t, S.LOW_WORDS),
        "escalation_hits": sum(1 for p in S.ESCALATION_PHRASES if starts(t, p)),
        "business_impact_hits": patterns(t, S.IMPACT_PATTERNS),
        "quantifier_hits": patterns(t, S.QUANTIFIER_PATTERNS),
        "caps_word_count": len(re.findall(r"\b[A-Z]{3,}\b", raw)),
        "exclamation_count": raw.count("!"),
        "text_length_norm": min(len(t) / 500, 1.0),
    }


def verdict(f):
    quiet = f["critical_kw_hits"] == 0 and f["high_kw_hits"] == 0
    sums = {level: sum(f[n] * w for n, w in terms) for level, terms in S.RULE_WEIGHTS.items()}
    sums["Low"] += 1.5 if quiet else 0
    order = sorted(sums.values(), reverse=True)
    best = next(level for level in ("Critical", "High", "Medium", "Low") if sums[level] == order[0])
    bold = 0.5 + 2 * (order[0] - order[1]) / (sum(sums.values()) + 2e-9)
    return best, round(max(0.4, min(0.95, bold)), 4)


def grams(text):
    words = re.findall(r"\w{2,}", text.lower())
    return words + [a + " " + b for a, b in zip(words, words[1:])]


def similarities(texts):
    documents = [Counter(grams(" ".join(S.ANCHORS[l]))) for l in S.LEVELS] + [Counter(grams(t)) for t in texts]
    df = Counter(term for d in documents for term in d)
    n = len(documents)

    def vector(d):
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    vectors = [vector(d) for d in documents]
    return [
        [sum(x * a.get(t, 0.0) for t, x in v.items()) for a in vectors[:4]] for v in vectors[4:]
    ]


def fuse(semantic, rt, rule, weights=None):
    w = weights or S.SIGNAL_WEIGHTS
    votes = dict.fromkeys(S.LEVELS, 0.0)
    for (level, score), name in zip((semantic, rt, rule), ("semantic", "resolution_time", "rule_based")):
        votes[level] += w[name] * score
    top = max(votes.values())
    winner = next(l for l in S.LEVELS if votes[l] == top)
    agree = sum(level == winner for level, _ in (semantic, rt, rule))
    return winner, round(top / (sum(votes.values()) + 1e-9), 4), round(agree / 3, 4)
