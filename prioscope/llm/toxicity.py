"""Toxicity by multiple-instance learning (operator 6).

A document is a bag of sentences, and only documents have labels. A sentence's probability is a
logistic function of its words and word beginnings; a document's is the noisy-or of its
sentences', 1 - prod(1 - p). The weights are fitted to document labels, so the sentences that
make a document toxic are found without having been labelled. The fit gives every sentence the
bias; in scoring a sentence has only what its features add to that, so sentences that show
nothing cannot add up to a toxic document, however many there are.

Features are hashed. Spark counts in how many toxic and other documents of the labelled sample
each occurs; those that tell the two apart are kept, and the sample (at most ``TRAIN_ROWS``
documents, whole texts) is reduced to the sentences that have any. Scoring is one pass without a
shuffle over all documents.

Defined results: null and empty texts are one empty sentence and score 0. Without labelled documents of both
kinds nothing can be told and every score is 0. Repeated rows get the
same score. Labels, language, source and id are not inputs. Extra columns are ignored by
``score`` and returned by ``clean_rows``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from prioscope.llm.common import held_out, kept, text_of
from prioscope.llm.labelled import training_labels

TRAIN_ROWS = 30_000
BUCKETS = 1 << 18
MAX_FEATURES, LEAST_Z = 4096, 3.5
FIT_FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
CUT = 0.3
OFFENDING = 0.5
_SENTENCE = re.compile(r"[^.?!\n]+(?:[.?!]+|\n|$)")
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=200_000)
def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    names = ["w:" + word] + [f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, sentence); an empty text is one empty sentence."""
    return [(m.start(), m.group()) for m in _SENTENCE.finditer(text)] or [(0, "")]


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -40.0

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(b for b in buckets_of(word) if b in self.weights)


def active(text: str, chosen: dict[int, object], seen: dict[str, tuple[int, ...]]) -> tuple[int, list[tuple[int, frozenset[int]]]]:
    """Number of sentences, and the features of those that have any, by their place in the list."""
    parts = sentences(text)
    found = []
    for nr, (_, sentence) in enumerate(parts):
        own: list[int] = []
        for w in _WORD.findall(sentence.lower()):
            hit = seen.get(w)
            if hit is None:
                if len(seen) > 200_000:
                    seen.clear()
                hit = seen[w] = tuple(b for b in buckets_of(w) if b in chosen)
            if hit:
                own += hit
        if own:
            found.append((nr, frozenset(own)))
    return len(parts), found


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of each label a feature occurs, summed per task in an array of fixed size."""
    total = np.zeros((2, BUCKETS), np.int64)
    for frame in frames:
        for text, label in zip(frame["text"], frame["label"]):
            words = set(_WORD.findall(text.lower()))
            total[int(label > 0), list({b for w in words for b in buckets_of(w)})] += 1
    at = np.flatnonzero(total.sum(axis=0))
    yield pd.DataFrame({"bucket": at, "other": total[0, at], "toxic": total[1, at]})


def _telling(counts: pd.DataFrame, others: int, toxics: int) -> list[int]:
    """Features whose odds differ much between toxic and other documents and not by chance (likelihood ratio), the surest first."""
    a, b = counts["toxic"].to_numpy(float), counts["other"].to_numpy(float)
    total, deviance = others + toxics, np.zeros(len(a))
    for found, row, column in ((a, a + b, toxics), (b, a + b, others), (toxics - a, total - a - b, toxics), (others - b, total - a - b, others)):
        deviance += 2 * found * np.log(np.where(found > 0, found * total / np.maximum(row * column, 1e-9), 1.0))
    z = np.sqrt(np.maximum(deviance, 0))
    order = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return [int(x) for x in counts["bucket"].to_numpy()[order][z[order] >= LEAST_Z]]


def fit_noisy_or(bags: pd.DataFrame, features: list[int], rounds: int = 400, penalty: float = 2e-4) -> Model:
    """Weights that fit document labels. ``bags``: label, n (sentences), sizes (features of each sentence that has any) and their buckets."""
    y = (bags["label"].to_numpy() > 0).astype(float)
    shown = bags["sizes"].str.len().to_numpy(np.int64)
    bare = bags["n"].to_numpy(float) - shown
    bag = np.repeat(np.arange(len(bags), dtype=np.int32), shown)
    sizes = np.concatenate([np.zeros(0, np.int32), *bags["sizes"]]).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    ranked = np.sort(np.array(features, np.int64))
    place = np.zeros(BUCKETS, np.int16 if len(features) < 1 << 15 else np.int32)
    place[ranked] = np.arange(len(ranked))
    col = place[np.concatenate([np.zeros(0, np.int32), *bags["buckets"]]).astype(np.int32)]
    # So many features at a time, whole sentences each, so that what a step needs besides the arrays above stays small.
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(col), FIT_FEATURES)), len(sizes)))
    slices = [(a, b, int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in zip(cuts, cuts[1:])]
    w, n = np.zeros(len(features) + 1), len(bags)
    w[-1] = -6.0
    speed, spread = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.concatenate([np.zeros(0), *(np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), w[col[c:d]], b - a) for a, b, c, d in slices)])
        p = 1 / (1 + np.exp(-np.clip(w[-1] + z, -30, 30)))
        p0 = 1 / (1 + np.exp(-w[-1]))
        p = np.minimum(p, 1 - 1e-9)
        log_none = np.bincount(bag, np.log1p(-p), n) + bare * np.log1p(-p0)
        none = np.exp(log_none)
        per_bag = (1 - y) - y * none / np.maximum(1 - none, 1e-9)
        dz = p * per_bag[bag]
        by_feature = np.zeros(len(features))
        for a, b, c, d in slices:
            by_feature += np.bincount(col[c:d], np.repeat(dz[a:b], sizes[a:b]), len(features))
        grad = np.append(by_feature, dz.sum() + p0 * (bare * per_bag).sum()) / n
        grad[:-1] += penalty * w[:-1]
        speed, spread = 0.9 * speed + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        w -= 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w[-1] = min(w[-1], -2.0)
    return Model({int(f): float(w[i]) for i, f in enumerate(ranked)}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that are not held out. The sample of labels is bounded, so it is broadcast."""
    sample = kept(training_labels(labels, "toxic", most), "training-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    seen = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    if not seen.get(True) or not seen.get(False):
        return Model()
    counts = texts.select("text", "label").mapInPandas(_counts, "bucket long, other long, toxic long").groupBy("bucket").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")
    )
    features = _telling(counts.toArrow().to_pandas().sort_values("bucket", ignore_index=True), seen[False], seen[True])
    chosen = docs.sparkSession.sparkContext.broadcast(dict.fromkeys(features))

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, ...]] = {}
        for frame in frames:
            found = [active(t, chosen.value, cache) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"], "label": frame["label"], "n": [n for n, _ in found],
                    "sizes": [np.array([len(s) for _, s in x], np.int32).tobytes() for _, x in found],
                    "buckets": [np.array([b for _, s in x for b in sorted(s)], np.int32).tobytes() for _, x in found],
                }
            )

    rows = texts.mapInPandas(bags, "doc_id long, label int, n int, sizes binary, buckets binary").toArrow().to_pandas()
    for name in ("sizes", "buckets"):
        rows[name] = [np.frombuffer(x, np.int32) for x in rows[name]]
    if rows["label"].nunique() < 2:
        return Model()
    return fit_noisy_or(rows.sort_values(["doc_id", "n"], ignore_index=True), features)


def _judge(model: Model, text: str, cache: dict[str, tuple[int, ...]]) -> tuple[float, list[tuple[int, float]]]:
    """The document's probability and those of its sentences that have features."""
    bare = 1 / (1 + np.exp(-model.bias))
    own = []
    for nr, features in active(text, model.weights, cache)[1]:
        p = 1 / (1 + np.exp(-min(30.0, max(-30.0, model.bias + sum(model.weights[f] for f in sorted(features))))))
        own.append((nr, max(0.0, float((p - bare) / (1 - bare)))))
    return float(abs(np.expm1(sum(np.log1p(-min(p, 1 - 1e-12)) for _, p in own)))), own


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.DataFrame:
        cache: dict[str, tuple[int, ...]] = {}
        scores, offending, starts = [], [], []
        for text in texts:
            p, own = _judge(shared.value, text, cache)
            bad = [x for x in own if x[1] >= OFFENDING]
            scores.append(p)
            offending.append(len(bad))
            starts.append(sentences(text)[max(bad, key=lambda x: x[1])[0]][0] if bad else None)
        return pd.DataFrame({"score": scores, "n_offending": np.array(offending, np.int32), "worst_start": pd.array(starts, "Int32")})

    shape = T.StructType(
        [T.StructField("score", T.DoubleType()), T.StructField("n_offending", T.IntegerType()), T.StructField("worst_start", T.IntegerType())]
    )
    return F.pandas_udf(score, shape)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_offending, worst_start) per row; starts count characters from 0."""
    judged = docs.select("doc_id", held_out().alias("held_out"), _scorer(docs, model)(text_of()).alias("s"))
    return judged.select(
        "doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= CUT).cast("int").alias("predicted"), "s.n_offending", "s.worst_start"
    )


def locate(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """(doc_id, start, sentence, score) of every sentence whose own probability reaches ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, ...]] = {}
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
                parts = sentences(text)
                rows += [(doc_id, *parts[nr], p) for nr, p in _judge(shared.value, text, cache)[1] if p >= least]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "sentence", "score"])

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    return given.mapInPandas(find, "doc_id string, start int, sentence string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """Rows scored below the cut, with all their columns."""
    return docs.where(_scorer(docs, model)(text_of())["score"] < CUT)
