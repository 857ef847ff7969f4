"""Quality classifier on random-indexing word vectors (operator 9).

Every token has a fixed sparse random index vector. A token's word vector is the sum of the
index vectors of the two tokens before and after it over all documents; tasks sum in an array of
fixed size (tokens are hashed to ``BUCKETS``) and Spark adds the arrays up. A document is the mean
and the spread of its tokens' unit vectors, frequent tokens counting less, and the mean product of
neighbouring tokens' vectors, which is large where words repeat. A network of two
layers is trained in numpy on a bounded sample of labelled rows (``TRAIN_ROWS``), and part of that
sample sets the temperature that turns its outputs into calibrated probabilities.

Defined results: null and empty texts have the zero vector and get the network's answer to it.
Without labelled rows of both kinds every score is 0.5. Repeated rows get the same score. Labels,
language, source and id are not inputs. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prioscope.llm.common import held_out, kept, text_of
from prioscope.llm.labelled import training_labels
from prioscope.llm.shingles import chunks, mixed

TRAIN_ROWS = 30_000
BUCKETS, WIDTH, ENTRIES = 1 << 16, 32, 4
NEIGHBOURS = 2
COMMON = 1e-3
HIDDEN, EPOCHS, BATCH, RATE = 32, 30, 256, 3e-3
CALIBRATION_SHARE = 0.15
CUT = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each bucket's index vector."""
    draw = mixed(np.arange(BUCKETS * ENTRIES, dtype=np.uint64).reshape(BUCKETS, ENTRIES) + np.uint64(0x9E3779B97F4A7C15))
    return (draw % np.uint64(WIDTH)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def token_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every token of the texts, in order."""
    lists = [_TOKEN.findall(t) for t in texts]
    flat = [x for tokens in lists for x in tokens]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) % np.uint64(BUCKETS)
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), code.astype(np.int64)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the neighbours' index vectors per bucket, one array per task."""
    place, sign = index_vectors()
    total, seen = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS, np.int64)
    for frame in frames:
        for part in chunks(frame, "text"):
            text, code = token_buckets(list(part["text"]))
            seen += np.bincount(code, minlength=BUCKETS)
            for gap in range(1, NEIGHBOURS + 1):
                near = text[gap:] == text[:-gap]
                left, right = code[:-gap][near], code[gap:][near]
                for own, other in ((left, right), (right, left)):
                    for e in range(ENTRIES):
                        total += np.bincount(own * WIDTH + place[other, e], sign[other, e], BUCKETS * WIDTH)
    at = np.flatnonzero(seen)
    rows = total.reshape(BUCKETS, WIDTH)[at].astype(np.int64)
    for start in range(0, len(at), 8192):
        cut = slice(start, start + 8192)
        yield pd.DataFrame({"bucket": at[cut], "seen": seen[at[cut]], "vector": list(rows[cut])})


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector and share of all tokens per bucket, from every document; an array of fixed size."""
    parts = docs.select(text_of().alias("text")).mapInPandas(_sums, "bucket int, seen long, vector array<long>")
    summed = parts.groupBy("bucket").agg(
        F.sum("seen").alias("seen"), F.array(*[F.sum(F.col("vector")[i]) for i in range(WIDTH)]).alias("vector")
    ).toPandas()
    vectors, seen = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS)
    if len(summed):
        at = summed["bucket"].to_numpy()
        vectors[at] = np.stack(summed["vector"].to_numpy())
        seen[at] = summed["seen"]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(length, 1e-9), seen / max(1.0, seen.sum())


def pooled(texts: list[str], vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors and mean product of neighbours, one line per text."""
    text, code = token_buckets(texts)
    n = np.bincount(text, minlength=len(texts))
    out = np.zeros((len(texts), 3 * WIDTH), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        plain = vectors[code]
        weighted = plain * (COMMON / (COMMON + share[code])).astype(np.float32)[:, None]
        starts = (np.cumsum(n) - n)[full]
        product = np.zeros_like(plain)
        np.multiply(plain[1:], plain[:-1], out=product[1:])
        product[starts] = 0  # the token before the first belongs to another text
        beside = np.add.reduceat(product, starts, axis=0) / n[full, None]
        mean = np.add.reduceat(weighted, starts, axis=0) / n[full, None]
        square = np.add.reduceat(weighted * weighted, starts, axis=0) / n[full, None]
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), beside])
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, features) per row, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].values, "held_out": part["held_out"].values, "features": list(pooled(list(part["text"]), *shared.value))}
                )

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return kept(given.mapInPandas(pool, "doc_id string, held_out boolean, features array<float>"), "features")


@dataclass
class Network:
    """Two layers and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam on most of the rows, then set the temperature on the rest by least log loss."""
    random = np.random.default_rng(11)
    order = random.permutation(len(y))
    rest = max(1, int(len(y) * CALIBRATION_SHARE))
    held, own = order[:rest], order[rest:]
    net = Network(
        x[own].mean(axis=0), x[own].std(axis=0) + 1e-6,
        [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)],
    )
    z = (x - net.shift) / net.scale
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in net.layers]
    step = 0
    for _ in range(EPOCHS):
        random.shuffle(own)
        for start in range(0, len(own), BATCH):
            step += 1
            part = own[start : start + BATCH]
            w1, b1, w2, b2 = net.layers
            hidden = np.tanh(z[part] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
            d2 = (p - y[part, None]) / len(part)
            d1 = d2 @ w2.T * (1 - hidden**2)
            grads = [z[part].T @ d1 + 1e-4 * w1, d1.sum(axis=0), hidden.T @ d2 + 1e-4 * w2, d2.sum(axis=0)]
            for i, (w, g) in enumerate(zip(net.layers, grads)):
                m, v = moment[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = net.logits(x[held])
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [np.logaddexp(0, -raw / t * np.where(y[held] > 0, 1, -1)).mean() for t in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    table = features(docs)
    sample = training_labels(labels, "quality", most)
    rows = table.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "features").toPandas().sort_values("doc_id", ignore_index=True)
    y = (rows["label"].to_numpy() > 0).astype(float)
    both = len(y) > 0 and 0 < y.sum() < len(y)
    shared = docs.sparkSession.sparkContext.broadcast(train(np.stack(rows["features"].to_numpy()).astype(float), y) if both else None)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for frame in frames:
            if len(frame):
                x = np.stack(frame["features"].to_numpy()).astype(float)
                yield frame[["doc_id", "held_out"]].assign(score=net.probability(x) if net else 0.5)

    scored = table.mapInPandas(answer, "doc_id string, held_out boolean, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
