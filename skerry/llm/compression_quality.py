"""Quality classifier by compression: a zstandard dictionary from good texts and one from bad texts.

A text is cut into chunks of `CHUNK` bytes, each compressed with either dictionary. A chunk's normalised difference is
(bad - good) / (bad + good) of the two compressed sizes, so positive when the good dictionary helps more; the text has
the mean over its chunks weighted by length, and the least chunk. Logistic regression on the two gives the score.

`fit` takes a bounded sample: at most `PER_CLASS` labelled training documents of each class, in the order of a hash of
their ids, of at most `MAX_CHARS` characters each (longer ones are left out of the sample, never cut). Every second one
of them feeds the dictionaries, the rest calibrate, weighted to the class shares among all training labels. The model,
under 1 MB, is broadcast.

Defined cases: null texts are empty ones; an empty text has differences of 0 and the score that follows. Labels that
are null or whose document is missing are not used; of several labels of one document the least counts. With under
`LEAST` documents of either class (one to learn from and one to calibrate by) nothing can be told apart, and every score
is the smoothed share of good labels. Every row is scored for itself, repeated ids too; ties of the sample's order go to
the smaller id, and other columns play no part.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold
from .texts import map_rows

CHUNK, LEVEL, DICTIONARY = 512, 3, 112 * 1024
PER_CLASS, MAX_CHARS, LEAST = 3000, 20_000, 2


def chunks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their last bytes serve as they are."""
    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclasses.dataclass
class Model:
    bad: bytes
    good: bytes
    weights: tuple[float, ...]  # bias, mean, least
    share: float  # of good labels

    def differences(self):
        """A function from a text to its mean and least normalised difference."""
        a, b = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (self.bad, self.good))

        def of(text: str) -> tuple[float, float]:
            total, least, size = 0.0, 0.0, 0
            for k, c in enumerate(chunks(text)):
                x, y = len(a.compress(c)), len(b.compress(c))
                d = (x - y) / (x + y)
                total, size = total + d * len(c), size + len(c)
                least = d if k == 0 else min(least, d)
            return (total / size if size else 0.0), least

        return of

    def scorer(self):
        if not self.weights:
            return lambda text: (self.share,)
        of, (bias, u, v) = self.differences(), self.weights

        def score(text: str | None) -> tuple[float]:
            mean, least = of(text or "")
            return (1.0 / (1.0 + math.exp(-min(max(bias + u * mean + v * least, -40.0), 40.0))),)

        return score


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with a ridge on all but the bias, by Newton's method over standardised columns."""
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    w, damp = np.zeros(a.shape[1]), np.diag([0.0] + [ridge] * x.shape[1]) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (weight * (y - p)) - damp @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + damp + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] /= spread
    w[0] -= w[1:] @ middle
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """`docs`: doc_id, text; `labels`: doc_id, quality; `train` is a condition on doc_id."""
    marked = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}  # two rows
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    texts = {}
    for q in (0, 1):
        ids = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        found = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most per_class rows of max_chars characters
        texts[q] = [r["text"] for r in rows]
    if min(map(len, texts.values())) < LEAST:
        return Model(b"", b"", (), share)
    bad, good = (build_dictionary(texts[q][::2]) for q in (0, 1))
    model = Model(bad, good, (), share)
    of = model.differences()
    x = np.array([of(t) for q in (0, 1) for t in texts[q][1::2]])
    y = np.array([q for q in (0, 1) for _ in texts[q][1::2]], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = tuple(float(w) for w in logistic(x, y, weight))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and the score of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, keep, [text], lambda: sent.value.scorer(), [("score", T.DoubleType())])


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores of all documents by a model that learned from the labels outside fold 0."""
    model = fit(docs, labels, fold("doc_id") != 0)
    x = score(docs, model, ["doc_id"])
    return x.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
