"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import long_texts

BUCKETS = 1024  #: hashed byte trigrams
SLOTS = BUCKETS + 3  #: and: a word repeats the one before it; upper-case words; no words at all
FIT_ROWS = 6000  #: bound on the labelled rows that a model is fitted on; the least by hash of their id
GRADES = 3
THRESHOLD = 0.5
PRIOR_BYTES = 50  #: a text's frequencies are drawn toward the mean as if it had so many more bytes
SHAPE = 10.0  #: how much wider the prior of the shape features is


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices of the hashed features of a whole text, their frequencies, and how far to trust them: a short text says little."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return np.array([BUCKETS + 2]), np.array([1.0]), 1.0
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(22)
    counts = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    same = sum(map(eq, words, words[1:])) / len(words)
    upper = sum(map(bytes.isupper, words)) / len(words)
    return np.concatenate((at, [BUCKETS, BUCKETS + 1])), np.concatenate((counts[at] / len(h), [same, upper])), len(h) / (len(h) + PRIOR_BYTES)


def dense(text: str | None) -> np.ndarray:
    """Frequencies of all features, then the trust."""
    row = np.zeros(SLOTS + 1, np.float32)
    at, weight, trust = profile(text)
    row[at], row[SLOTS] = weight, trust
    return row


class CumulativeLink:
    """P(grade >= k) = sigmoid(trust * w.(x - centre) - threshold_k): weights shared by all grades, thresholds in order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, offset: float = 0.0):
        self.weights, self.thresholds, self.offset = weights, thresholds, offset

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, grades: int = GRADES, steps: int = 300, l2: float = 3e-2) -> CumulativeLink:
        """Full-batch Adam on the exact likelihood; thresholds are a first one plus positive gaps."""
        if not len(x):
            return cls(np.zeros(SLOTS), np.full(grades - 1, -20.0))
        trust, x = (x[:, SLOTS:], x[:, :SLOTS]) if x.shape[1] == SLOTS + 1 else (np.ones((len(x), 1), x.dtype), x)
        centre = x.mean(axis=0)
        z = (x - centre) * trust
        scale = np.maximum(z.std(axis=0), 1e-4)
        scale[BUCKETS:] /= SHAPE  # the few features of shape are penalised less
        z = z / scale
        share = np.clip([(y >= k).mean() for k in range(1, grades)], 1e-3, 1 - 1e-3)
        start = np.minimum.accumulate(np.log(share / (1 - share)))
        p = np.concatenate((np.zeros(z.shape[1]), [-start[0]], np.log(np.maximum(start[:-1] - start[1:], 1e-2))))
        m, v, d = np.zeros_like(p), np.zeros_like(p), z.shape[1]
        z = z.astype(np.float32)
        for step in range(1, steps + 1):
            gaps = np.exp(np.minimum(p[d + 1 :], 5))
            cut = np.concatenate(([-np.inf], p[d] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
            f = z @ p[:d].astype(np.float32)
            over, under = cut[y + 1] - f, cut[y] - f
            s_over, s_under = 1 / (1 + np.exp(-np.clip(over, -30, 30))), 1 / (1 + np.exp(-np.clip(under, -30, 30)))
            mass = np.maximum(s_over - s_under, 1e-9)
            g_over, g_under = np.where(np.isinf(over), 0, s_over * (1 - s_over)) / mass, np.where(np.isinf(under), 0, s_under * (1 - s_under)) / mass
            grad_f = g_over - g_under
            g_cut = np.array([-(g_over[y == k - 1].sum() - g_under[y == k].sum()) for k in range(1, grades)]) / len(y)
            grad = np.concatenate((z.T @ grad_f.astype(np.float32) / len(y) + l2 * p[:d], [g_cut.sum()], [g_cut[k:].sum() * gaps[k - 1] for k in range(1, grades - 1)]))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = p[:d] / scale
        cut = p[d] + np.concatenate(([0.0], np.cumsum(np.exp(np.minimum(p[d + 1 :], 5)))))
        return cls(w, cut, float(centre @ w))

    def tails(self, text: str | None) -> np.ndarray:
        at, weight, trust = profile(text)
        return 1 / (1 + np.exp(-np.clip(trust * (float(self.weights[at] @ weight) - self.offset) - self.thresholds, -30, 30)))


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings (doc_id, grade): 0 poor, 1 good but toxic, 2 good. A null quality is no rating, a null toxic is 0; of several rows of an id the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never fitted on: crc32 of the id as text leaves 2 on division by 4. A null id is not held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def one_text_each(docs: DataFrame, some: DataFrame) -> DataFrame:
    """The texts of ``some(doc_id, ...)``, of bounded size; of several texts of one id the least, whatever order rows come in."""
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    others = [c for c in some.columns if c != "doc_id"]
    return rows.groupBy("doc_id", *others).agg(F.min("text").alias("text"))


def fit(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS) -> CumulativeLink:
    """Fit on ``ratings(doc_id, grade)``: at most ``fit_rows`` of them, which alone reach the driver, as features."""
    some = ratings.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = one_text_each(docs, some)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [dense(t).tobytes() for t in frame["text"]], "grade": frame["grade"]})

    got = long_texts(rows).mapInPandas(features, "doc_id long, x binary, grade int").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, SLOTS + 1)
    return CumulativeLink.fit(x, got["grade"].to_numpy())


def score(docs: DataFrame, model: CumulativeLink, text_col: str = "text") -> DataFrame:
    """``docs`` plus expected_grade and p_grade (array: P(grade >= 1), P(grade >= 2), ...), from whole texts.

    A null or empty text is scored by its own feature. Repeated rows are scored alike; an empty
    table gives an empty result; columns of these names are replaced.
    """
    held = long_texts(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def tails(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: held.value.tails(t).tolist())

    out = docs.withColumn("p_grade", tails(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("expected_grade", F.aggregate("p_grade", F.lit(0.0), lambda s, p: s + p))


def accept(docs: DataFrame, model: CumulativeLink, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tail probability P(grade >= 1) reaches ``threshold``, columns as they were."""
    held = long_texts(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def first_tail(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(held.value.tails(t)[0])).astype("float64")

    return docs.where(first_tail(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
