"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text becomes a short vector of transformed statistics. Counts, means and cross-products of both
classes are summed over all labelled training rows; class covariances are shrunk towards their pooled
covariance and a scaled identity. The score comes from the difference of the Mahalanobis log densities,
computed with Cholesky factors made once, and a logistic calibration on a histogram of differences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, bucket_of, per_text
from orgpulse.staging import stage

TO_POOLED = 0.15  # share of the pooled covariance in each class covariance
TO_IDENTITY = 0.05  # share of the scaled identity after that
HOLDOUT = (5, 0)
FEATURES = (
    "words", "word_length", "symbols", "upper", "exclaims", "punctuation", "digits", "distinct_words",
    "repeated_lines", "line_words", "bare_marks", "longest_word", "repeated_windows", "compressed", "tail_marks",
)
_BIN = 0.25
_EDGE = 60.0

# Byte classes: 0 other, 1 white space, 2 upper, 3 lower, 4 digit, 5 symbol, 6 exclamation, 7 punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 2, 3, 4
_KIND[list(b"#*$%&|<>=@^~_\\{}[]")] = 5
_KIND[list(b"!?")] = 6
_KIND[list(b".,;:'\"-()/")] = 7
_MARKS = b"#*$%&|<>=@^~_\\{}[]!?.,;:'\"-()/"


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text, in the order of FEATURES."""
    raw = text.encode()
    if not raw.strip():
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    ink = max(1, len(raw) - int(kinds[1]))
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = len(set(zip(words, words[1:], words[2:], strict=False)))
    bare = sum(1 for w in words if len(w) == 1 and w in _MARKS)
    tails = sum(1 for w in words if len(w) > 2 and _KIND[w[-1]] in (5, 6) and _KIND[w[-2]] in (5, 6))
    return [
        np.log1p(n),
        np.log1p(ink / n),
        np.sqrt(kinds[5] / ink),
        np.sqrt(kinds[2] / ink),
        np.sqrt(kinds[6] / ink),
        np.sqrt(kinds[7] / ink),
        np.sqrt(kinds[4] / ink),
        np.log1p(len(set(words))) - np.log1p(n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(n / len(lines)),
        np.sqrt(bare / n),
        np.log1p(int(lengths.max())),
        np.sqrt(max(0.0, 1 - windows / (n - 2))) if n > 2 else 0.0,
        np.log(len(zlib.compress(raw, 1)) / (len(raw) + 16)),
        np.sqrt(tails / n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row; null and empty texts have all zero."""
    bounded_batches(docs.sparkSession)

    def run(values: list[str]) -> pd.Series:
        return pd.Series([statistics(t) for t in values], dtype=object)

    return docs.select("doc_id", per_text(run, "array<double>").alias("x"))


@dataclass
class Discriminant:
    """Two Gaussian classes by mean and Cholesky factor, and the calibration (slope, intercept)."""

    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, with priors."""
        out = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            out.append(self.offsets[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip(self.slope * np.clip(self.difference(x), -_EDGE, _EDGE) + self.intercept, -500, 500)
        return 1 / (1 + np.exp(-t))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class count, sum and cross-products: one aggregate with a fixed number of sums."""
    d = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    out = {}
    for r in rows.groupBy("y").agg(F.count("*"), *sums).collect():
        cross = np.zeros((d, d))
        for (i, j), value in zip(pairs, r[2 + d :], strict=True):
            cross[i, j] = cross[j, i] = value
        out[r[0]] = (float(r[1]), np.array(r[2 : 2 + d]), cross)
    return out


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", holdout: tuple[int, int] | None = HOLDOUT) -> Discriminant:
    """Learn from all rows of `stats` (doc_id, x) that `labels` (doc_id, `label`) marks 0 or 1; with
    `holdout` = (m, r) those with crc32(id) mod m = r are left out. A class without rows gets the
    pooled mean, so that scores are flat."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    if holdout:
        marked = marked.where(bucket_of("doc_id", holdout[0]) != holdout[1])
    rows = stage(stats.join(marked, "doc_id").select("y", "x"), "labelled")
    got = _moments(rows)
    d = len(FEATURES)
    empty = (0.0, np.zeros(d), np.zeros((d, d)))
    parts = [got.get(k, empty) for k in (0, 1)]
    total = max(1.0, sum(p[0] for p in parts))
    middle = sum(p[1] for p in parts) / total
    means = [p[1] / p[0] if p[0] else middle for p in parts]
    within = [p[2] - p[0] * np.outer(m, m) for p, m in zip(parts, means, strict=True)]
    pooled = sum(within) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, offsets = [], []
    for p, w in zip(parts, within, strict=True):
        cov = (1 - TO_POOLED) * w / max(p[0], 1.0) + TO_POOLED * pooled if p[0] > d else pooled
        cov = cov / np.outer(scale, scale)
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower) / scale)
        offsets.append(np.log((p[0] + 1) / (total + 2)) - np.log(np.diag(lower)).sum())
    model = Discriminant(np.array(means), np.array(factors), np.array(offsets))
    if all(p[0] for p in parts):
        model.slope, model.intercept = _calibrate(rows, model)
    return model


def _calibrate(rows: DataFrame, model: Discriminant) -> tuple[float, float]:
    """Logistic fit of the label on the difference, from a histogram of fixed size."""

    @F.pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        t = model.difference(np.array(x.tolist()).reshape(-1, len(FEATURES)))
        return pd.Series(np.floor(np.clip(t, -_EDGE, _EDGE) / _BIN).astype(int))

    counted = rows.select("y", bin_of("x").alias("b")).groupBy("y", "b").agg(F.count("*").alias("n")).collect()
    t = np.array([[(r["b"] + 0.5) * _BIN, 1.0] for r in counted])
    y, n = np.array([r["y"] for r in counted], float), np.array([r["n"] for r in counted], float)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        hess = (t * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ t + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, t.T @ (n * (y - p)) - 1e-6 * w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def quality(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] | None = HOLDOUT) -> DataFrame:
    """(doc_id, score) of every row; score 0 to 1, higher for better. Null and empty texts are scored
    by their zero statistics; repeated rows are scored each."""
    stats = stage(with_statistics(docs), "statistics")
    model = fit(stats, labels, holdout=holdout)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist()).reshape(-1, len(FEATURES))))

    return stats.select("doc_id", score("x").alias("score"))
