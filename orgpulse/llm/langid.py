"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (one to three letters, whole text, presence
only) that both have, among those of the landmarks, divided by the root of their own numbers. Nyström
landmarks are whole training texts of every language; one-versus-rest kernel ridge regression is solved
in their feature space, and documents are scored by batched products of a presence matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, bucket_of, free_name, per_text, slices, texts

LANDMARKS = 160  # in all; at least 4 of each language
SAMPLE = 400  # training texts per language, about (chosen by a hash of the id)
RIDGE = 1e-3
UNKNOWN = "und"
_CLASSES = 128
_DOCS = 64  # rows of one presence matrix
_LETTERS = 1 << 18  # characters of one pass

_class_table: list[np.ndarray] = []


def _classes(points: np.ndarray) -> np.ndarray:
    """Letter class of code points: 0 for all but letters, a-z apart, other letters by a hash."""
    if not _class_table:
        table = np.zeros(0x10000, np.int32)
        letters = np.array([c for c in range(0x10000) if chr(c).isalpha()], np.int64)
        table[letters] = 27 + letters * 2654435761 % 4294967291 % (_CLASSES - 27)
        table[97:123] = np.arange(1, 27)
        _class_table.append(table)
    out = _class_table[0][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = 27 + int(points[i]) * 2654435761 % 4294967291 % (_CLASSES - 27) if chr(points[i]).isalpha() else 0
    return out


def gram_codes(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of every n-gram that holds a letter, and which rows have letters."""
    points = [np.frombuffer(v.lower().encode("utf-32-le"), np.uint32) for v in values]
    size = [len(p) + 2 for p in points]
    flat = np.zeros(sum(size), np.int32)
    row = np.repeat(np.arange(len(values)), size)
    at = 0
    for p, n in zip(points, size, strict=True):
        flat[at : at + n - 2] = _classes(p)
        at += n
    c1, c2, c3 = flat[:-2], flat[1:-1], flat[2:]
    r = row[:-2]
    codes, rows = [], []
    for code, ok in (
        (c1, c1 > 0),
        (_CLASSES + c1 * _CLASSES + c2, (c1 > 0) | (c2 > 0)),
        (_CLASSES + _CLASSES**2 + (c1 * _CLASSES + c2) * _CLASSES + c3, (c2 > 0) | (c1 > 0) & (c3 > 0)),
    ):
        codes.append(code[ok])
        rows.append(r[ok])
    return np.concatenate(rows), np.concatenate(codes), np.bincount(r[c1 > 0], minlength=len(values)) > 0


@dataclass
class Model:
    """Landmark presence matrix and ridge weights."""

    languages: list[str]
    column: np.ndarray  # code -> column of the presence matrix, -1 if no landmark has it
    landmarks: np.ndarray  # (columns, landmarks), normalised
    weights: np.ndarray  # (landmarks + 1, languages)

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(values), np.zeros(len(values))
        if not self.languages:
            return names, scores
        done = 0
        for part in slices([max(len(v), _LETTERS // _DOCS) for v in values], _LETTERS):
            rows, codes, has = gram_codes(values[part])
            margin = kernel(rows, codes, len(has), self.column, self.landmarks) @ self.weights[:-1] + self.weights[-1]
            share = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            best = margin.argmax(axis=1)
            for i in np.flatnonzero(has):
                names[done + i] = self.languages[best[i]]
                scores[done + i] = share[i, best[i]]
            done += len(has)
        return names, scores


def kernel(rows: np.ndarray, codes: np.ndarray, n: int, column: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of `n` texts with all landmarks."""
    at = column[codes]
    seen = np.zeros((n, len(landmarks)), np.float32)
    seen[rows[at >= 0], at[at >= 0]] = 1
    own = np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
    return seen @ landmarks / own


def fit(docs: DataFrame, holdout: tuple[int, int] | None = (4, 2), landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, lang). `holdout` = (m, r): rows with crc32(id) mod m = r are not used.

    About `sample` whole texts per language train the model; the driver gets their distinct n-gram
    codes, not the texts. Rows without language are not used."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    if holdout:
        known = known.where(bucket_of("doc_id", holdout[0]) != holdout[1])
    bounded_batches(docs.sparkSession)
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(spread))
    # One aggregate row per language: language labels are a small set of codes.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32))
    limit = F.create_map(*[F.lit(x) for k in names for x in (k, int(min(1.0, sample / counts[k]) * spread))])

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in texts(b["text"]):
                found.append(np.unique(gram_codes([t])[1]).astype(np.int32))
            yield pd.DataFrame({"lang": b["lang"], "draw": b["draw"], "codes": found})

    chosen = known.withColumn("draw", draw).where(F.col("draw") < limit[F.col("lang")])
    rows = chosen.mapInPandas(codes, "lang string, draw long, codes array<int>").orderBy("draw").collect()
    return _solve(names, [(r["lang"], np.array(r["codes"], np.int64)) for r in rows if r["codes"]], landmarks)


def _solve(names: list[str], rows: list[tuple[str, np.ndarray]], landmarks: int) -> Model:
    each = max(4, landmarks // len(names))
    marks = [c for name in names for c in [c for lang, c in rows if lang == name][:each]]
    width = _CLASSES + _CLASSES**2 + _CLASSES**3
    column = np.full(width, -1, np.int32)
    grams = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    column[grams] = np.arange(len(grams))
    basis = np.zeros((len(grams), len(marks)), np.float32)
    for k, c in enumerate(marks):
        basis[column[c], k] = 1 / np.sqrt(len(c))
    flat = np.concatenate([c for _, c in rows]) if rows else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(rows)), [len(c) for _, c in rows])
    values = np.concatenate(
        [
            kernel(at[(at >= k) & (at < k + 256)] - k, flat[(at >= k) & (at < k + 256)], min(256, len(rows) - k), column, basis)
            for k in range(0, len(rows), 256)
        ]
        or [np.zeros((0, len(marks)), np.float32)]
    ).astype(np.float64)
    own, vectors = np.linalg.eigh(basis.astype(np.float64).T @ basis.astype(np.float64))
    usable = own > 1e-6 * max(own.max(initial=0), 1e-12)
    root = vectors[:, usable] / np.sqrt(own[usable])
    features = np.hstack([values @ root, np.ones((len(rows), 1))])
    targets = np.array([[1.0 if lang == name else -1.0 for name in names] for lang, _ in rows]).reshape(-1, len(names))
    gram = features.T @ features + RIDGE * max(len(rows), 1) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ targets)
    return Model(names, column, basis, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a struct column `found` (lang_pred, score) from `text` alone.

    A null text or one without letters gives `und` with score 0. A clash with a column `found` is
    avoided by underscores; the new column is the last."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(values: list[str]) -> pd.DataFrame:
        names, scores = shared.value.predict(values)
        return pd.DataFrame({"lang_pred": names, "score": scores.astype(float)})

    return docs.withColumn(free_name(docs, "found"), per_text(run, "lang_pred string, score double"))


def identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """`docs` without documents of unknown language or with a score below `min_score`.

    A model that knows no language (no row to learn from had one) cannot tell them apart: then every
    text with a letter stays, and a `min_score` above 0 is an error."""
    if not model.languages:
        if min_score > 0:
            raise ValueError("no row to learn from has a language, so no text has a score: min_score must be 0")
        return docs.where(F.col("text").rlike(r"\p{L}"))
    marked = with_language(docs, model)
    found = marked.columns[-1]
    sure = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= min_score)
    return marked.where(sure).drop(found)
