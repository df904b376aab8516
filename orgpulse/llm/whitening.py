"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. Every pass over the fit list multiplies a thin block Q by it:
tasks centre their vectors, compute the two products of X'(XQ) and add up one small matrix each. A
polynomial recurrence of such passes damps the eigenvalues below the block's own (Chebyshev polynomials
are small on the damped interval and grow fastest outside), then QR and Rayleigh-Ritz give new vectors.
That is repeated until the residuals of the wanted vectors reach the floor of double precision and a
short Lanczos run on the complement of the block finds nothing above them.

The fit list (every distinct integer vector once) is staged as packed blocks of integers, so a pass
reads a few binary rows for each task. What reaches the driver is one matrix of dimension x block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, free_name
from orgpulse.staging import stage

COMPONENTS = 4
GUARD = 20  # further vectors of the block: the more, the faster the wanted ones converge
DEGREE = 12  # passes of one polynomial
LANCZOS = 8  # passes that bound the spectrum, and passes that look for what was missed
BLOCK_ROWS = 4096  # vectors of one packed block
SCALE = 256
FLOOR = 1e-14  # residual, relative to the largest eigenvalue, that counts as zero
NEAR_FLOOR = 1e-11  # below it, a residual that no longer halves has reached the floor
ROUNDS = 60  # more are never needed unless eigenvalues coincide beyond the block


@dataclass(frozen=True)
class Whitening:
    """Rows of `vectors` are unit eigenvectors, `values` their eigenvalues, both by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(embeddings: DataFrame, column: str) -> DataFrame:
    """Rows whose vector and entries are neither null nor infinite nor NaN."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where(F.col(column).isNotNull()).where(~bad)


def scaled(column: str | Column, dimension: int | None = None) -> Column:
    """floor(256 * c) of every entry as long; shorter vectors are filled up with zeros."""
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    if dimension is None:
        return x
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size(x)))


def packed(fit: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(x): the vectors of the column `x` (array of long) as blocks of little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            width = len(flat) // max(1, len(lists))
            for first in range(0, len(lists), rows):
                part = flat[first * width : (first + rows) * width].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["x"])

    return fit.select("x").mapInArrow(run, "x binary")


def summed(blocks: DataFrame, dimension: int, size: int, kind: str, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `add(vectors)` over all blocks: an array of `size` numbers. Tasks add up their own
    blocks, then the numbers are added up by place, so nothing grows with the number of tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for b in batches:
            for x in b["x"]:
                total += add(np.frombuffer(x, "<i8").reshape(-1, dimension))
        yield pd.DataFrame({"v": [total]})

    parts = blocks.mapInPandas(run, f"v array<{kind}>")
    rows = parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


class Covariance:
    """The covariance of the fit list as an operator: `times(Q)` is one distributed pass."""

    def __init__(self, blocks: DataFrame, dimension: int) -> None:
        self.blocks, self.dimension = blocks, dimension
        found = summed(blocks, dimension, dimension + 1, "long", lambda x: np.append(x.sum(axis=0), len(x)))
        self.n, self.sums = int(found[-1]), found[:-1]
        self.mean = self.sums / max(1, self.n)

    def times(self, q: np.ndarray) -> np.ndarray:
        mean, shape = self.mean, q.shape

        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()

        return summed(self.blocks, self.dimension, q.size, "double", product).reshape(shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(summed(self.blocks, self.dimension, 1, "double", lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / self.n


def lanczos(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, their residual bounds and Ritz vectors after at most `steps` passes."""
    basis, alpha, beta = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):  # orthogonal to all before, twice for precision
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-13 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    m = len(alpha)
    values, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
    return values, beta[-1] * np.abs(s[-1]), np.array(basis[:m]).T @ s


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the operator that is small on [low, high], applied to `q` by its
    three-term recurrence, scaled so that an eigenvalue at `top` keeps its size."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def eigenvectors(
    cov: Covariance, components: int, guard: int = GUARD, degree: int = DEGREE, steps: int = LANCZOS
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors (as rows)."""
    d = cov.dimension
    rng = np.random.default_rng(20)
    width = min(d, components + guard)
    bounds, errors, _ = lanczos(cov.times, rng.standard_normal(d), steps)
    low = max(0.0, float((bounds - errors).min()))
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        y = cov.times(q)
        t = q.T @ y
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        q, y = q @ s, y @ s
        wanted = min(components, width)
        scale = max(values[0], 0.0)
        residual = float(np.linalg.norm(y[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        if scale == 0 or residual <= FLOOR * scale or last <= NEAR_FLOOR * scale and residual > last / 2:
            missed = _missed(cov, q, values[wanted - 1], rng, steps)
            if missed is None:
                return values[:wanted], q[:, :wanted].T
            q[:, -1] = missed  # the block takes the vector that it had missed
            last = np.inf
        else:
            last = residual
        if width == d:  # the block is the whole space, and Rayleigh-Ritz alone is exact
            q = np.linalg.qr(q)[0]
            continue
        high = float(values[-1])
        floor = min(low, high * (1 - 1e-6))
        q = np.linalg.qr(filtered(cov.times, q, floor, high, float(values[0]) * (1 + 1e-12) + 1e-300, degree))[0]
    raise ArithmeticError(f"the residual stays at {residual / scale:.1e} of the largest eigenvalue")


def _missed(cov: Covariance, q: np.ndarray, least: float, rng: np.random.Generator, steps: int) -> np.ndarray | None:
    """A unit vector outside the block `q` with a Ritz value beyond the `least` wanted eigenvalue, if a
    Lanczos run on the complement from a random start finds one."""
    if q.shape[1] == len(q):
        return None

    def outside(v: np.ndarray) -> np.ndarray:
        return v - q @ (q.T @ v)

    values, errors, vectors = lanczos(lambda v: outside(cov.times(outside(v))), outside(rng.standard_normal(len(q))), steps)
    return vectors[:, -1] if values[-1] - errors[-1] > least * (1 + 1e-10) else None


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table; None where no vector is left or all are the same.

    The fit list is every distinct integer vector once, however often it occurs."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    whole = whole_vectors(embeddings, column)
    dimension = whole.agg(F.max(F.size(column))).first()[0] or 0
    if dimension == 0:
        return None
    blocks = stage(packed(whole.select(scaled(column, dimension).alias("x")).distinct()), "fitlist")
    cov = Covariance(blocks, dimension)
    trace = cov.trace()
    if trace <= 0:
        return None
    values, vectors = eigenvectors(cov, min(components, dimension))
    some = values > trace * 1e-13  # a dimension without variance cannot be whitened
    values, vectors = values[some], vectors[some]
    k, mean, turn = len(values), cov.mean, (vectors / np.sqrt(values)[:, None]).T

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = summed(blocks, dimension, k + k * k, "double", moments) / cov.n
    second = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(second - np.eye(k)).max()) if k else 0.0
    return Whitening(cov.n, cov.sums, values, vectors, trace, error)


def whiten(embeddings: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Rows with a whole vector, with new last columns `deviation` (long, exact) and `whitened` (array of
    double, one for each component). A sum beyond 64 bits is an error, never a wrong number."""
    n, sums, mean = model.n, model.sums, model.sums / model.n
    turn = (model.vectors / np.sqrt(model.values)[:, None]).T
    d = len(sums)

    def run(x: pd.Series) -> pd.DataFrame:
        v = np.concatenate(x.to_list()).reshape(-1, d) if len(x) else np.zeros((0, d), np.int64)
        far = np.abs(v).max(initial=0) * float(n) + np.abs(sums).max(initial=0)
        if d * far * far >= 2.0**63:
            # The bound of all is too rough: add up with Python's integers.
            exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in v]
            deviation = np.array(exact, dtype=np.int64)  # raises OverflowError beyond 64 bits
        else:
            deviation = ((v * n - sums) ** 2).sum(axis=1)
        return pd.DataFrame({"deviation": deviation, "whitened": list((v - mean) @ turn)})

    own = F.pandas_udf(run, "deviation long, whitened array<double>")
    whole = whole_vectors(embeddings, column)
    name = free_name(embeddings, "m")
    return (
        whole.withColumn(name, own(scaled(column, d)))
        .withColumns(
            {free_name(embeddings, "deviation"): F.col(f"{name}.deviation"), free_name(embeddings, "whitened"): F.col(f"{name}.whitened")}
        )
        .drop(name)
    )


RESULT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whitened_components(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for every whole vector and component: (id, component, n, deviation, whitened, explained,
    identity_error).

    Rows whose vector is null or holds null, NaN or infinite entries are left out; rows with a null id
    stay, repeated rows repeat their result, other columns are ignored. Vectors shorter than the longest
    count as filled up with zeros. Components without variance are left out: a table without whole
    vectors, or with one distinct vector, gives no rows. Where eigenvalues are equal, any orthonormal
    vectors of their space are right; those given are the same for all rows."""
    spark = embeddings.sparkSession
    narrow = embeddings.select(F.col(id_column), F.col(column))
    model = fit(narrow, column)
    if model is None:
        kind = narrow.schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"{id_column} {kind}, {RESULT}")
    made = whiten(narrow, model, column)
    deviation, values = made.columns[-2], made.columns[-1]
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return made.select(id_column, deviation, F.posexplode(values).alias("at", "w")).select(
        id_column,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col(deviation).alias("deviation"),
        F.col("w").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
