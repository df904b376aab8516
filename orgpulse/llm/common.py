"""Helpers shared by the text operators: batches of bounded size and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A batch that crosses to Python holds about this many bytes, however long its texts are.
BATCH_BYTES = 6 << 20
_PIECE = 1 << 18  # bytes hashed by one pass of array operations; these take some 60 bytes for each
_U = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes: with a limit by rows alone, long texts would fill the memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_kept: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What a Python worker keeps for the operator `owner` between tasks. One worker serves many operators
    in turn, so whatever it kept for another one is dropped and its memory returned to the system."""
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only this C library has it
            ctypes.CDLL(None).malloc_trim(0)
        _kept[owner] = {}
    return _kept[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def per_text(function: Callable[[list[str]], pd.Series | pd.DataFrame], kind: str) -> Column:
    """A column made of the `text` column by whole batches; null texts count as empty. For the
    optimiser it is not deterministic, so that a filter on it does not compute it a second time."""

    owner = function.__module__

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series | pd.DataFrame]:
        cache(owner)
        for batch in batches:
            yield function(texts(batch))

    hints = pd.DataFrame if kind[:6] != "array<" and " " in kind else pd.Series
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[hints]}
    return F.pandas_udf(run, kind).asNondeterministic()("text")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a longer name where `df` already has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


HOT_SHARE = 1_000  # a key with at least a thousandth of the rows is hot; there are at most a thousand


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: Column, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `keyed` (one row for every key, `weight` of it being the rows that have it, of
    `total` in all). Hot keys, whose number is bounded by their share, are looked up by broadcast; only
    rows of other keys are shuffled. Both frames are read twice, so they should be staged or cheap."""
    is_hot = weight * HOT_SHARE >= total
    hot = keyed.where(is_hot)
    common = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(~is_hot), key, how)
    return common.unionByName(rest)


def texts(series: pd.Series) -> list[str]:
    """Values of a text column, null as the empty text."""
    return ["" if x is None or x is pd.NA or x != x else x for x in series.tolist()]


def slices(sizes: list[int], most: int = _PIECE) -> Iterator[slice]:
    """Runs of consecutive rows whose sizes add up to about `most`; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U))]) for b in (_BASE, inverse)
            ]
    return _powers[0], _powers[1]


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of every word of `blob`; words are parted by ASCII white space."""
    starts, hashes, at = [], [], 0
    while at < len(blob):
        end = min(len(blob), at + _PIECE)
        while end < len(blob) and not _SPACE[blob[end]]:
            end += 1
        piece = np.frombuffer(blob, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[True], _SPACE[piece], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power_tables(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[piece] * up[: len(piece)])])
            hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U)))
        starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(values: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct `width`-word shingles of each text as hashes; a text of fewer words has its
    whole sequence as one shingle, a text without words has none."""
    out: list[np.ndarray] = []
    for part in slices([len(v) for v in values]):
        chunk = values[part]
        bounds = np.cumsum([0, *[len(v) + 1 for v in chunk]])
        starts, h = word_hashes(b" ".join(chunk))
        at = np.searchsorted(starts, bounds)
        with np.errstate(over="ignore"):
            rolled = h.copy()
            for k in range(1, width):
                rolled = mix(rolled[:-1] * _U(0xD6E8FEB86659FD93) + h[k:])
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a >= width:
                    out.append(np.unique(rolled[a : b - width + 1]))
                elif b > a:
                    x = h[a : a + 1]
                    for k in range(a + 1, b):
                        x = mix(x * _U(0xD6E8FEB86659FD93) + h[k : k + 1])
                    out.append(mix(x + _U(int(b - a))))
                else:
                    out.append(h[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
