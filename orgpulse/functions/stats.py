"""Exact order statistics of a distributed column set.

`percentile`/`median` keep every distinct value of a column in one aggregator, which a continuous
column of a large report does not fit. Here a position is first bracketed: a quantile sketch
proposes an interval, one counting pass tells exactly how many values lie below and inside it, and
only the rows of that interval are sorted. The sketch decides how narrow the interval is, never the
answer. No pass shuffles more than a few counters per column until the last one, which touches only
bracketed rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one bracket that a single sort task is allowed to hold.
BRACKET_ROWS = 2_000_000
SKETCH_ACCURACY = 10_000


# Separates a group from a column in the name of a grouped column; no group name holds it.
SEPARATOR = "\x1f"


def grouped_name(by: Column | None, name: str) -> Column:
    """The name a value goes by: that of its column, after its group where there are groups."""
    return F.lit(name) if by is None else F.concat(by.cast("string"), F.lit(SEPARATOR + name))


@dataclass(frozen=True)
class Order:
    """One order statistic: its value, the number of smaller values, and its multiplicity."""

    value: float
    before: int
    count: int


@dataclass(frozen=True)
class _Bracket:
    """Open interval (low, high) of a column that still holds wanted positions (1-based)."""

    column: str
    low: float
    high: float
    before: int
    size: int
    positions: tuple[int, ...]


def _local(df: DataFrame, table: pa.Table) -> DataFrame:
    return df.sparkSession.createDataFrame(table)


def long_values(
    df: DataFrame, keys: Sequence[str], columns: dict[str, Column], by: Column | None = None
) -> DataFrame:
    """(keys, name, value) with one row per non-null value, rows without a group left out."""
    named = [F.struct(grouped_name(by, n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()]
    long = df.select(*keys, F.inline(F.array(*named))).where(F.col("value").isNotNull())
    return long if by is None else long.where(F.col("name").isNotNull())


def _counts(df: DataFrame, columns: dict[str, Column], by: Column | None) -> dict[str, int]:
    counts = [F.count(c).alias(n) for n, c in columns.items()]
    if by is None:
        row = df.agg(*counts).first()
        return {n: row[n] for n in columns}
    rows = df.where(by.isNotNull()).groupBy(by.cast("string").alias("group")).agg(F.struct(*counts).alias("n")).collect()
    return {r["group"] + SEPARATOR + n: r["n"][n] for r in rows for n in columns}


def _bracket_table(df: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """A handful of rows per requested column, so always safe to broadcast."""
    return F.broadcast(
        _local(
            df,
            pa.table(
                {
                    "b_name": [b.column for b in brackets],
                    "b_no": list(range(len(brackets))),
                    "b_low": [b.low for b in brackets],
                    "b_high": [b.high for b in brackets],
                    "b_before": [b.before for b in brackets],
                    "b_positions": pa.array([list(b.positions) for b in brackets], pa.list_(pa.int64())),
                }
            ),
        )
    )


def _inside(
    df: DataFrame, columns: dict[str, Column], by: Column | None, brackets: Sequence[_Bracket]
) -> DataFrame:
    used = {b.column.rpartition(SEPARATOR)[2] for b in brackets}
    rows = long_values(df, [], {n: c for n, c in columns.items() if n in used}, by)
    on = (F.col("name") == F.col("b_name")) & (F.col("value") > F.col("b_low")) & (F.col("value") < F.col("b_high"))
    return rows.join(_bracket_table(df, brackets), on).select("b_no", "value")


def _narrow(
    df: DataFrame, columns: dict[str, Column], by: Column | None, brackets: Sequence[_Bracket]
) -> tuple[list[_Bracket], dict[tuple[str, int], Order]]:
    """One sketch pass and one counting pass over the given brackets."""
    found: dict[tuple[str, int], Order] = {}
    asked: dict[int, list[float]] = {}
    for no, b in enumerate(brackets):
        step = 2.0 / SKETCH_ACCURACY
        shares = set()
        for p in b.positions:
            q = (p - b.before) / b.size
            shares |= {min(max(q - step, 0.0), 1.0), min(max(q + step, 0.0), 1.0)}
        asked[no] = sorted(shares)
    all_shares = sorted({s for shares in asked.values() for s in shares})
    sketch = (
        _inside(df, columns, by, brackets)
        .groupBy("b_no")
        .agg(F.percentile_approx("value", all_shares, SKETCH_ACCURACY).alias("q"))
        .collect()
    )
    edges: dict[int, list[float]] = {}
    for r in sketch:
        by_share = dict(zip(all_shares, r["q"]))
        edges[r["b_no"]] = sorted({by_share[s] for s in asked[r["b_no"]]})

    table = F.broadcast(
        _local(
            df,
            pa.table(
                {
                    "e_no": [no for no, es in edges.items() for _ in es],
                    "edge": [e for es in edges.values() for e in es],
                }
            ),
        )
    )
    counted = (
        _inside(df, columns, by, brackets)
        .join(table, F.col("b_no") == F.col("e_no"))
        .groupBy("b_no", "edge")
        .agg(
            F.count_if(F.col("value") < F.col("edge")).alias("below"),
            F.count_if(F.col("value") == F.col("edge")).alias("equal"),
        )
        .collect()
    )
    stat = {(r["b_no"], r["edge"]): (r["below"], r["equal"]) for r in counted}

    rest: list[_Bracket] = []
    for no, b in enumerate(brackets):
        low, before = b.low, b.before
        pieces: list[tuple[float, float, int, int]] = []
        for e in edges[no]:
            below, equal = stat[(no, e)]
            at = b.before + below
            pieces.append((low, e, before, at - before))
            for p in b.positions:
                if at < p <= at + equal:
                    found[(b.column, p)] = Order(e, at, equal)
            low, before = e, at + equal
        pieces.append((low, b.high, before, b.before + b.size - before))
        for lo, hi, start, size in pieces:
            inside = tuple(p for p in b.positions if start < p <= start + size)
            if inside:
                rest.append(_Bracket(b.column, lo, hi, start, size, inside))
    return rest, found


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    positions: Callable[[str, int], Sequence[int]],
    bracket_rows: int = BRACKET_ROWS,
    by: Column | None = None,
) -> tuple[dict[str, int], dict[tuple[str, int], Order]]:
    """Exact values at 1-based sorted positions of several nullable columns.

    `positions(name, n)` gets the number of non-null values and returns the wanted positions.
    Returns the non-null counts and the statistic for every (name, position). With `by`, a column of
    few distinct values, each group's part of a column is a column of its own, named after both; all
    groups share the same passes, and rows without a group belong to none.
    """
    sizes = _counts(df, columns, by)
    brackets = []
    for name, n in sizes.items():
        wanted = tuple(sorted({p for p in positions(name, n) if 1 <= p <= n}))
        if wanted:
            # NaN sorts after +inf in Spark, so the open interval also covers infinite values.
            brackets.append(_Bracket(name, -math.inf, math.nan, 0, n, wanted))
    found: dict[tuple[str, int], Order] = {}
    while any(b.size > bracket_rows for b in brackets):
        wide = [b for b in brackets if b.size > bracket_rows]
        narrowed, hit = _narrow(df, columns, by, wide)
        found |= hit
        brackets = [b for b in brackets if b.size <= bracket_rows] + narrowed
    if brackets:
        w = Window.partitionBy("b_no").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        hits = F.exists("b_positions", lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("c")))
        rows = (
            _inside(df, columns, by, brackets)
            .groupBy("b_no", "value")
            .agg(F.count(F.lit(1)).alias("c"))
            .withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))
            .join(_bracket_table(df, brackets), "b_no")
            .withColumn("before", F.col("b_before") + F.col("below"))
            .where(hits)
            .select("b_no", "value", "before", "c")
            .collect()
        )
        for r in rows:
            b = brackets[r["b_no"]]
            for p in b.positions:
                if r["before"] < p <= r["before"] + r["c"]:
                    found[(b.column, p)] = Order(r["value"], r["before"], r["c"])
    return sizes, found


def _quantile_positions(q: float, n: int) -> tuple[int, int, float]:
    at = q * (n - 1)
    low = int(math.floor(at))
    return low + 1, min(low + 2, n), at - low


Quantiles = dict[tuple[str, float], float | None]
Cuts = dict[str, tuple[float, ...]]
Wanted = dict[str, tuple[Column, Sequence[float]]]


def _near(share: float, n: int) -> range:
    """The positions that can hold the last value within a share."""
    at = math.floor(share * n)
    return range(max(at - 1, 1), min(at + 2, n) + 1)


def _quantiles_and_cuts(
    df: DataFrame, wanted: Wanted, cuts: Wanted, bracket_rows: int, by: Column | None
) -> dict[str, tuple[Quantiles, Cuts]]:
    """Both kinds of statistics by group; without groups, those of the group without a name."""
    columns = {f"q {n}": c for n, (c, _) in wanted.items()} | {f"c {n}": c for n, (c, _) in cuts.items()}

    def positions(name: str, n: int) -> list[int]:
        kind, _, column = name.rpartition(SEPARATOR)[2].partition(" ")
        if kind == "q":
            return [p for q in wanted[column][1] for p in _quantile_positions(q, n)[:2]]
        return [p for s in cuts[column][1] for p in _near(s, n)]

    sizes, found = order_statistics(df, columns, positions, bracket_rows, by)

    def quantile(name: str, q: float) -> float | None:
        if not sizes[name]:
            return None
        lo, hi, share = _quantile_positions(q, sizes[name])
        a, b = found[(name, lo)].value, found[(name, hi)].value
        # The same two-sided interpolation numpy uses, so equal inputs give equal doubles.
        step = b - a
        return a + step * share if share < 0.5 else b - step * (1 - share)

    def cut(name: str, share: float) -> float:
        n = sizes[name]
        around = [found[(name, p)] for p in _near(share, n)]
        within = [o.value for o in around if (o.before + (o.count + 1) / 2) / n <= share]
        if within:
            return max(within)
        # Everything below the nearest tie group is within the share, the group itself is not.
        return float(np.nextafter(min(o.value for o in around), -np.inf)) if around else -math.inf

    prefixes = {name.rpartition(SEPARATOR)[0]: name[: name.rfind(SEPARATOR) + 1] for name in sizes}
    return {
        group: (
            {(n, q): quantile(f"{prefix}q {n}", q) for n, (_, qs) in wanted.items() for q in qs},
            {n: tuple(cut(f"{prefix}c {n}", s) for s in shares) for n, (_, shares) in cuts.items()},
        )
        for group, prefix in prefixes.items()
    }


def quantiles_and_cuts(
    df: DataFrame, wanted: Wanted, cuts: Wanted, bracket_rows: int = BRACKET_ROWS
) -> tuple[Quantiles, Cuts]:
    """Both kinds of statistics (see :func:`quantiles`, :func:`percentile_cuts`) in the same passes."""
    return _quantiles_and_cuts(df, wanted, cuts, bracket_rows, None).get("", ({}, {}))


def grouped_quantiles_and_cuts(
    df: DataFrame, by: Column, wanted: Wanted, cuts: Wanted, bracket_rows: int = BRACKET_ROWS
) -> dict[str, tuple[Quantiles, Cuts]]:
    """The same by group, keyed by the group as text, in as many passes as one group takes. The driver
    holds some numbers for every group and column, so `by` has to be a column of few values."""
    return _quantiles_and_cuts(df, wanted, cuts, bracket_rows, by)


def quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, Sequence[float]]],
    bracket_rows: int = BRACKET_ROWS,
) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles; null where the column holds no value."""
    return quantiles_and_cuts(df, wanted, {}, bracket_rows)[0]


def percentile_cuts(
    df: DataFrame,
    columns: dict[str, Column],
    shares: Sequence[float],
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, tuple[float, ...]]:
    """For each share, the cut such that `value <= cut` holds exactly when the value's average-rank
    percentile among the non-null values is at most the share.

    A level that is a step function of the percentile therefore needs no per-row rank at all.
    """
    return quantiles_and_cuts(df, {}, {n: (c, shares) for n, c in columns.items()}, bracket_rows)[1]
