"""Average-rank percentiles for several columns at once, without a global window.

Of every row: one exchange by value range, ranks inside a range, and the exact number of rows before the
range. Of every distinct value: a value histogram, cut into ranges, with a running sum inside each. Ranges
only balance the work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.functions.stats import SEPARATOR, long_values
from orgpulse.staging import PARTITIONS

# Rows or distinct values of a column that one task may rank before they are cut into ranges.
RANGE_ROWS = 250_000
# Rows of all ranges that one task ranks, about; a task of a join by value takes fewer, wide ones.
RANKED_ROWS = 250_000
LOOKED_UP_ROWS = 50_000
MAX_RANGES = 1024
# A value holding at least 1/HOT_SHARE of a column's rows is looked up by broadcast; there can be
# at most HOT_SHARE such values per column, whatever the size of the data.
HOT_SHARE = 2_000
# A value with at least 1/NOTICEABLE of a column's rows is ranked by counts, without an exchange of its rows.
NOTICEABLE = 500


def _range_edges(long: DataFrame, ranges: int) -> DataFrame:
    """Two-level search table per column: coarse edges, and fine edges inside each coarse cell."""
    side = max(2, math.ceil(math.sqrt(ranges)))
    total = side * side
    shares = [i / total for i in range(1, total)]
    rows = long.groupBy("name").agg(F.percentile_approx("value", shares, 20 * total).alias("q")).collect()
    names, coarse, fine = [], [], []
    for r in rows:
        edges = r["q"]
        names.append(r["name"])
        coarse.append([edges[i * side - 1] for i in range(1, side)])
        fine.append([edges[i * side : (i + 1) * side - 1] for i in range(side)])
    return long.sparkSession.createDataFrame(
        pa.table(
            {
                "name": names,
                "coarse": pa.array(coarse, pa.list_(pa.float64())),
                "fine": pa.array(fine, pa.list_(pa.list_(pa.float64()))),
            }
        )
    )


def column_sizes(long: DataFrame) -> dict[str, int]:
    return {r["name"]: r["n"] for r in long.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}


def value_percentiles(long: DataFrame, sizes: dict[str, int], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(name, value, c, n, pct): average rank of each distinct value divided by the row count."""
    hist = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    largest = max(sizes.values(), default=0)
    if largest <= range_rows:
        hist = hist.withColumn("range", F.lit(0))
    else:
        edges = _range_edges(long, min(MAX_RANGES, math.ceil(largest / range_rows)))

        def below(edge_array: Column) -> Column:
            return F.size(F.filter(edge_array, lambda e: e < F.col("value")))

        hist = (
            hist.join(F.broadcast(edges), "name")
            .withColumn("cell", below(F.col("coarse")))
            .withColumn("range", F.col("cell") * 100_000 + below(F.get("fine", F.col("cell"))))
            .drop("coarse", "fine", "cell")
        )
    inside = Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    if largest > range_rows:
        # One counter per range: bounded by MAX_RANGES rows per column.
        counts = hist.groupBy("name", "range").agg(F.sum("c").alias("in_range"))
        up = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(
            "name", "range", F.coalesce(F.sum("in_range").over(up), F.lit(0)).alias("offset")
        )
        hist = hist.join(F.broadcast(offsets), ["name", "range"]).withColumn("before", F.col("before") + F.col("offset"))
    spark = long.sparkSession
    n = F.broadcast(
        spark.createDataFrame(
            pa.table({"name": pa.array(list(sizes), pa.string()), "n": pa.array(list(sizes.values()), pa.int64())})
        )
    )
    pct = (F.col("before") + (F.col("c") + 1) / F.lit(2.0)) / F.col("n")
    return hist.join(n, "name").select("name", "value", "c", "n", pct.alias("pct"))


def lookup_by_value(
    rows: DataFrame, table: DataFrame, on: Sequence[str], hot: Column, split: bool, n: int = 0
) -> DataFrame:
    """Inner-join rows to a table unique on `on`, keeping hot keys out of the shuffle.

    `hot` is a condition on the table that provably selects a bounded number of keys; those are
    broadcast and the rest are shuffled, so a key holding a third of the rows never meets one task.
    `n`, the number of rows where known, deals them over as many tasks as they need.
    """
    if not split:
        return rows.join(table, list(on))
    hot_rows = F.broadcast(table.where(hot))
    cold = rows.join(F.broadcast(table.where(hot).select(*on)), list(on), "left_anti")
    tasks, spark = math.ceil(n / LOOKED_UP_ROWS), rows.sparkSession
    if tasks > spark.sparkContext.defaultParallelism:
        cold = cold.repartition(max(tasks, int(spark.conf.get(PARTITIONS))), *on)
    return rows.join(hot_rows, list(on)).unionByName(cold.join(table.where(~hot), list(on)))


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail where rows share a key or lack one: results that are joined back by key would be wrong."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | missing).take(5)
    if bad:
        shown = "; ".join(", ".join(f"{k}={r[k]}" for k in keys) for r in bad)
        raise ValueError(f"rows need a key of their own, repeated or null: {shown}")


def _grid(long: DataFrame, points: int) -> dict[str, list[float]]:
    """Distinct values near `points` equally spaced ranks of each column, ascending.

    The sketch errs by a quarter of a step at most, so a value that holds two steps of a column's rows
    is always among them."""
    shares = [i / points for i in range(1, points)]
    rows = long.groupBy("name").agg(F.percentile_approx("value", shares, 4 * points).alias("q")).collect()
    return {r["name"]: sorted(set(r["q"])) for r in rows}


def _with_range(long: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """`long` with `range`, the number of grid values below the value, and `edge`, whether it is the grid
    value that closes the range."""
    names, coarse, fine, sides = [], [], [], []
    for name, edges in grid.items():
        side = max(1, math.isqrt(len(edges)))
        names.append(name)
        sides.append(side)
        coarse.append(edges[side - 1 :: side])
        fine.append([edges[k : k + side] for k in range(0, len(edges) + 1, side)])
    tables = long.sparkSession.createDataFrame(
        pa.table(
            {
                "name": pa.array(names, pa.string()),
                "side": pa.array(sides, pa.int32()),
                "coarse": pa.array(coarse, pa.list_(pa.float64())),
                "fine": pa.array(fine, pa.list_(pa.list_(pa.float64()))),
            }
        )
    )

    def below(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: e < F.col("value")))

    found = long.join(F.broadcast(tables), "name").withColumn("cell", below(F.col("coarse")))
    inner = F.get("fine", F.col("cell"))
    found = found.withColumn("place", below(inner)).withColumns(
        {
            "range": F.col("cell") * F.col("side") + F.col("place"),
            "edge": F.coalesce(F.get(inner, F.col("place")) == F.col("value"), F.lit(False)),
        }
    )
    return found.drop("side", "coarse", "fine", "cell", "place")


def average_rank_percentile(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    range_rows: int = RANGE_ROWS,
    by: Column | None = None,
) -> DataFrame:
    """(keys, name, pct) for every non-null value; `pct` is pandas' `rank(pct=True)`, of the value among
    all or, with `by`, a column of few distinct values, among those of its group.

    The long rows are exchanged once, by value range, and ranked inside their range; the exact number of
    rows below a range is a prefix sum over counts per range. A value with a noticeable share of the rows
    closes a range of its own, so its rank follows from the counts alone and its rows are not exchanged."""
    ranked = _ranked(long_values(df, keys, columns, by), keys, range_rows)
    return ranked if by is None else ranked.withColumn("name", F.substring_index("name", SEPARATOR, -1))


def _ranked(long: DataFrame, keys: Sequence[str], range_rows: int) -> DataFrame:
    sizes = column_sizes(long)
    largest = max(sizes.values(), default=0)
    spark = long.sparkSession
    peers = Window.partitionBy("name", "range").orderBy("value").rangeBetween(Window.currentRow, Window.currentRow)
    inside = Window.partitionBy("name", "range").orderBy("value")
    # Rows below in the range, then half of the equal ones and of the row itself.
    rank = F.rank().over(inside) - 1 + (F.count(F.lit(1)).over(peers) + 1) / F.lit(2.0)
    if largest <= range_rows:
        n = pa.table({"name": pa.array(list(sizes), pa.string()), "n": pa.array(list(sizes.values()), pa.int64())})
        ranked = long.withColumn("range", F.lit(0)).withColumn("rank", rank)
        ranked = ranked.join(F.broadcast(spark.createDataFrame(n)), "name")
        return ranked.select(*keys, "name", (F.col("rank") / F.col("n")).alias("pct"))
    ranged = _with_range(long, _grid(long, max(2 * NOTICEABLE, math.ceil(largest / range_rows))))
    # Two counters for every range: bounded by the grid, not by the rows.
    counts = {(r["name"], r["range"], r["edge"]): r["n"] for r in _range_counts(ranged)}
    offsets: dict[str, list] = {k: [] for k in ("name", "range", "n", "before", "whole", "edge_pct")}
    reached: dict[str, int] = {}
    for name, number in sorted({k[:2] for k in counts}):
        before, n = reached.get(name, 0), sizes[name]
        fewer, equal = counts.get((name, number, False), 0), counts.get((name, number, True), 0)
        values = (name, number, n, before, equal * NOTICEABLE >= n, (before + fewer + (equal + 1) / 2) / n)
        for column, v in zip(offsets.values(), values, strict=True):
            column.append(v)
        reached[name] = before + fewer + equal
    table = spark.createDataFrame(pa.table(offsets)).withColumn("range", F.col("range").cast("int"))
    placed = ranged.join(F.broadcast(table), ["name", "range"])
    apart = F.col("edge") & F.col("whole")
    # Dealt by number of rows: a session's fixed number, or partitions joined by bytes, hold ever more ranges.
    tasks = math.ceil(sum(sizes.values()) / RANKED_ROWS)
    inner = placed.where(~apart).repartition(tasks, "name", "range")
    ranked = inner.withColumn("pct", (F.col("before") + rank) / F.col("n"))
    return ranked.select(*keys, "name", "pct").unionByName(
        placed.where(apart).select(*keys, "name", F.col("edge_pct").alias("pct"))
    )


def _range_counts(ranged: DataFrame) -> list:
    return ranged.groupBy("name", "range", "edge").agg(F.count(F.lit(1)).alias("n")).collect()
