"""A cube of mergeable sums: any selection by dimension is answered without reading the report.

A cell is one combination of the filter dimensions (and of the year, where rows have one) and holds the
counts and sums behind the key figures and the direction table, and the moments of the three log axes.
The cube is built in one pass with map-side aggregation and has as many rows as combinations occur,
whatever the size of the report; a selection is a filter on its rows and a sum over what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.config import AXES, ScoringConfig
from orgpulse.functions import cleaning as C
from orgpulse.operators import summaries
from orgpulse.operators.selection import FILTER_COLUMNS

YEAR = "analysis_year"
PAIRS = [(i, j) for i in range(len(AXES)) for j in range(i, len(AXES))]


def _logs(df: DataFrame) -> list[Column]:
    """Log axes of the filled rows that have all three above zero; null elsewhere."""
    values = [C.number_or_null(df, a) for a in AXES]
    filled = F.coalesce(F.col("is_report_filled"), F.lit(True)) if "is_report_filled" in df.columns else F.lit(True)
    active = filled
    for v in values:
        active = active & (v > 0)
    return [F.when(active, F.log1p(v)) for v in values]


def moment_cube(enriched: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """The cells of a scored report, to be staged and read by :func:`select_cells`.

    Moments are kept as count, mean and co-moments about the cell's own mean, so that only the spread
    between cells goes through sums of products when they are merged."""
    by = [c for c in (YEAR, *FILTER_COLUMNS) if c in enriched.columns]
    logs = _logs(enriched)
    sums = summaries.overview_sums(enriched) | summaries.direction_sums(cfg)
    moments = {"active_n": F.count(logs[0])}
    moments |= {f"mean_{i}": F.avg(x) for i, x in enumerate(logs)}
    moments |= {f"within_{i}{j}": F.covar_pop(logs[i], logs[j]) * F.count(logs[0]) for i, j in PAIRS}
    return enriched.groupBy(*by).agg(*[c.alias(n) for n, c in (sums | moments).items()])


def _sums(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row: the sums of the whole selection, zero where it has no cell."""
    return cells.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names if n in cells.columns])


def overview(cells: DataFrame) -> DataFrame:
    names = [
        "n", "filled", "organised", "package", "risk", "review", "bad", "fixed",
        "coverage_sum", "coverage_n", "uncovered", "weak", "double", "flagged",
    ]
    return summaries.overview_figures(_sums(cells, names))


def directions(cells: DataFrame, cfg: ScoringConfig) -> DataFrame:
    return summaries.direction_figures(_sums(cells, list(summaries.direction_sums(cfg))), cfg)


def log_moments(cells: DataFrame) -> DataFrame:
    """(axis_1, axis_2, n, mean_1, mean_2, covariance) of the log axes, one row for each pair; the sample
    covariance is null below two rows, the means are null without any."""
    n = F.col("active_n")
    held = cells.where(n > 0)
    one = held.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        *[F.sum(n * F.col(f"mean_{i}")).alias(f"s{i}") for i in range(len(AXES))],
        *[
            F.sum(F.col(f"within_{i}{j}") + n * F.col(f"mean_{i}") * F.col(f"mean_{j}")).alias(f"p{i}{j}")
            for i, j in PAIRS
        ],
    )
    total = F.col("n").cast("double")
    mean = [C.safe_ratio(F.col(f"s{i}"), total) for i in range(len(AXES))]
    rows = [
        F.struct(
            F.lit(AXES[i]).alias("axis_1"),
            F.lit(AXES[j]).alias("axis_2"),
            F.col("n"),
            mean[i].alias("mean_1"),
            mean[j].alias("mean_2"),
            F.when(
                F.col("n") > 1, C.safe_ratio(F.col(f"p{i}{j}") - F.col(f"s{i}") * mean[j], total - 1)
            ).alias("covariance"),
        )
        for i, j in PAIRS
    ]
    return one.select(F.inline(F.array(*rows)))
