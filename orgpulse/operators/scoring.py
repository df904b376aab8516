"""Report-wide scoring: loads, coverage, control form, peers, risk groups.

Scoring happens in two steps. :func:`fit` runs the few driver-side statistics that depend on the
whole report (percentile cuts of every metric and two quantiles; some sixty numbers). :func:`enrich`
is then one lazy projection over the report plus one broadcast join of at most a few thousand peer
rows, so the wide report itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.config import OTHER_ORG_TYPE, RISK_GROUPS, ScoringConfig
from orgpulse.functions import cleaning as C
from orgpulse.functions.ranking import RANGE_ROWS, average_rank_percentile, require_unique
from orgpulse.functions.stats import (
    BRACKET_ROWS,
    grouped_quantiles_and_cuts,
    percentile_cuts,
    quantiles,
    quantiles_and_cuts,
)
from orgpulse.operators import flags

YEAR = "analysis_year"


@dataclass(frozen=True)
class ReportStats:
    """Everything `enrich` needs to know about the report as a whole."""

    load_cuts: dict[str, tuple[float, ...]]
    staff_p75: float
    violation_ratio_p99: float


# ---- row-level preparation --------------------------------------------------------------------
#
# A computed column that a later step uses twice starts a new projection, and each projection
# copies the wide row. The steps below therefore add their columns in as few layers as they can and
# repeat a shared expression inside a layer, where it is evaluated once.


def _class_columns(df: DataFrame) -> dict[str, Column]:
    """Organisation type class and filled flag; an absent column takes the default class."""
    org_class = C.org_type_class(F.col("org_type")) if "org_type" in df.columns else F.lit(OTHER_ORG_TYPE)
    filled = C.is_filled(F.col("report_status")) if "report_status" in df.columns else F.lit(True)
    return {"org_type_classified": org_class, "is_report_filled": filled}


def _form_answers(df: DataFrame, cfg: ScoringConfig) -> dict[str, Column]:
    return {f"{f.column}__yes": C.flag_or_zero(df, f.column) for f in cfg.forms}


def _form_columns(cfg: ScoringConfig) -> dict[str, Column]:
    levels = [F.col(f"{f.column}__yes") * f.level for f in cfg.forms] + [F.lit(0.0)]
    level = (F.greatest(*levels) if len(levels) > 1 else levels[0]).cast("int")
    return {"svk_form_level": level, "svk_form_name": C.form_name(level)}


def with_form_level(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Strongest form of control answered with yes, 0 when none is."""
    return df.withColumns(_form_answers(df, cfg)).withColumns(_form_columns(cfg))


def _metric_columns(df: DataFrame, cfg: ScoringConfig) -> dict[str, Column]:
    """Metrics as numbers (absent or unreadable is 0) and the cover flag of every direction."""
    numbers = {m: C.number_or_zero(df, m) for m in cfg.metrics}
    covers = {f"{d.key}_covered": C.flag_or_zero(df, d.cover_column).cast("int") for d in cfg.directions}
    return numbers | covers


def _active(metrics: Sequence[str]) -> Column:
    if not metrics:
        return F.lit(0)
    return (reduce(add, [F.col(m) for m in metrics]) > 0).cast("int")


def prepare(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Classes, form, numeric metrics, cover flags and activity of every row."""
    answers = _class_columns(df) | _form_answers(df, cfg) | _metric_columns(df, cfg)
    copies = {f"{m}__num": F.col(m) for m in cfg.metrics}
    active = {f"{d.key}_active": _active(d.metrics) for d in cfg.directions}
    return df.withColumns(answers).withColumns(_form_columns(cfg) | copies | active)


# ---- whole-report statistics ------------------------------------------------------------------


def positive(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name))


def fit_load_cuts(
    prepared: DataFrame, cfg: ScoringConfig, present: Sequence[str], bracket_rows: int = BRACKET_ROWS
) -> dict[str, tuple[float, ...]]:
    """Exact metric values at which the percentile among positive values crosses a level limit."""
    return percentile_cuts(prepared, {m: positive(m) for m in present}, cfg.level_cuts, bracket_rows)


def _tails(df: DataFrame) -> dict[str, tuple[Column, list[float]]]:
    """The two columns whose upper quantiles the flags compare with."""
    ratio = C.safe_ratio(C.number_or_zero(df, "violations_total"), C.number_or_zero(df, "fkhz_count"))
    return {"staff": (C.number_or_zero(df, "staff_avg"), [0.75]), "ratio": (ratio, [0.99])}


def _staff_limit(found: dict[tuple[str, float], float | None]) -> float:
    value = found[("staff", 0.75)]
    return 0.0 if value is None else value


def _ratio_limit(found: dict[tuple[str, float], float | None]) -> float:
    value = found[("ratio", 0.99)]
    return 999.0 if value is None else value


def staff_p75(df: DataFrame) -> float:
    """The staff limit of :func:`fit` alone, from one column."""
    return _staff_limit(quantiles(df, {"staff": _tails(df)["staff"]}))


def violation_ratio_p99(df: DataFrame) -> float:
    """The ratio limit of :func:`fit` alone, from two columns."""
    return _ratio_limit(quantiles(df, {"ratio": _tails(df)["ratio"]}))


def _load_cuts(df: DataFrame, cfg: ScoringConfig) -> dict[str, tuple[Column, Sequence[float]]]:
    return {m: (positive(m), cfg.level_cuts) for m in cfg.metrics if m in df.columns}


def fit(df: DataFrame, cfg: ScoringConfig, bracket_rows: int = BRACKET_ROWS) -> ReportStats:
    prepared = prepare(df, cfg)
    found, cuts = quantiles_and_cuts(prepared, _tails(prepared), _load_cuts(df, cfg), bracket_rows)
    return ReportStats(cuts, _staff_limit(found), _ratio_limit(found))


def fit_years(df: DataFrame, cfg: ScoringConfig, bracket_rows: int = BRACKET_ROWS) -> dict[int, ReportStats]:
    """:func:`fit` of every year's report, in as many passes as one year takes."""
    prepared = prepare(df, cfg)
    by_year = grouped_quantiles_and_cuts(
        prepared, F.col(YEAR), _tails(prepared), _load_cuts(df, cfg), bracket_rows
    )
    return {int(y): ReportStats(cuts, _staff_limit(q), _ratio_limit(q)) for y, (q, cuts) in by_year.items()}


# ---- report-relative columns ------------------------------------------------------------------


def level_of(value: Column, cuts: Sequence[float | Column]) -> Column:
    """0 for non-positive values, then 1..4 by the fitted cut values."""
    out = F.when(value <= 0, 0)
    for level, cut in enumerate(cuts, start=1):
        out = out.when(value <= (cut if isinstance(cut, Column) else F.lit(float(cut))), level)
    return out.otherwise(len(cuts) + 1)


def percentile_level(score: Column, shares: Sequence[float]) -> Column:
    """The same level from a 0..1 percentile score."""
    return level_of(score, shares)


def with_load_levels(df: DataFrame, cfg: ScoringConfig, cuts: Mapping[str, Sequence[float | Column]]) -> DataFrame:
    def level(metrics: Sequence[str]) -> Column:
        levels = [level_of(F.col(m), cuts[m]) for m in metrics if m in cuts] + [F.lit(0)]
        return F.greatest(*levels) if len(levels) > 1 else levels[0]

    columns = {}
    for d in cfg.directions:
        load = level(d.metrics)
        uncovered = ((F.col(f"{d.key}_active") == 1) & (F.col(f"{d.key}_covered") != 1)).cast("int")
        columns |= {
            f"{d.key}_load_level": load,
            f"{d.key}_uncovered": uncovered,
            f"{d.key}_uncovered_load": uncovered * load,
        }
    return df.withColumns(columns)


def load_scores(
    prepared: DataFrame,
    cfg: ScoringConfig,
    keys: Sequence[str],
    present: Sequence[str],
    range_rows: int = RANGE_ROWS,
    by: Column | None = None,
) -> DataFrame:
    """(keys, <direction>_load_score): the largest metric percentile per direction, narrow rows only;
    with `by`, percentiles within its groups."""
    ranks = average_rank_percentile(prepared, keys, {m: positive(m) for m in present}, range_rows, by)
    return ranks.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("name").isin(*d.metrics), F.col("pct"))).alias(f"{d.key}_load_score")
            for d in cfg.directions
        ]
    )


def with_load_scores(
    report: DataFrame, scores: DataFrame, cfg: ScoringConfig, keys: Sequence[str]
) -> DataFrame:
    """Attach the percentile scores. This is the one step that shuffles the report (by its key);
    nothing else depends on it, so leave it out where the scores are not part of the result."""
    names = [f"{d.key}_load_score" for d in cfg.directions]
    return report.join(scores, list(keys), "left").fillna(0.0, names)


def _total(df_cols: Sequence[str]) -> Column:
    return reduce(add, [F.col(c) for c in df_cols])


def _largest(df_cols: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c) for c in df_cols]) if len(df_cols) > 1 else F.col(df_cols[0])


def with_coverage(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    keys = [d.key for d in cfg.directions]
    loads = [f"{k}_uncovered_load" for k in keys]
    both = reduce(add, [F.col(f"{k}_active") * F.col(f"{k}_covered") for k in keys])
    active = _total([f"{k}_active" for k in keys])
    return df.withColumns(
        {
            "active_directions_count": active,
            "covered_active_directions_count": both,
            "coverage_share_active": C.safe_ratio(both.cast("double"), active.cast("double")),
            "uncovered_active_directions_count": _total([f"{k}_uncovered" for k in keys]),
            "uncovered_load_sum": _total(loads),
            "max_uncovered_load": _largest(loads),
            "max_direction_load_level": _largest([f"{k}_load_level" for k in keys]),
        }
    )


def with_recommended_form(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Recommended form from the heaviest direction, raised when several directions are loaded."""
    level = F.col("max_direction_load_level")
    if cfg.bump_enabled:
        loaded = reduce(
            add, [(F.col(f"{d.key}_load_level") >= cfg.bump_min_level).cast("int") for d in cfg.directions]
        )
        level = level + F.when(loaded >= cfg.bump_min_directions, cfg.bump_by).otherwise(0)
    recommended = F.least(F.greatest(level, F.lit(0)), F.lit(4))
    return df.withColumns(
        {
            "recommended_form_level": recommended,
            "recommended_form_name": C.form_name(recommended),
            "form_gap": F.col("svk_form_level") - recommended,
        }
    )


def peer_table(df: DataFrame, cfg: ScoringConfig, by: Sequence[str] = ()) -> DataFrame:
    """Peer statistics for every (load profile, active count) that occurs, within `by`.

    The report is reduced once to a cube over levels (0-4), counts and form; its size is bounded by
    the number of directions and the values of `by`, not by the report, and the medians weigh the
    cube's counts.
    """
    levels = [f"{d.key}_load_level" for d in cfg.directions]
    counted = "org_name" if "org_name" in df.columns else df.columns[0]
    cube = df.groupBy(
        *by,
        *levels,
        "max_direction_load_level",
        "active_directions_count",
        "covered_active_directions_count",
        "svk_form_level",
    ).agg(F.count(F.lit(1)).alias("rows"), F.count(counted).alias("named"))
    cube = cube.withColumn(
        "coverage",
        C.safe_ratio(
            F.col("covered_active_directions_count").cast("double"), F.col("active_directions_count").cast("double")
        ),
    )
    groups = {
        "profile": Window.partitionBy(*by, *levels),
        "max_act": Window.partitionBy(*by, "max_direction_load_level", "active_directions_count"),
        "max": Window.partitionBy(*by, "max_direction_load_level"),
    }
    heaviest = F.col("max_direction_load_level").cast("string")
    names = {
        "profile": F.concat_ws("-", *[F.col(c).cast("string") for c in levels]),
        "max_act": F.concat(heaviest, F.lit("_act"), F.col("active_directions_count").cast("string")),
        "max": F.concat(F.lit("max_"), heaviest),
    }
    stats = {
        g: F.struct(
            names[g].alias("key"),
            F.lit(g).alias("level"),
            F.sum("named").over(w).alias("size"),
            F.percentile("svk_form_level", F.lit(0.5), F.col("rows")).over(w).alias("form"),
            F.percentile("coverage", F.lit(0.5), F.col("rows")).over(w).alias("coverage"),
        )
        for g, w in groups.items()
    }
    enough = lambda g: F.col(g)["size"] >= cfg.min_group_size
    chosen = F.when(enough("profile"), F.col("profile")).when(enough("max_act"), F.col("max_act")).otherwise(F.col("max"))
    return (
        cube.select(*by, *levels, "active_directions_count", *[s.alias(g) for g, s in stats.items()])
        .dropDuplicates([*by, *levels, "active_directions_count"])
        .withColumn("peer", chosen)
        .select(
            *by,
            *levels,
            "active_directions_count",
            F.col("peer.key").alias("peer_group_key"),
            F.col("peer.level").alias("peer_group_level"),
            F.col("peer.size").alias("peer_group_size"),
            F.bround(F.col("peer.form")).cast("int").alias("peer_form_median"),
            F.col("peer.coverage").alias("peer_coverage_median"),
        )
    )


def with_peers(
    df: DataFrame, cfg: ScoringConfig, by: Sequence[str] = (), groups: int = 1, table: DataFrame | None = None
) -> DataFrame:
    """Compare each organisation with those of a similar load, falling back to coarser groups; only
    with those of the same `by`, which has at most `groups` values. `table` is the peer table where the
    caller has it already."""
    levels = [f"{d.key}_load_level" for d in cfg.directions]
    table = peer_table(df, cfg, by) if table is None else table
    # 5 levels per direction and the active count bound the table; hint only while that is small.
    if groups * (len(cfg.level_cuts) + 2) ** len(levels) * (len(levels) + 1) <= 1_000_000:
        table = F.broadcast(table)
    df = df.withColumn("load_profile", F.concat_ws("-", *[F.col(c).cast("string") for c in levels]))
    df = df.join(table, [*by, *levels, "active_directions_count"])
    return df.withColumn("form_vs_peer", F.col("svk_form_level") - F.col("peer_form_median"))


def risk_group() -> Column:
    """Risk group of a row, first condition that holds."""
    gap = F.col("form_gap") < 0
    uncovered = F.col("uncovered_active_directions_count") > 0
    return (
        F.when(~F.col("is_report_filled"), RISK_GROUPS["E"])
        .when(uncovered & gap, RISK_GROUPS["D"])
        .when(uncovered, RISK_GROUPS["B"])
        .when(gap, RISK_GROUPS["C"])
        .otherwise(RISK_GROUPS["A"])
    )


def with_risk_group(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_group", risk_group())


def with_verdicts(df: DataFrame, cfg: ScoringConfig, limits: flags.Limits) -> DataFrame:
    """Risk group and the three texts of rule flags."""
    return df.withColumns(
        {
            "risk_group": risk_group(),
            "contradictions": flags.contradictions(df),
            "anomalies": flags.anomalies_within(df, cfg, limits),
            "data_quality_flags": flags.quality_flags(df, cfg),
        }
    )


def enrich(
    df: DataFrame,
    cfg: ScoringConfig,
    stats: ReportStats | None = None,
    year: int | None = None,
    keys: Sequence[str] = ("org_id",),
    scores: bool = True,
) -> DataFrame:
    """Full enrichment of one year's report.

    `keys` identify an organisation row. `scores=False` leaves out the raw percentile scores and
    with them the only shuffle of the report; with scores, rows that repeat a key or have none are an
    error.
    """
    if scores:
        require_unique(df, keys)
    stats = stats or fit(df, cfg)
    if year is not None:
        df = df.withColumn(YEAR, F.lit(year))

    def leveled(rows: DataFrame) -> DataFrame:
        out = with_load_levels(prepare(rows, cfg), cfg, stats.load_cuts)
        return with_recommended_form(with_coverage(out, cfg), cfg)

    limits = flags.Limits.of(stats.staff_p75, stats.violation_ratio_p99)
    out = leveled(df)
    if not scores:
        return with_verdicts(with_peers(out, cfg), cfg, limits)
    # The scores meet the report before it grows wide: its own columns are shuffled, not those derived from them.
    table = peer_table(out, cfg)
    present = [m for m in cfg.metrics if m in df.columns]
    names = [f"{d.key}_load_score" for d in cfg.directions]
    out = leveled(with_load_scores(df, load_scores(prepare(df, cfg), cfg, keys, present), cfg, keys))
    out = with_verdicts(with_peers(out, cfg, table=table), cfg, limits)
    return out.select(*keys, *[c for c in out.columns if c not in (*keys, *names)], *names)


def _year_table(df: DataFrame, stats: Mapping[int, ReportStats], metrics: Sequence[str]) -> DataFrame:
    """One row for each year: the cut values of every metric and the limits of the flags."""
    rows = []
    for year, s in stats.items():
        limits = flags.limit_values(s.staff_p75, s.violation_ratio_p99)
        rows.append((year, [list(s.load_cuts[m]) for m in metrics], *limits.values()))
    schema = f"{YEAR} int, cuts array<array<double>>, staff double, staff_shown string, ratio double, ratio_shown string"
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.select(YEAR, F.struct("cuts", "staff", "staff_shown", "ratio", "ratio_shown").alias("__of_year"))


def enrich_years(
    df: DataFrame,
    cfg: ScoringConfig,
    years: Sequence[int],
    keys: Sequence[str] = ("org_id",),
    scores: bool = True,
    bracket_rows: int = BRACKET_ROWS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Enrich several yearly reports kept in one table with `analysis_year`.

    Statistics are relative to one year's report and computed for all years in the same passes: the
    number of jobs does not grow with the years, and the result is one projection over the table. The
    broadcast table of limits has one row for each year that `years` names. `keys` identify an
    organisation within its year. Rows of a year that `years` does not name, or of none, are an error.
    """
    year = F.col(YEAR)
    other = df.where(year.isNull() | ~year.isin(list(years))).select(YEAR).limit(1).collect()
    if other:
        raise ValueError(f"rows of the year {other[0][0]}, which is not among {list(years)}")
    keys = [YEAR, *keys]
    if scores:
        require_unique(df, keys)
    present = [m for m in cfg.metrics if m in df.columns]
    stats = fit_years(df, cfg, bracket_rows)
    prepared = prepare(df, cfg)
    out = prepared.join(F.broadcast(_year_table(df, stats, present)), YEAR)
    of_year = F.col("__of_year")
    cuts = {m: [of_year["cuts"][i][j] for j in range(len(cfg.level_cuts))] for i, m in enumerate(present)}
    out = with_load_levels(out, cfg, cuts)
    out = with_recommended_form(with_coverage(out, cfg), cfg)
    limits = flags.Limits(*[of_year[part] for part in ("staff", "staff_shown", "ratio", "ratio_shown")])
    out = with_verdicts(with_peers(out, cfg, [YEAR], len(set(years))), cfg, limits).drop("__of_year")
    if scores:
        found = load_scores(prepared, cfg, keys, present, range_rows, year)
        out = with_load_scores(out, found, cfg, keys)
    return out
