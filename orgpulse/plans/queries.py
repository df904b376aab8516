"""The registered queries: one callable per operator, over the report derived from the tables.

Statistics that scan the whole report start from the staged report, summaries from the staged
enriched report, uses of the nearest-peer benchmark from the staged benchmark. Floating results are
rounded here, at the boundary, so that engines that add in another order agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.config import AXES, AXIS_RATIOS, BASIC_ELEMENTS
from orgpulse.functions import cleaning as C
from orgpulse.functions.labels import relabel
from orgpulse.functions.ranking import average_rank_percentile
from orgpulse.operators import cube, flags, models, neighbours, proportionality, scale_profile, scoring, selection, summaries
from orgpulse.plans import raw
from orgpulse.plans.fixture import CONFIG, enriched, inputs, report
from orgpulse.sources import schema, sheets, sinks
from orgpulse.staging import keep_until_release, modified, partitions_by_size, staged_once, staging_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENRICHED_COLUMNS = (
    ["org_id", "org_type_classified", "is_report_filled", "svk_form_level", "svk_form_name"]
    + [
        f"{d.key}_{part}"
        for d in CONFIG.directions
        for part in ("active", "covered", "load_score", "load_level", "uncovered", "uncovered_load")
    ]
    + [
        "active_directions_count",
        "covered_active_directions_count",
        "coverage_share_active",
        "uncovered_active_directions_count",
        "uncovered_load_sum",
        "max_uncovered_load",
        "max_direction_load_level",
        "recommended_form_level",
        "recommended_form_name",
        "form_gap",
        "load_profile",
        "peer_group_key",
        "peer_group_level",
        "peer_group_size",
        "peer_form_median",
        "peer_coverage_median",
        "form_vs_peer",
        "risk_group",
        "contradictions",
        "anomalies",
        "data_quality_flags",
    ]
)
ROUNDED_SCORES = ("coverage_share_active", "peer_coverage_median", *[f"{d.key}_load_score" for d in CONFIG.directions])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round half up at a fixed number of digits, as the oracle does; adding zero drops its sign."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prepare(report(spark, sf_dir), CONFIG)


def present_metrics(spark: SparkSession, sf_dir: str) -> list[str]:
    have = set(report(spark, sf_dir).columns)
    return [m for m in CONFIG.metrics if m in have]


def cloud(spark: SparkSession, sf_dir: str, **sizes: int) -> DataFrame:
    df = enriched(spark, sf_dir)
    with partitions_by_size(spark, inputs(sf_dir)):
        return neighbours.cloud_peers(df, CONFIG, **sizes)


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, sf_dir, "cloud-peers", lambda: cloud(spark, sf_dir), inputs(sf_dir))


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(
        spark, sf_dir, "proportions", lambda: proportionality.proportionality(enriched(spark, sf_dir), CONFIG), inputs(sf_dir)
    )


# ---- sources ----------------------------------------------------------------------------------


@query
def header_detect(spark, sf_dir):
    return sheets.detect_headers(raw.sheets(spark, sf_dir), ["pos"]).select("source", "header_row", "markers", "accepted")


@query
def latest_snapshot(spark, sf_dir):
    return sheets.latest_snapshot(raw.snapshots(spark, sf_dir)).select("source", "org_id", "org_name")


@query
def resolution_report(spark, sf_dir):
    return schema.resolution_report(raw.header_layouts(spark, sf_dir))


@query
def resolution_many_layouts(spark, sf_dir):
    """The same where every source has a layout of its own."""
    own = F.array_append("headers", F.concat(F.lit("note "), "source"))
    return schema.resolution_report(raw.header_layouts(spark, sf_dir).withColumn("headers", own))


@query
def unresolved_columns(spark, sf_dir):
    return schema.unresolved(schema.resolution_report(raw.header_layouts(spark, sf_dir)))


def _frame(sheet):
    headers = sheets.detect_headers(sheet, ["pos"])
    rows = sheets.data_rows(sheet, headers, ["pos"], on_rejected="skip")
    return schema.canonical_rows(rows, headers, keep=["pos"])


@query
def canonical_frame(spark, sf_dir):
    return _frame(raw.sheets(spark, sf_dir))


@query
def canonical_frame_uneven(spark, sf_dir):
    """The same where one source holds half of all rows and every other row has a source of its own."""
    return _frame(raw.uneven_sheets(spark, sf_dir))


@query
def rejected_sources(spark, sf_dir):
    return sheets.rejected_sources(sheets.detect_headers(raw.sheets(spark, sf_dir), ["pos"])).select("source", "markers")


# ---- cleaning ---------------------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return raw.dirty_answers(spark, sf_dir).select("org_id", C.clean_text(F.col("free_text")).alias("text"))


@query
def yes_flag(spark, sf_dir):
    return raw.dirty_answers(spark, sf_dir).select("org_id", C.yes_flag(F.col("answer_text")).alias("flag"))


@query
def to_number(spark, sf_dir):
    df = raw.dirty_answers(spark, sf_dir)
    return df.select("org_id", C.number_or_null(df, "amount_text").alias("amount"))


@query
def clean_frame(spark, sf_dir):
    return C.clean_frame(raw.dirty_answers(spark, sf_dir), ["amount_text", "balance"], ["answer_text"])


@query
def form_name(spark, sf_dir):
    # One level outside 0-4 shows the fallback name.
    level = (F.col("org_id") % 6).cast("int")
    return report(spark, sf_dir).select("org_id", level.alias("level"), C.form_name(level).alias("name"))


@query
def org_type_class(spark, sf_dir):
    return report(spark, sf_dir).select("org_id", C.org_type_class(F.col("org_type")).alias("org_class"))


@query
def answer_classes(spark, sf_dir):
    return report(spark, sf_dir).select(
        "org_id",
        C.risk_methodology_class(F.col("risk_methodology")).alias("risk_class"),
        C.effectiveness_class(F.col("effectiveness_review")).alias("effectiveness_class"),
        C.improvement_class(F.col("improvement_actions")).alias("improvement_class"),
    )


@query
def filled_flag(spark, sf_dir):
    return report(spark, sf_dir).select("org_id", C.is_filled(F.col("report_status")).alias("filled"))


@query
def relabelled(spark, sf_dir):
    df = enriched(spark, sf_dir).select("org_id", "risk_group", "svk_form_name", "data_quality_flags")
    return relabel(df)


@query
def axis_log(spark, sf_dir):
    df = report(spark, sf_dir)
    logs = [F.log1p(C.number_or_null(df, a)).alias(f"{a}_ln1p") for a in AXES]
    tens = [C.log_axis(C.number_or_null(df, a)).alias(f"{a}_lg") for a in AXES]
    return rounded(df.select("org_id", *logs, *tens), 8, *[f"{a}_{s}" for a in AXES for s in ("ln1p", "lg")])


# ---- filters and extracts ---------------------------------------------------------------------


@query
def filter_dims(spark, sf_dir):
    df = selection.filter_dimensions(
        enriched(spark, sf_dir),
        federal_district=["ASIA", "EUROPE"],
        org_type_classified=["Другие", "Научные учреждения"],
        risk_group=[],
    )
    return df.select("org_id", "federal_district", "region", "org_type_classified", "risk_group")


@query
def filter_options(spark, sf_dir):
    return selection.filter_options(enriched(spark, sf_dir))


@query
def contradictions(spark, sf_dir):
    return selection.contradictions(enriched(spark, sf_dir))


@query
def anomalies(spark, sf_dir):
    return selection.anomalies(enriched(spark, sf_dir))


@query
def quality_issues(spark, sf_dir):
    return selection.quality_issues(enriched(spark, sf_dir))


@query
def form_scatter(spark, sf_dir):
    return rounded(selection.form_scatter(enriched(spark, sf_dir)), 8, "coverage_share_active")


@query
def peer_scatter(spark, sf_dir):
    return selection.peer_scatter(enriched(spark, sf_dir))


# ---- scoring ----------------------------------------------------------------------------------


@query
def load_percentile(spark, sf_dir):
    columns = {m: scoring.positive(m) for m in present_metrics(spark, sf_dir)}
    return rounded(average_rank_percentile(prepared(spark, sf_dir), ["org_id"], columns), 10, "pct")


@query
def load_percentile_ranges(spark, sf_dir):
    """The same through many small value ranges, as for reports of millions of rows."""
    columns = {m: scoring.positive(m) for m in present_metrics(spark, sf_dir)}
    return rounded(average_rank_percentile(prepared(spark, sf_dir), ["org_id"], columns, range_rows=200), 10, "pct")


@query
def load_level(spark, sf_dir):
    df = prepared(spark, sf_dir)
    metrics = present_metrics(spark, sf_dir)
    cuts = scoring.fit_load_cuts(df, CONFIG, metrics)
    return df.select("org_id", *[scoring.level_of(F.col(m), cuts[m]).alias(f"{m}_level") for m in metrics])


def leveled(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return scoring.with_load_levels(df, CONFIG, scoring.fit_load_cuts(df, CONFIG, present_metrics(spark, sf_dir)))


@query
def direction_load(spark, sf_dir):
    df = leveled(spark, sf_dir)
    scores = scoring.load_scores(prepared(spark, sf_dir), CONFIG, ["org_id"], present_metrics(spark, sf_dir))
    df = scoring.with_load_scores(df, scores, CONFIG, ["org_id"])
    parts = ("active", "covered", "load_score", "load_level", "uncovered", "uncovered_load")
    df = df.select("org_id", *[f"{d.key}_{p}" for d in CONFIG.directions for p in parts])
    return rounded(df, 10, *[f"{d.key}_load_score" for d in CONFIG.directions])


@query
def coverage(spark, sf_dir):
    df = scoring.with_coverage(leveled(spark, sf_dir), CONFIG).select(
        "org_id",
        "active_directions_count",
        "covered_active_directions_count",
        "coverage_share_active",
        "uncovered_active_directions_count",
        "uncovered_load_sum",
        "max_uncovered_load",
        "max_direction_load_level",
    )
    return rounded(df, 8, "coverage_share_active")


@query
def form_level(spark, sf_dir):
    df = scoring.with_form_level(report(spark, sf_dir), CONFIG)
    return df.select("org_id", *[f"{f.column}__yes" for f in CONFIG.forms], "svk_form_level", "svk_form_name")


@query
def recommended_form(spark, sf_dir):
    df = scoring.with_recommended_form(scoring.with_coverage(leveled(spark, sf_dir), CONFIG), CONFIG)
    return df.select("org_id", "recommended_form_level", "recommended_form_name", "form_gap")


@query
def peer_benchmark(spark, sf_dir):
    df = scoring.with_peers(scoring.with_coverage(leveled(spark, sf_dir), CONFIG), CONFIG).select(
        "org_id",
        "load_profile",
        "peer_group_key",
        "peer_group_level",
        "peer_group_size",
        "peer_form_median",
        "peer_coverage_median",
        "form_vs_peer",
    )
    return rounded(df, 8, "peer_coverage_median")


@query
def risk_group(spark, sf_dir):
    df = scoring.with_recommended_form(scoring.with_coverage(leveled(spark, sf_dir), CONFIG), CONFIG)
    return scoring.with_risk_group(df).select("org_id", "risk_group")


@query
def enrich(spark, sf_dir):
    df = scoring.enrich(report(spark, sf_dir), CONFIG).select(*ENRICHED_COLUMNS)
    return rounded(df, 8, *ROUNDED_SCORES)


# ---- rule flags -------------------------------------------------------------------------------


def _nonempty(df, text):
    return df.select("org_id", text.alias("text")).where(F.col("text") != "")


@query
def flag_contradictions(spark, sf_dir):
    df = report(spark, sf_dir)
    return _nonempty(df, flags.contradictions(df))


@query
def flag_ceiling(spark, sf_dir):
    df = report(spark, sf_dir)
    return _nonempty(df, flags.join_texts(flags.ceiling_texts(df, CONFIG)))


@query
def flag_copypaste(spark, sf_dir):
    df = report(spark, sf_dir)
    return _nonempty(df, flags.join_texts(flags.copy_paste_texts(df)))


@query
def flag_zero_large(spark, sf_dir):
    df = report(spark, sf_dir)
    return _nonempty(df, flags.join_texts(flags.zero_large_texts(df, flags.Limits.of(scoring.staff_p75(df), 0.0))))


@query
def flag_ratio(spark, sf_dir):
    df = report(spark, sf_dir)
    return _nonempty(df, flags.join_texts(flags.ratio_texts(df, flags.Limits.of(0.0, scoring.violation_ratio_p99(df)))))


@query
def flag_quality(spark, sf_dir):
    df = scoring.with_coverage(leveled(spark, sf_dir), CONFIG)
    return _nonempty(df, flags.quality_flags(df, CONFIG))


@query
def enrich_two_years(spark, sf_dir):
    """Two reports in one table: the whole one, and a later one of those that state their staff."""
    df = report(spark, sf_dir)
    later = df.where("staff_avg is not null").withColumn("analysis_year", F.lit(2024))
    both = df.withColumn("analysis_year", F.lit(2023)).unionByName(later)
    scored = scoring.enrich_years(both, CONFIG, [2023, 2024])
    return rounded(scored.select("analysis_year", *ENRICHED_COLUMNS), 8, *ROUNDED_SCORES)


# ---- summaries --------------------------------------------------------------------------------


@query
def report_status(spark, sf_dir):
    return rounded(summaries.report_status(enriched(spark, sf_dir)), 6, "percent")


@query
def elements(spark, sf_dir):
    return rounded(summaries.elements(enriched(spark, sf_dir)), 6, "yes_rate_pct")


@query
def basic_package(spark, sf_dir):
    return rounded(summaries.basic_package(enriched(spark, sf_dir)), 6, "percent")


@query
def form_flags(spark, sf_dir):
    return rounded(summaries.form_flags(enriched(spark, sf_dir), CONFIG), 6, "percent_filled")


@query
def form_levels(spark, sf_dir):
    return rounded(summaries.form_levels(enriched(spark, sf_dir)), 6, "percent_filled")


RATE_COLUMNS = (
    "violations_per_org",
    "cancelled_decisions_rate_pct",
    "returned_refused_rate_pct",
    "refused_satisfaction_rate_pct",
)


@query
def form_activity(spark, sf_dir):
    return rounded(summaries.form_activity(enriched(spark, sf_dir)), 6, "percent_filled", *RATE_COLUMNS)


@query
def risk_methodology(spark, sf_dir):
    return rounded(summaries.risk_methodology(enriched(spark, sf_dir)), 6, "percent_filled")


@query
def effectiveness(spark, sf_dir):
    return rounded(summaries.effectiveness(enriched(spark, sf_dir)), 6, "percent_filled")


@query
def improvement(spark, sf_dir):
    return rounded(summaries.improvement(enriched(spark, sf_dir)), 6, "percent_filled")


@query
def violations(spark, sf_dir):
    return rounded(summaries.violations(enriched(spark, sf_dir)), 6, "share_of_violations", "per_100_violations")


@query
def remediation(spark, sf_dir):
    return rounded(summaries.remediation(enriched(spark, sf_dir)), 6, "percent_of_violations")


@query
def management(spark, sf_dir):
    return rounded(summaries.management(enriched(spark, sf_dir)), 6, "percent_of_violations")


@query
def legal(spark, sf_dir):
    return rounded(summaries.legal(enriched(spark, sf_dir)), 6, "cancellation_rate_pct")


@query
def normalized(spark, sf_dir):
    return rounded(summaries.normalized(enriched(spark, sf_dir)), 2, "value")


@query
def overview(spark, sf_dir):
    return rounded(summaries.overview(enriched(spark, sf_dir)), 6, "value")


@query
def overview_metric(spark, sf_dir):
    one = summaries.overview(enriched(spark, sf_dir)).where(F.col("metric") == "% заполненных отчетов")
    return rounded(one.select("value"), 6, "value")


@query
def overview_extra(spark, sf_dir):
    return rounded(summaries.overview_extra(enriched(spark, sf_dir)), 6, "avg_coverage")


@query
def directions(spark, sf_dir):
    return rounded(summaries.directions(enriched(spark, sf_dir), CONFIG), 6, "coverage_pct_active", "avg_load_level")


@query
def directions_long(spark, sf_dir):
    return summaries.directions_long(summaries.directions(enriched(spark, sf_dir), CONFIG))


@query
def risk_groups(spark, sf_dir):
    return rounded(summaries.risk_groups(enriched(spark, sf_dir)), 6, "percent")


@query
def by_district(spark, sf_dir):
    return rounded(summaries.by_dimension(enriched(spark, sf_dir), "federal_district"), 6, "avg_coverage", "avg_form_gap")


@query
def by_org_type(spark, sf_dir):
    return rounded(summaries.by_dimension(enriched(spark, sf_dir), "org_type"), 6, "avg_coverage", "avg_form_gap")


@query
def gap_dist(spark, sf_dir):
    return summaries.distribution(enriched(spark, sf_dir), "form_gap")


@query
def peer_dist(spark, sf_dir):
    return summaries.distribution(enriched(spark, sf_dir), "form_vs_peer")


@query
def top_risk(spark, sf_dir):
    return rounded(summaries.top_risk(enriched(spark, sf_dir)), 8, "coverage_share_active")


# ---- proportionality --------------------------------------------------------------------------


@query
def scale_level(spark, sf_dir):
    rows = proportionality.axis_rows(enriched(spark, sf_dir), ["org_id"])
    scored = proportionality.with_scale_score(rows, ["org_id"])
    df = proportionality.with_scale_level(scored, CONFIG).select(
        "org_id", F.col("scale_rank_mean").alias("scale_score"), "scale_level"
    )
    return rounded(df, 8, "scale_score")


@query
def mahalanobis(spark, sf_dir):
    rows = proportionality.axis_rows(enriched(spark, sf_dir), ["org_id"])
    df = rows.select("org_id", proportionality.mahalanobis_squared(rows).alias("distance_sq"))
    return rounded(df.withColumn("outlier", F.coalesce(F.col("distance_sq") > 11.345, F.lit(False))), 5, "distance_sq")


@query
def robust_z(spark, sf_dir):
    rows = proportionality.axis_rows(enriched(spark, sf_dir), ["org_id"])
    logs = {n: F.log(proportionality.unit_ratio(a, b)) for n, a, b, _ in AXIS_RATIOS}
    z = proportionality.robust_z(rows, logs)
    return rounded(rows.select("org_id", *[c.alias(f"{n}_z") for n, c in z.items()]), 6, *[f"{n}_z" for n in z])


@query
def unit_ratios(spark, sf_dir):
    rows = proportionality.axis_rows(enriched(spark, sf_dir), ["org_id"])
    return rows.select("org_id", *[proportionality.unit_ratio(a, b).alias(n) for n, a, b, _ in AXIS_RATIOS])


@query
def proportionality_all(spark, sf_dir):
    df = proportionality.proportionality(enriched(spark, sf_dir), CONFIG)
    return rounded(df, 2, *[f"{n}_z" for n, _, _, _ in AXIS_RATIOS])


@query
def proportionality_flagged(spark, sf_dir):
    return proportionality.flagged(proportions(spark, sf_dir))


def _axes_and(df, *columns):
    return df.select("org_id", *AXES, *columns)


@query
def extremes(spark, sf_dir):
    _, extreme = proportionality.split_extremes(proportions(spark, sf_dir))
    return _axes_and(extreme, "anomaly_score", "extreme_reason")


@query
def extremes_kept(spark, sf_dir):
    kept, _ = proportionality.split_extremes(proportions(spark, sf_dir), {"cash_receipts": 0.99, "staff_avg": 0.9})
    return kept.select("org_id")


@query
def trimmed(spark, sf_dir):
    _, out = proportionality.split_profile_outliers(enriched(spark, sf_dir))
    return _axes_and(out, "profile_trim_reason")


# ---- nearest peers ----------------------------------------------------------------------------


@query
def cloud_peers(spark, sf_dir):
    return cloud(spark, sf_dir).drop("neighbors")


@query
def cloud_peers_boxes(spark, sf_dir):
    """The same through many small boxes, as for clouds of millions of locations."""
    return cloud(spark, sf_dir, box_rows=64, range_rows=200).drop("neighbors")


@query
def cloud_peers_nested(spark, sf_dir):
    """The same where overfull boxes are cut again and again, as for clouds beyond one level of boxes."""
    return cloud(spark, sf_dir, box_rows=32, range_rows=200, fan=16, cells=8).drop("neighbors")


@query
def cloud_priority(spark, sf_dir):
    return neighbours.priority(peers(spark, sf_dir))


@query
def cloud_overview(spark, sf_dir):
    return rounded(neighbours.peers_overview(peers(spark, sf_dir)), 6, "avg_confidence")


@query
def cloud_form_scatter(spark, sf_dir):
    return neighbours.peer_form_scatter(peers(spark, sf_dir))


@query
def peers_kept(spark, sf_dir):
    kept, _ = proportionality.split_extremes(proportions(spark, sf_dir))
    return selection.keep_by_org(peers(spark, sf_dir), kept).select(
        "org_id", "form_vs_peer_3d", "peer_3d_confidence"
    )


def _first_org(spark, sf_dir):
    return peers(spark, sf_dir).agg(F.min("org_id")).first()[0]


@query
def neighbors_of(spark, sf_dir):
    return rounded(neighbours.neighbours_of(peers(spark, sf_dir), _first_org(spark, sf_dir)), 8, "dist")


@query
def neighbor_tags(spark, sf_dir):
    df = neighbours.highlight(peers(spark, sf_dir), _first_org(spark, sf_dir))
    return rounded(df, 8, "log_cash", "log_staff", "log_fkhz")


# ---- scale profile ----------------------------------------------------------------------------


def kept_and_axis(spark, sf_dir, **selection):
    """Rows within the trimming limits and the fitted axis, from the models kept until the session ends."""
    folder = f"{staging_root(spark)}/orgpulse/models-{spark.sparkContext.applicationId}"
    keep_until_release(spark, folder)
    request = models.Request(selection, str((sf_dir, modified(spark, inputs(sf_dir)))))
    kept, model = models.scale_model(enriched(spark, sf_dir), CONFIG, folder, request)
    return kept, model.axis


@query
def scale_axis(spark, sf_dir):
    kept, axis = kept_and_axis(spark, sf_dir)
    df = scale_profile.positions(kept, axis).select("org_id", "active", "signed_scale")
    return rounded(df, 6, "signed_scale")


def _bins(spark, sf_dir, whole_median):
    kept, axis = kept_and_axis(spark, sf_dir)
    return scale_profile.bin_statistics(scale_profile.bin_members(kept, axis), whole_median), axis


BIN_DOUBLES = (
    "signed_scale_mid",
    "signed_scale_left",
    "signed_scale_right",
    "typical_cash",
    "typical_staff",
    "typical_fkhz",
    *[f"form_share_{i}" for i in range(5)],
)


@query
def scale_bins(spark, sf_dir):
    return rounded(_bins(spark, sf_dir, True)[0], 4, *BIN_DOUBLES)


@query
def scale_bins_share(spark, sf_dir):
    return rounded(_bins(spark, sf_dir, False)[0], 4, *BIN_DOUBLES)


@query
def bin_orgs(spark, sf_dir):
    kept, axis = kept_and_axis(spark, sf_dir)
    df = scale_profile.ordered_members(scale_profile.bin_members(kept, axis))
    return rounded(df, 4, "signed_scale_left", "signed_scale_right", "signed_scale_mid", "signed_scale")


@query
def bin_forms(spark, sf_dir):
    kept, axis = kept_and_axis(spark, sf_dir)
    df = scale_profile.bin_forms(scale_profile.bin_members(kept, axis), len(axis.bins) // 2)
    return rounded(df, 6, *RATE_COLUMNS)


@query
def scale_peak(spark, sf_dir):
    statistics, axis = _bins(spark, sf_dir, True)
    df = scale_profile.peak(statistics, axis)
    return rounded(df, 4, "typical_cash", "typical_staff", "typical_fkhz", "signed_scale_mid", "sigma")


@query
def scale_centre(spark, sf_dir):
    kept, _ = kept_and_axis(spark, sf_dir)
    return rounded(scale_profile.centre(kept), 4, "typical_cash", "typical_staff", "typical_fkhz")


# ---- table sets -------------------------------------------------------------------------------


def _counts(tables):
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _bundle(spark, sf_dir):
    return sinks.bundle_tables(enriched(spark, sf_dir), CONFIG, peers=peers(spark, sf_dir))


def _extracts(spark, sf_dir):
    return sinks.extract_tables(
        enriched(spark, sf_dir), CONFIG, peers=peers(spark, sf_dir), proportions=proportions(spark, sf_dir)
    )


@query
def short_counts(spark, sf_dir):
    return _counts(sinks.short_tables(enriched(spark, sf_dir), CONFIG))


@query
def bundle_counts(spark, sf_dir):
    tables = _bundle(spark, sf_dir)
    return _counts({n: df for n, df in tables.items() if n != "scale_profile_bins"})  # scale_bins has those


@query
def bundle_cells(spark, sf_dir):
    """Every cell of the 21 tables."""
    tables = _bundle(spark, sf_dir)
    digits = dict.fromkeys(tables, 6) | {"normalized_metrics": 2, "scale_profile_bins": 4, "top_risk_orgs": 8}
    return sinks.cells(tables, digits)


@query
def extract_cells(spark, sf_dir):
    """Every cell of the row lists that only an extract has."""
    tables = _extracts(spark, sf_dir)
    names = ("extreme_values", "scale_profile_trimmed", "scale_profile_bin_1")
    return sinks.cells({n: tables[n] for n in names}, {"scale_profile_bin_1": 4})


@query
def extracts_trimmed(spark, sf_dir):
    return _extracts(spark, sf_dir)["scale_profile_trimmed"]


@query
def years_rewritten(spark, sf_dir):
    """Risk groups of two years in one folder, the later year written twice, at last of filled reports only."""
    df = enriched(spark, sf_dir)
    folder = f"{staging_root(spark)}/orgpulse/years-{uuid.uuid4().hex}"
    keep_until_release(spark, folder)
    tables = {"risk_groups": summaries.risk_groups(df)}
    sinks.write_year(tables, folder, 2023)
    sinks.write_year(tables, folder, 2024)
    sinks.write_year({"risk_groups": summaries.risk_groups(selection.filled_only(df))}, folder, 2024)
    return rounded(sinks.read_years(spark, folder, "risk_groups"), 6, "percent")


# ---- selections from the cube -----------------------------------------------------------------

SELECTED = {"federal_district": ["ASIA", "EUROPE", "AMERICA"], "org_type_classified": ["Другие", "Научные учреждения"]}


def selected_cells(spark, sf_dir):
    cells = staged_once(spark, sf_dir, "cube", lambda: cube.moment_cube(enriched(spark, sf_dir), CONFIG), inputs(sf_dir))
    return selection.filter_dimensions(cells, **SELECTED)


@query
def cube_overview(spark, sf_dir):
    return rounded(cube.overview(selected_cells(spark, sf_dir)), 6, "value")


@query
def cube_directions(spark, sf_dir):
    return rounded(cube.directions(selected_cells(spark, sf_dir), CONFIG), 6, "coverage_pct_active", "avg_load_level")


@query
def cube_moments(spark, sf_dir):
    return rounded(cube.log_moments(selected_cells(spark, sf_dir)), 6, "mean_1", "mean_2", "covariance")


# ---- reports without some columns -------------------------------------------------------------


@query
def overview_sparse(spark, sf_dir):
    gone = ["risk_methodology", "effectiveness_review", *BASIC_ELEMENTS]
    return rounded(summaries.overview(enriched(spark, sf_dir).drop(*gone)), 6, "value")


@query
def basic_package_sparse(spark, sf_dir):
    """The basic package of a report that asks for all elements but the first."""
    return rounded(summaries.basic_package(enriched(spark, sf_dir).drop(BASIC_ELEMENTS[0])), 6, "percent")


@query
def classes_sparse(spark, sf_dir):
    """The three classifications of a report with only the last of their columns."""
    df = enriched(spark, sf_dir).drop("risk_methodology", "effectiveness_review")
    tables = [summaries.risk_methodology(df), summaries.effectiveness(df), summaries.improvement(df)]
    return rounded(reduce(DataFrame.unionByName, tables), 6, "percent_filled")


@query
def by_district_sparse(spark, sf_dir):
    """Districts of a report without names, where rows are counted by risk group."""
    df = enriched(spark, sf_dir).drop("org_name")
    return rounded(summaries.by_dimension(df, "federal_district"), 6, "avg_coverage", "avg_form_gap")


@query
def load_level_brackets(spark, sf_dir):
    """Load levels through many small brackets, as for reports of millions of rows."""
    df = prepared(spark, sf_dir)
    metrics = present_metrics(spark, sf_dir)
    cuts = scoring.fit_load_cuts(df, CONFIG, metrics, bracket_rows=100)
    return df.select("org_id", *[scoring.level_of(F.col(m), cuts[m]).alias(f"{m}_level") for m in metrics])
