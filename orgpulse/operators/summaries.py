"""Summary tables of the enriched report.

Every table is one aggregation; fixed-shape tables aggregate all their numbers in a single pass and
unfold the one resulting row afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.config import BASIC_ELEMENTS, ELEMENT_LABELS, MEASURES, NOT_STATED, ScoringConfig
from orgpulse.functions import cleaning as C
from orgpulse.operators.selection import filled_only, present


def _share(part: Column, whole: Column) -> Column:
    """Percent; null when there is nothing to divide by."""
    return C.safe_ratio(part.cast("double"), whole.cast("double")) * 100


def _unfold(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn one aggregated row into a table with the given cells."""
    cells = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return df.select(F.inline(F.array(*cells)))


def _with_percent(counts: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """Attach a percent of the row count of `whole`, taken as a scalar subquery."""
    total = whole.agg(F.count(F.lit(1)).cast("double")).scalar()
    return counts.withColumn(name, _share(F.col("orgs"), total))


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(C.number_or_null(df, name), F.lit(0.0))


def _sum(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.sum(_number(df, name)), F.lit(0.0))


def _yes(df: DataFrame, name: str) -> Column:
    return F.count_if(C.flag_or_null(df, name) == 1)


# ---- status and maturity ----------------------------------------------------------------------


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _if_present(df: DataFrame, *names: str) -> DataFrame:
    """`df`, or none of its rows where it has no such column: a summary of an absent column is empty."""
    return df if any(n in df.columns for n in names) else df.where(F.lit(False))


def report_status(df: DataFrame) -> DataFrame:
    status = F.coalesce(C.clean_text(_text(df, "report_status")), F.lit(NOT_STATED))
    counts = _if_present(df, "report_status").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("orgs"))
    return _with_percent(counts, df, "percent").orderBy(F.desc("orgs"), "status")


def elements(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in ELEMENT_LABELS:
        flag = C.flag_or_null(base, name)
        aggs += [
            F.count_if(flag == 1).alias(f"{name}_y"),
            F.count_if(flag == 0).alias(f"{name}_n"),
            F.count_if(flag.isNull()).alias(f"{name}_m"),
        ]
    n = F.col("n")
    rows = [
        (F.lit(k), F.lit(v), F.col(f"{k}_y"), F.col(f"{k}_n"), F.col(f"{k}_m"), n, _share(F.col(f"{k}_y"), n))
        for k, v in ELEMENT_LABELS.items()
    ]
    names = ["element_key", "element", "yes_orgs", "no_orgs", "missing_orgs", "filled_reports", "yes_rate_pct"]
    return _unfold(base.agg(*aggs), rows, names)


def _has_basic_package(df: DataFrame) -> tuple[Column, list[str]]:
    names = [c for c in BASIC_ELEMENTS if c in df.columns]
    whole = F.lit(True)
    for c in names:
        whole = whole & (C.flag_or_zero(df, c) == 1)
    return whole, names


def basic_package(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    whole, names = _has_basic_package(base)
    one = base.agg(F.count_if(whole).alias("value"), F.count(F.lit(1)).alias("denominator"))
    return one.select(
        F.lit("Организаций с полным базовым комплектом СВК").alias("metric"),
        "value",
        "denominator",
        _share(F.col("value"), F.col("denominator")).alias("percent"),
        F.lit(", ".join(names)).alias("included_elements"),
    ).where(F.lit(bool(names)))


def form_flags(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    base = filled_only(df)
    one = base.agg(F.count(F.lit(1)).alias("n"), *[_yes(base, f.column).alias(f.column) for f in cfg.forms])
    rows = [
        (F.lit(f.column), F.lit(f.name), F.lit(f.level), F.col(f.column), F.col("n"), _share(F.col(f.column), F.col("n")))
        for f in cfg.forms
    ]
    names = ["form_key", "form", "level", "yes_orgs", "filled_reports", "percent_filled"]
    return _unfold(one, rows, names).orderBy("level")


def form_levels(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    counts = base.groupBy("svk_form_level", "svk_form_name").agg(F.count(F.lit(1)).alias("orgs"))
    return _with_percent(counts, base, "percent_filled").orderBy("svk_form_level")


RATES = (
    ("cancelled_decisions", "disciplinary_decisions"),
    ("returned_refused", "materials_law_enforcement"),
    ("refused_satisfaction", "materials_court"),
)


def with_activity_rates(df: DataFrame) -> DataFrame:
    """Violations per organisation and the cancel/refuse rates of an aggregated table, as far as
    their sums are present."""
    have = set(df.columns)
    rates = {f"{p}_rate_pct": _share(F.col(p), F.col(w)) for p, w in RATES if {p, w} <= have}
    if "violations_total" in have:
        rates["violations_per_org"] = C.safe_ratio(F.col("violations_total"), F.col("orgs").cast("double"))
    return df.withColumns(rates) if rates else df


def form_activity(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    counts = base.groupBy("svk_form_level", "svk_form_name").agg(
        F.count("svk_form_level").alias("orgs"), *[_sum(base, m).alias(m) for m in MEASURES]
    )
    return with_activity_rates(_with_percent(counts, base, "percent_filled")).orderBy("svk_form_level")


def _classified(df: DataFrame, column: str, classify) -> DataFrame:
    base = filled_only(df)
    counts = _if_present(base, column).groupBy(classify(_text(base, column)).alias("category")).agg(F.count(F.lit(1)).alias("orgs"))
    return _with_percent(counts, base, "percent_filled").orderBy(F.desc("orgs"), "category")


def risk_methodology(df: DataFrame) -> DataFrame:
    return _classified(df, "risk_methodology", C.risk_methodology_class)


def effectiveness(df: DataFrame) -> DataFrame:
    return _classified(df, "effectiveness_review", C.effectiveness_class)


def improvement(df: DataFrame) -> DataFrame:
    return _classified(df, "improvement_actions", C.improvement_class)


# ---- violations and measures ------------------------------------------------------------------


def _violation_sums(base: DataFrame, names: Sequence[str]) -> DataFrame:
    total = _number(base, "violations_total")
    fixed = _number(base, "violations_fixed_on_time") + _number(base, "violations_fixed_late")
    return base.agg(
        *[_sum(base, n).alias(n) for n in names],
        F.coalesce(F.sum(F.greatest(total - fixed, F.lit(0.0))), F.lit(0.0)).alias("unresolved"),
        F.count_if((total > 0) & (fixed > total)).cast("double").alias("impossible"),
    )


# fixed values: row captions
TOTAL_ROW = "Выявленные нарушения"
FIXED_ROWS = (
    ("violations_fixed_on_time", "Устранено в срок"),
    ("violations_fixed_late", "Устранено с нарушением срока"),
    ("unresolved", "Остаток без отраженного устранения"),
)
PLAN_ROWS = (
    ("remediation_plans", "Планы устранения нарушений"),
    ("lna_changes", "Решения по внесению изменений в ЛНА"),
)
MEASURE_ROWS = (
    ("disciplinary_decisions", "Решения о дисциплинарной ответственности"),
    ("materials_law_enforcement", "Материалы в правоохранительные / контрольные органы"),
    ("materials_court", "Материалы в суд"),
)
IMPOSSIBLE_ROW = "Строк с арифметическим противоречием: устранено больше выявлено"
LEGAL_ROWS = (
    ("disciplinary_decisions", "Дисциплинарная ответственность: решений принято", None),
    ("cancelled_decisions", "  → из них отменены в порядке обжалования", "disciplinary_decisions"),
    ("materials_law_enforcement", "Материалы в правоохранительные органы: направлено", None),
    ("returned_refused", "  → из них возвращены, получен отказ", "materials_law_enforcement"),
    ("materials_court", "Материалы в суд: направлено", None),
    ("refused_satisfaction", "  → из них отказано в удовлетворении", "materials_court"),
)


def violations(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    actions = PLAN_ROWS + MEASURE_ROWS
    inputs = ["violations_total", *[c for c, _ in FIXED_ROWS[:2]], *[c for c, _ in actions]]
    total = F.col("violations_total")
    none = F.lit(None).cast("double")
    rows = []
    for c, label in (("violations_total", TOTAL_ROW), *FIXED_ROWS, *actions):
        share = C.safe_ratio(F.col(c), total)
        rows.append((F.lit(label), F.col(c), share, share * 100))
    rows.append((F.lit(IMPOSSIBLE_ROW), F.col("impossible"), none, none))
    names = ["metric", "value", "share_of_violations", "per_100_violations"]
    return _unfold(_violation_sums(base, inputs), rows, names)


def _percent_rows(df: DataFrame, captions: Sequence[tuple[str, str]]) -> DataFrame:
    inputs = {"violations_total", *[c for c, _ in captions if c != "unresolved"]}
    sums = _violation_sums(filled_only(df), sorted(inputs))
    rows = [(F.lit(t), F.col(c), _share(F.col(c), F.col("violations_total"))) for c, t in captions]
    return _unfold(sums, rows, ["metric", "value", "percent_of_violations"])


def remediation(df: DataFrame) -> DataFrame:
    return _percent_rows(df, (("violations_total", TOTAL_ROW), *FIXED_ROWS))


def management(df: DataFrame) -> DataFrame:
    return _percent_rows(df, PLAN_ROWS)


def legal(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    sums = base.agg(*[_sum(base, c).alias(c) for c, _, _ in LEGAL_ROWS])
    none = F.lit(None).cast("double")
    rows = [
        (
            F.lit(label),
            F.col(c),
            F.col(c) if whole else none,
            _share(F.col(c), F.col(whole)) if whole else none,
        )
        for c, label, whole in LEGAL_ROWS
    ]
    return _unfold(sums, rows, ["metric", "value", "cancelled_returned_refused", "cancellation_rate_pct"])


def normalized(df: DataFrame) -> DataFrame:
    base = filled_only(df)
    inputs = (
        "violations_total",
        "staff_avg",
        "cash_payments",
        "fkhz_count",
        "procurement_count",
        "procurement_amount",
    )
    sums = base.agg(*[_sum(base, c).alias(c) for c in inputs])
    bad, staff, paid, facts, buys, spent = [F.col(c) for c in inputs]
    billions = F.lit(1e9)
    # fixed values: captions and units
    rows = [
        ("Среднесписочная численность, всего", staff, "чел."),
        ("Кассовые выплаты, всего", paid, "руб."),
        ("Кассовые выплаты, всего", paid / billions, "млрд руб."),
        ("Нарушений на 100 среднесписочных сотрудников", C.safe_ratio(bad, staff) * 100, "ед."),
        ("Нарушений на 1 млрд руб. кассовых выплат", C.safe_ratio(bad, paid / billions), "ед."),
        ("Нарушений на 1 000 фактов хозяйственной жизни", C.safe_ratio(bad, facts) * 1000, "ед."),
        ("Закупок на 100 сотрудников", C.safe_ratio(buys, staff) * 100, "ед."),
        ("Совокупный объем закупок", spent, "руб."),
        ("Совокупный объем закупок", spent / billions, "млрд руб."),
        ("Доля объема закупок в кассовых выплатах", C.safe_ratio(spent, paid) * 100, "%"),
    ]
    return _unfold(sums, [(F.lit(m), v, F.lit(u)) for m, v, u in rows], ["metric", "value", "unit"])


# ---- overview ---------------------------------------------------------------------------------


def _double_risk() -> Column:
    return F.count_if(F.col("risk_group").startswith("D."))


def overview_sums(df: DataFrame) -> dict[str, Column]:
    """The counts and sums behind the key figures: those of a report are the sums of those of its parts.
    Counts over filled rows are conditional, so the report is read once. An absent column has none."""
    filled = F.coalesce(F.col("is_report_filled"), F.lit(True)) if "is_report_filled" in df.columns else F.lit(True)
    whole, names = _has_basic_package(df)
    risk = C.risk_methodology_class(_text(df, "risk_methodology")) == C.RISK_FULL
    review = C.effectiveness_class(_text(df, "effectiveness_review")) == C.REVIEW_REGULAR

    def filled_sum(name: str) -> Column:
        return F.coalesce(F.sum(F.when(filled, _number(df, name))), F.lit(0.0))

    sums = {
        "n": F.count(F.lit(1)),
        "filled": F.count_if(filled),
        "organised": F.count_if(filled & (C.flag_or_zero(df, "svk_organized") == 1)),
        "bad": filled_sum("violations_total"),
        "fixed": filled_sum("violations_fixed_on_time"),
        "coverage_sum": F.coalesce(F.sum("coverage_share_active"), F.lit(0.0)),
        "coverage_n": F.count("coverage_share_active"),
        "uncovered": F.count_if(F.col("uncovered_active_directions_count") > 0),
        "weak": F.count_if(F.col("form_gap") < 0),
        "double": _double_risk(),
        "flagged": F.count_if(F.coalesce(F.col("data_quality_flags"), F.lit("")) != ""),
    }
    if names:
        sums["package"] = F.count_if(filled & whole)
    if "risk_methodology" in df.columns:
        sums["risk"] = F.count_if(filled & risk)
    if "effectiveness_review" in df.columns:
        sums["review"] = F.count_if(filled & review)
    return sums


def overview(df: DataFrame) -> DataFrame:
    """Key figures."""
    return overview_figures(df.agg(*[c.alias(n) for n, c in overview_sums(df).items()]))


def overview_figures(one: DataFrame) -> DataFrame:
    """The key figures of one row of :func:`overview_sums`; those of an absent column are null."""
    unknown = [c for c in ("package", "risk", "review") if c not in one.columns]
    one = one.withColumns({c: F.lit(None).cast("long") for c in unknown}).withColumn(
        "coverage", C.safe_ratio(F.col("coverage_sum"), F.col("coverage_n").cast("double"))
    )
    # fixed values: captions
    rows = [
        ("Организаций в отчете", F.col("n")),
        ("Заполненных отчетов", F.col("filled")),
        ("% заполненных отчетов", _share(F.col("filled"), F.col("n"))),
        ("Организаций, где СВК организован", F.col("organised")),
        ("% организаций, где СВК организован", _share(F.col("organised"), F.col("filled"))),
        ("Организаций с полным базовым комплектом СВК", F.col("package")),
        ("% организаций с полным базовым комплектом СВК", _share(F.col("package"), F.col("filled"))),
        ("Организаций с полноценной методикой оценки рисков", F.col("risk")),
        ("% организаций с полноценной методикой оценки рисков", _share(F.col("risk"), F.col("filled"))),
        ("Организаций с регулярной оценкой эффективности СВК", F.col("review")),
        ("% организаций с регулярной оценкой эффективности СВК", _share(F.col("review"), F.col("filled"))),
        ("Выявленные нарушения", F.col("bad")),
        ("% нарушений, устраненных в срок", _share(F.col("fixed"), F.col("bad"))),
        ("Среднее покрытие активных направлений, %", F.col("coverage") * 100),
        ("Организаций с непокрытыми активными направлениями", F.col("uncovered")),
        ("Организаций со слабой формой СВК", F.col("weak")),
        ("Организаций с двойным риском", F.col("double")),
        ("Организаций с флагами качества данных", F.col("flagged")),
    ]
    return _unfold(one, [(F.lit(m), v.cast("double")) for m, v in rows], ["metric", "value"])


def overview_extra(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_organizations"),
        (F.avg("coverage_share_active") * 100).alias("avg_coverage"),
        F.count_if(F.col("uncovered_active_directions_count") > 0).alias("uncovered_count"),
        F.count_if(F.col("form_gap") < 0).alias("weak_form_count"),
        _double_risk().alias("double_risk_count"),
    )


# ---- directions, risk groups, dimensions ------------------------------------------------------


def direction_sums(cfg: ScoringConfig) -> dict[str, Column]:
    """The counts and sums behind the direction table: those of a report are the sums of those of its parts."""
    sums = {}
    for d in cfg.directions:
        active, covered = F.col(f"{d.key}_active") == 1, F.col(f"{d.key}_covered") == 1
        heavy = F.col(f"{d.key}_load_level") >= 3
        sums |= {
            f"{d.key}_a": F.count_if(active),
            f"{d.key}_c": F.count_if(active & covered),
            f"{d.key}_u": F.count_if(active & ~covered),
            f"{d.key}_h": F.count_if(heavy),
            f"{d.key}_hu": F.count_if(heavy & active & ~covered),
            f"{d.key}_levels": F.coalesce(F.sum(f"{d.key}_load_level"), F.lit(0)),
            f"{d.key}_rows": F.count(f"{d.key}_load_level"),
        }
    return sums


def directions(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    return direction_figures(df.agg(*[c.alias(n) for n, c in direction_sums(cfg).items()]), cfg)


def direction_figures(one: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """The direction table of one row of :func:`direction_sums`."""
    rows = [
        (
            F.lit(d.key),
            F.lit(d.name),
            F.col(f"{d.key}_a"),
            F.col(f"{d.key}_c"),
            F.col(f"{d.key}_u"),
            _share(F.col(f"{d.key}_c"), F.col(f"{d.key}_a")),
            F.col(f"{d.key}_h"),
            F.col(f"{d.key}_hu"),
            C.safe_ratio(F.col(f"{d.key}_levels").cast("double"), F.col(f"{d.key}_rows").cast("double")),
        )
        for d in cfg.directions
    ]
    names = [
        "direction_key",
        "direction",
        "active_orgs",
        "covered_orgs",
        "uncovered_orgs",
        "coverage_pct_active",
        "high_load_orgs",
        "high_load_uncovered_orgs",
        "avg_load_level",
    ]
    return _unfold(one, rows, names)


def directions_long(direction_table: DataFrame) -> DataFrame:
    return direction_table.unpivot("direction", ["covered_orgs", "uncovered_orgs"], "status", "orgs")


def risk_groups(df: DataFrame) -> DataFrame:
    counts = df.groupBy("risk_group").agg(F.count(F.lit(1)).alias("orgs"))
    return _with_percent(counts, df, "percent").orderBy("risk_group")


def by_dimension(df: DataFrame, dimension: str) -> DataFrame:
    counted = "org_name" if "org_name" in df.columns else "risk_group"
    return (
        _if_present(df, dimension)
        .groupBy(_text(df, dimension).alias(dimension))
        .agg(
            F.count(counted).alias("orgs"),
            F.avg("coverage_share_active").alias("avg_coverage"),
            F.avg("form_gap").alias("avg_form_gap"),
            _double_risk().alias("double_risk_orgs"),
            F.count_if(F.col("form_gap") < 0).alias("weak_form_orgs"),
            F.count_if(F.col("uncovered_active_directions_count") > 0).alias("uncovered_orgs"),
        )
        .orderBy(F.desc("double_risk_orgs"), F.desc("weak_form_orgs"), F.desc("uncovered_orgs"), dimension)
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("orgs")).orderBy(column)


TOP_RISK_COLUMNS = (
    "org_name",
    "org_type",
    "federal_district",
    "region",
    "risk_group",
    "coverage_share_active",
    "uncovered_load_sum",
    "max_uncovered_load",
    "svk_form_name",
    "recommended_form_name",
    "form_gap",
    "peer_form_median",
    "form_vs_peer",
    "peer_group_size",
    "fhd_load_level",
    "procurement_load_level",
    "property_load_level",
    "project_load_level",
    "fhd_covered",
    "procurement_covered",
    "property_covered",
    "project_covered",
    "data_quality_flags",
)


def top_risk(df: DataFrame, limit: int = 50, keys: Sequence[str] = ("org_id",)) -> DataFrame:
    """Organisations for management attention; ties are broken by the organisation key."""
    score = (
        F.coalesce("uncovered_load_sum", F.lit(0)) * 10
        + F.coalesce("max_uncovered_load", F.lit(0)) * 5
        + F.greatest(-F.coalesce("form_gap", F.lit(0)), F.lit(0)) * 3
        + (F.coalesce(F.col("data_quality_flags"), F.lit("")) != "").cast("int")
    )
    return present(
        df.orderBy(score.desc(), *keys).limit(limit), [*keys, *TOP_RISK_COLUMNS]
    )
