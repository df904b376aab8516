
from orgpulse.config import ScoringConfig
from orgpulse.operators import flags

CFG = ScoringConfig()


def text(spark, make, **columns):
    types = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in columns.items())
    df = spark.createDataFrame([tuple(columns.values())], types)
    return df.select(make(df).alias("t")).first()["t"]


def test_contradictions(spark):
    got = lambda **c: text(spark, flags.contradictions, **c)
    base = dict(violations_total=5.0, violations_fixed_on_time=3.0, violations_fixed_late=3.0)
    assert got(**base) == flags.FIXED_OVER_TOTAL
    assert got(**{**base, "violations_fixed_late": 2.0}) == ""
    assert got(**{**base, "violations_total": 0.0}) == ""
    assert got(violations_total=5.0, violations_fixed_on_time=9.0) == ""  # a column is absent
    assert got(disciplinary_decisions=1.0, cancelled_decisions=2.0) == flags.CANCELLED_OVER_DECIDED
    assert got(materials_law_enforcement=1.0, returned_refused=2.0) == flags.RETURNED_OVER_SENT
    assert got(materials_court=1.0, refused_satisfaction=2.0) == flags.REFUSED_OVER_SENT
    assert got(svk_organized=None, plan_schedule="Да") == flags.ELEMENTS_WITHOUT_CONTROL  # blank counts as no
    assert got(svk_organized="Да", plan_schedule="Да") == ""
    both = got(**base, svk_organized="Нет", lna_approved="да")
    assert both == f"{flags.FIXED_OVER_TOTAL}; {flags.ELEMENTS_WITHOUT_CONTROL}"


def test_anomalies(spark):
    def got(p75=100.0, p99=0.5, **c):
        return text(spark, lambda df: flags.anomalies(df, CFG, p75, p99), **c)

    assert got(cash_payments=20175413544.0) == "Аномально высокое значение кассовых выплат (>20,175,413,543)"
    assert got(cash_payments=20175413543.0) == ""
    five = dict(
        violations_fixed_on_time=5.0, violations_fixed_late=0.0, remediation_plans=5.0, lna_changes=0.0, violations_total=5.0
    )
    assert got(**five) == "Подозрительно одинаковые значения в нескольких полях (5.0)"
    assert got(**{**five, "lna_changes": 4.0}) == ""
    assert got(**{**five, "remediation_plans": 0.0}) == ""
    zero = got(staff_avg=101.0, violations_total=0.0, procurement_count=0.0)
    assert zero == (
        "Ноль нарушений при большой организации (персонал >100); Ноль закупок при большой организации (персонал >100)"
    )
    assert got(staff_avg=100.0, violations_total=0.0) == ""
    assert got(violations_total=3.0, fkhz_count=5.0) == "Аномально высокое соотношение нарушений к ФХЖ (>0.5000)"
    assert got(violations_total=3.0, fkhz_count=0.0) == ""


def test_quality_flags(spark):
    def got(**c):
        levels = {f"{d.key}_load_level": 0.0 for d in CFG.directions}
        covers = {f"{d.key}_covered": 0.0 for d in CFG.directions}
        row = {**levels, **covers, "max_direction_load_level": 0.0, "svk_form_level": 2.0, **c}
        return text(spark, lambda df: flags.quality_flags(df, CFG), **row)

    assert got() == ""
    assert got(svk_organized="Да", plan_schedule="Нет") == flags.CONTROL_WITHOUT_ELEMENTS
    assert got(svk_organized="Да", plan_schedule="Да") == ""
    assert got(max_direction_load_level=3.0, svk_form_level=1.0) == flags.WEAK_FORM
    assert got(fhd_load_level=3.0, project_load_level=4.0, project_covered=1.0) == flags.LOADED_UNCOVERED.format(key="fhd")


def test_ceilings_come_from_the_configuration(spark):
    low = CFG.with_ceilings({"staff_avg": 10})
    assert text(spark, lambda df: flags.join_texts(flags.ceiling_texts(df, low)), staff_avg=11.0).endswith("(>10)")
