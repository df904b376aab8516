from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orgpulse.config import RISK_GROUPS, ScoringConfig
from orgpulse.operators import scoring

CFG = ScoringConfig()
LEVELS = [f"{d.key}_load_level" for d in CFG.directions]


def leveled(spark, rows):
    """(org_id, four levels, form level, active count) with derived maximum."""
    df = spark.createDataFrame(
        rows, "org_id int, fhd_load_level int, procurement_load_level int, property_load_level int, project_load_level int, svk_form_level int"
    )
    return df.withColumn("max_direction_load_level", F.greatest(*LEVELS))


def test_recommended_form_anchors(spark):
    rows = [
        (1, 1, 1, 2, 1, 2),  # -> 2, gap 0
        (2, 2, 2, 2, 2, 4),  # bump -> 3, gap +1
        (3, 2, 2, 4, 0, 3),  # bump, clipped to 4, gap -1
        (4, 0, 0, 0, 0, 0),
    ]
    out = scoring.with_recommended_form(leveled(spark, rows), CFG).orderBy("org_id").collect()
    assert [(r["recommended_form_level"], r["form_gap"]) for r in out] == [(2, 0), (3, 1), (4, -1), (0, 0)]
    off = scoring.with_recommended_form(leveled(spark, rows), ScoringConfig(bump_enabled=False)).orderBy("org_id")
    assert [r["recommended_form_level"] for r in off.collect()] == [2, 2, 4, 0]


def test_form_level_takes_the_strongest_answer(spark):
    df = spark.createDataFrame(
        [(1, "нет", "Да", " да", "Да"), (2, None, "-", "нет", "Нет")],
        "org_id int, form_responsible_person string, form_temporary_body string, form_permanent_body string, form_structural_unit string",
    )
    out = scoring.with_form_level(df, CFG).orderBy("org_id").collect()
    assert [r["svk_form_level"] for r in out] == [4, 0]
    assert out[1]["svk_form_name"] == "Иная форма"
    bare = scoring.with_form_level(df.select("org_id"), CFG).first()
    assert bare["svk_form_level"] == 0 and bare["form_structural_unit__yes"] == 0.0


@pytest.mark.parametrize(("share", "level"), [(0.0, 0), (0.253, 1), (0.75, 1), (0.751, 2), (0.9, 2), (0.95, 3), (0.987, 4)])
def test_percentile_level(spark, share, level):
    df = spark.createDataFrame([(share,)], "p double")
    assert df.select(scoring.percentile_level(F.col("p"), CFG.level_cuts)).first()[0] == level


def test_uncovered_load_anchor(spark):
    rows = [(1, 3, 2, 4, 0, 1)]
    df = leveled(spark, rows)
    for key, active, covered in (("fhd", 1, 0), ("procurement", 1, 1), ("property", 1, 0), ("project", 0, 0)):
        uncovered = int(active == 1 and covered != 1)
        df = df.withColumns(
            {
                f"{key}_active": F.lit(active),
                f"{key}_covered": F.lit(covered),
                f"{key}_uncovered": F.lit(uncovered),
                f"{key}_uncovered_load": F.col(f"{key}_load_level") * uncovered,
            }
        )
    r = scoring.with_coverage(df, CFG).first()
    assert (r["uncovered_load_sum"], r["max_uncovered_load"], r["uncovered_active_directions_count"]) == (7, 4, 2)
    assert r["coverage_share_active"] == pytest.approx(1 / 3)


def peer_frame(spark, rows):
    df = spark.createDataFrame(
        rows,
        "org_id int, org_name string, fhd_load_level int, procurement_load_level int, property_load_level int,"
        " project_load_level int, svk_form_level int, active_directions_count int, covered_active_directions_count int",
    )
    return df.withColumn("max_direction_load_level", F.greatest(*LEVELS))


def test_peer_fallback_counts_names_and_rounds_half_even(spark):
    rows = []
    # six in one profile, but only four are named: falls back to max_act (4_act3)
    for i in range(6):
        rows.append((i, "n" if i < 4 else None, 2, 2, 4, 0, [2, 3, 2, 3, 2, 3][i], 3, 3))
    for i in range(6, 8):
        rows.append((i, "n", 4, 0, 1, 1, 2 if i == 6 else 3, 3, 0))
    # alone with its maximum: falls back to the last key whatever its size
    rows.append((8, "n", 1, 0, 0, 0, 3, 1, 1))
    # five named in one profile
    rows += [(20 + i, "n", 3, 0, 0, 0, [0, 1, 1, 2, 4][i], 1, 1) for i in range(5)]
    out = {r["org_id"]: r for r in scoring.with_peers(peer_frame(spark, rows), CFG).collect()}
    assert len(out) == len(rows)
    assert out[0]["load_profile"] == "2-2-4-0"
    assert (out[0]["peer_group_level"], out[0]["peer_group_key"], out[0]["peer_group_size"]) == ("max_act", "4_act3", 6)
    assert out[0]["peer_form_median"] == 2  # median 2.5 rounds to even
    assert out[0]["peer_coverage_median"] == 1.0
    assert (out[8]["peer_group_level"], out[8]["peer_group_key"], out[8]["peer_group_size"]) == ("max", "max_1", 1)
    assert (out[20]["peer_group_level"], out[20]["peer_form_median"], out[20]["form_vs_peer"]) == ("profile", 1, -1)
    wide = {r["org_id"]: r for r in scoring.with_peers(peer_frame(spark, rows), CFG.with_min_group_size(3)).collect()}
    assert wide[0]["peer_group_level"] == "profile" and wide[0]["peer_group_size"] == 4


def test_risk_group_order(spark):
    rows = [(False, 1, -1, "E"), (True, 1, -1, "D"), (True, 1, 0, "B"), (True, 0, -1, "C"), (True, 0, 0, "A")]
    df = spark.createDataFrame(
        [r[:3] for r in rows], "is_report_filled boolean, uncovered_active_directions_count int, form_gap int"
    )
    got = Counter(r["risk_group"] for r in scoring.with_risk_group(df).collect())
    assert got == Counter(RISK_GROUPS[r[3]] for r in rows)


def test_enrich_with_absent_columns_and_string_numbers(spark):
    df = spark.createDataFrame(
        [("a", "1 000,5", "Да"), ("b", "-5", None), ("c", None, "нет"), ("d", "10", "Да")],
        "org_id string, cash_receipts string, cover_fhd string",
    )
    out = scoring.enrich(df, CFG, year=2025).orderBy("org_id").toPandas()
    assert out["cash_receipts"].tolist() == [1000.5, -5.0, 0.0, 10.0]
    assert out["analysis_year"].tolist() == [2025] * 4
    # a negative value leaves the direction inactive and without load
    assert out["fhd_active"].tolist() == [1, 0, 0, 1]
    assert out["fhd_load_score"].tolist() == [1.0, 0.0, 0.0, 0.5]
    assert out["fhd_load_level"].tolist() == [4, 0, 0, 1]
    assert (out["land_area"] == 0).all() and (out["project_load_level"] == 0).all()
    assert out["is_report_filled"].all() and (out["org_type_classified"] == "Другие").all()
    assert out["coverage_share_active"].isna().tolist() == [False, True, True, False]
    # zero-filled metrics exist after enrichment, so only rules on them apply
    assert (out["contradictions"] == "").all()
    lean = scoring.enrich(df, CFG, scores=False)
    assert "fhd_load_score" not in lean.columns


def test_years_are_scored_apart(spark):
    df = spark.createDataFrame(
        [(1, 2024, 10.0), (2, 2024, 20.0), (1, 2025, 900.0), (2, 2025, 90.0)],
        "org_id int, analysis_year int, staff_avg double",
    )
    out = scoring.enrich_years(df, CFG, [2024, 2025])
    got = {(r["analysis_year"], r["org_id"]): r["fhd_load_score"] for r in out.collect()}
    assert got == {(2024, 1): 0.5, (2024, 2): 1.0, (2025, 1): 1.0, (2025, 2): 0.5}


def yearly(spark, years):
    """Reports of different size, scale and ties; the smallest year has one organisation."""
    rows = [
        (i, y, "n" if i % 9 else None, float((i * 37 + y) % (23 + y % 7) - 4) * (y - 2015), float(i % 5), float(i % 3), "Да" if i % 2 else None)
        for n, y in enumerate(years)
        for i in range(1 + 60 * n)
    ]
    return spark.createDataFrame(
        rows,
        "org_id int, analysis_year int, org_name string, staff_avg double, fkhz_count double, violations_total double, cover_fhd string",
    )


def test_years_in_one_pass_equal_each_year_alone(spark):
    years = [2019, 2020, 2021, 2022]
    df = yearly(spark, years)
    got = scoring.enrich_years(df, CFG, [*years, 2030], bracket_rows=25, range_rows=25)
    assert "Union" not in scoring.enrich_years(df, CFG, years)._jdf.queryExecution().logical().toString()
    names = sorted(got.columns)
    order = ["analysis_year", "org_id"]
    got = got.select(names).orderBy(order).collect()
    alone = [scoring.enrich(df.where(F.col("analysis_year") == y), CFG) for y in years]
    want = [r for part in alone for r in part.select(names).orderBy(order).collect()]
    assert len(got) == df.count() and got == want


def test_number_of_jobs_does_not_grow_with_the_years(spark):
    def jobs(years):
        group = f"years-{len(years)}"
        spark.sparkContext.setJobGroup(group, group)
        scoring.enrich_years(yearly(spark, years), CFG, years)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs([2019, 2020, 2021, 2022, 2023]) == jobs([2019, 2020]) > 0


def test_no_years_and_no_rows(spark):
    df = yearly(spark, [2020]).where("org_id < 0")
    assert scoring.enrich_years(df, CFG, [2020]).count() == 0


def test_scalable_cuts_equal_naive_levels(spark):
    pdf = pd.DataFrame({"org_id": range(500), "staff_avg": [float((i * 37) % 61 - 5) for i in range(500)]})
    df = spark.createDataFrame(pdf)
    stats = scoring.fit(df, CFG, bracket_rows=30)
    out = scoring.enrich(df, CFG, stats, scores=True).select("org_id", "fhd_load_score", "fhd_load_level").toPandas()
    naive = pdf["staff_avg"].where(pdf["staff_avg"] > 0).rank(pct=True).fillna(0.0)
    out = out.sort_values("org_id", ignore_index=True)
    assert (out["fhd_load_score"] == naive).all()
    want = naive.map(lambda p: 0 if p <= 0 else 1 if p <= 0.75 else 2 if p <= 0.9 else 3 if p <= 0.95 else 4)
    assert (out["fhd_load_level"] == want).all()


def test_repeated_and_null_keys_are_refused(spark):
    for ids in ([1, 1], [1, None]):
        df = spark.createDataFrame([(i, "o", 1.0) for i in ids], "org_id long, org_name string, staff_avg double")
        with pytest.raises(ValueError, match="key of their own"):
            scoring.enrich(df, ScoringConfig())


def test_years_that_are_not_named_are_an_error(spark):
    df = spark.createDataFrame([(1, 2023), (2, 2024)], "org_id long, analysis_year int")
    with pytest.raises(ValueError, match="2024"):
        scoring.enrich_years(df, ScoringConfig(), [2023])


def test_settings_survive_json():
    from orgpulse import config

    cfg = ScoringConfig().with_ceilings({"staff_avg": 7}).with_min_group_size(9)
    assert ScoringConfig.from_json(cfg.to_json()) == cfg
    assert ScoringConfig.from_json('{"min_group_size": 3}') == ScoringConfig().with_min_group_size(3)
    with pytest.raises(ValueError, match="min_size"):
        ScoringConfig.from_json('{"min_size": 3}')
    assert config.columns_from_json(config.columns_to_json(config.REPORT_COLUMNS)) == config.REPORT_COLUMNS


def test_fixed_values_by_literals():
    cfg = ScoringConfig()
    assert (cfg.level_cuts, cfg.min_group_size, cfg.n_bins) == ((0.75, 0.90, 0.95), 5, 12)
    assert (cfg.bump_enabled, cfg.bump_min_directions, cfg.bump_min_level, cfg.bump_by) == (True, 3, 2, 1)
    assert {c.column: c.limit for c in cfg.ceilings} == {
        "violations_total": 605,
        "staff_avg": 4_238,
        "cash_payments": 20_175_413_543,
        "procurement_count": 11_941,
        "procurement_amount": 6_138_122_952,
        "fkhz_count": 2_392_993,
    }
    assert [f.level for f in cfg.forms] == [1, 2, 3, 4] and len(cfg.metrics) == 20
