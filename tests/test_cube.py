import pytest
from pyspark.sql import functions as F

from orgpulse.config import ScoringConfig
from orgpulse.operators import cube, scoring, selection, summaries
from orgpulse.staging import stage

CFG = ScoringConfig()


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [
        (
            i,
            f"o{i}",
            [None, "N", "S", "W"][i % 4],
            f"r{i % 3}",
            float(i * 7 % 50) if i % 11 else None,
            float(i * 13 % 40) + 1e9,
            float(i % 9),
            float(i % 6),
            "Не заполнен" if i % 10 == 3 else "Принят",
            "Да" if i % 2 else "Нет",
        )
        for i in range(120)
    ]
    df = spark.createDataFrame(
        rows,
        "org_id int, org_name string, federal_district string, region string, cash_receipts double, staff_avg double,"
        " fkhz_count double, violations_total double, report_status string, cover_fhd string",
    )
    return stage(scoring.enrich(df, CFG, scores=False), "enriched")


SELECTIONS = [{}, {"federal_district": ["N", "W"]}, {"federal_district": ["S"], "region": ["r1", "r2"]}, {"region": ["none"]}]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert list(g.asDict()) == list(w.asDict())
        for name in g.asDict():
            if isinstance(w[name], float):
                assert g[name] == pytest.approx(w[name], rel=1e-9, abs=1e-12), name
            else:
                assert g[name] == w[name], name


def test_selections_equal_those_of_the_report(spark, enriched):
    cells = stage(cube.moment_cube(enriched, CFG), "cube")
    assert cells.count() < enriched.count()
    for chosen in SELECTIONS:
        part, held = selection.filter_dimensions(enriched, **chosen), selection.filter_dimensions(cells, **chosen)
        close(cube.overview(held).collect(), summaries.overview(part).collect())
        close(cube.directions(held, CFG).collect(), summaries.directions(part, CFG).collect())
        rows = selection.filled_only(part).where("cash_receipts > 0 and staff_avg > 0 and fkhz_count > 0")
        for r in cube.log_moments(held).collect():
            a, b = F.log1p(r["axis_1"]), F.log1p(r["axis_2"])
            n, ma, mb, cov = rows.agg(F.count(a), F.avg(a), F.avg(b), F.covar_samp(a, b)).first()
            assert r["n"] == n and (r["mean_1"] is None) == (n == 0)
            if n:
                assert (r["mean_1"], r["mean_2"]) == (pytest.approx(ma, rel=1e-12), pytest.approx(mb, rel=1e-12))
            assert (r["covariance"] is None) == (n < 2)
            if n > 1:
                assert r["covariance"] == pytest.approx(cov, rel=1e-6, abs=1e-12)


def test_cube_of_no_rows_and_of_two_years(spark, enriched):
    cells = cube.moment_cube(enriched.where("org_id < 0"), CFG)
    close(cube.overview(cells).collect(), summaries.overview(enriched.where("org_id < 0")).collect())
    both = enriched.withColumn("analysis_year", F.lit(2024)).unionByName(enriched.withColumn("analysis_year", F.lit(2025)))
    cells = cube.moment_cube(both, CFG)
    close(cube.overview(cells.where("analysis_year = 2025")).collect(), summaries.overview(enriched).collect())
