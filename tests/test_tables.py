"""Summaries, selections, sources and sinks on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from orgpulse.config import REPORT_COLUMNS, ScoringConfig
from orgpulse.operators import scoring, selection, summaries
from orgpulse.sources import schema, sheets, sinks
from orgpulse.staging import stage, staged_once

CFG = ScoringConfig()
NBSP = " "


@pytest.fixture(scope="module")
def enriched(spark):
    rows = []
    for i in range(60):
        rows.append(
            (
                i,
                None if i == 5 else f"o{i}",
                None if i % 9 == 0 else f"D{i % 3}",
                "R",
                "Не заполнен" if i % 10 == 7 else "Принят",
                "Да" if i % 2 else "Нет",
                "Да",
                "Да" if i % 3 else "Нет",
                float(i),
                float(i * 10),
                float(i % 7),
                float(i % 5),
                3.0 if i % 4 else None,
            )
        )
    df = spark.createDataFrame(
        rows,
        "org_id int, org_name string, federal_district string, region string, report_status string, svk_organized string,"
        " plan_schedule string, cover_fhd string, cash_receipts double, staff_avg double, fkhz_count double,"
        " violations_total double, violations_fixed_on_time double",
    )
    return scoring.enrich(df, CFG).cache()


def test_filters(enriched):
    one = selection.filter_dimensions(enriched, federal_district=["D1", "D2"], region=["R"], risk_group=[])
    assert {r[0] for r in one.select("federal_district").distinct().collect()} == {"D1", "D2"}
    assert selection.filter_dimensions(enriched).count() == 60
    options = [tuple(r) for r in selection.filter_options(enriched).collect()]
    assert ("federal_district", "D0") in options and ("region", "R") in options
    assert options == sorted(options) and all(v is not None for _, v in options)


def test_dimension_keeps_the_null_group(enriched):
    out = {r["federal_district"]: r for r in summaries.by_dimension(enriched, "federal_district").collect()}
    assert None in out and sum(r["orgs"] for r in out.values()) == 59  # one organisation has no name


def test_counts(enriched):
    status = {r["status"]: r["orgs"] for r in summaries.report_status(enriched).collect()}
    assert status == {"Принят": 54, "Не заполнен": 6}
    organised = {r["element_key"]: r for r in summaries.elements(enriched).collect()}["svk_organized"]
    assert (organised["yes_orgs"], organised["no_orgs"], organised["missing_orgs"], organised["filled_reports"]) == (24, 30, 0, 54)
    # only the one element that exists is part of the package
    package = summaries.basic_package(enriched).first()
    assert package["value"] == 54 and package["included_elements"] == "plan_schedule"
    over = {r["metric"]: r["value"] for r in summaries.overview(enriched).collect()}
    assert over["Организаций в отчете"] == 60 and over["Заполненных отчетов"] == 54
    assert over["% заполненных отчетов"] == 90.0 and over["Организаций с полноценной методикой оценки рисков"] is None
    total = sum(r["orgs"] for r in summaries.risk_groups(enriched).collect())
    assert total == 60
    long = summaries.directions_long(summaries.directions(enriched, CFG))
    assert long.count() == 8


def test_empty_selection(enriched):
    none = enriched.where("org_id < 0")
    assert {r["value"] for r in summaries.violations(none).collect()} == {0.0}
    assert summaries.remediation(none).first()["percent_of_violations"] is None
    assert summaries.legal(none).first()["value"] == 0.0
    assert summaries.form_levels(none).count() == 0
    assert summaries.elements(none).first()["yes_rate_pct"] is None
    assert summaries.overview_extra(none).first()["avg_coverage"] is None
    assert summaries.top_risk(none).count() == 0


def test_violations_remainder_is_clipped_by_row(spark):
    df = spark.createDataFrame([(10.0, 4.0, 0.0), (1.0, 5.0, 0.0)], "violations_total double, violations_fixed_on_time double, violations_fixed_late double")
    out = {r["metric"]: r for r in summaries.violations(df).collect()}
    assert out["Остаток без отраженного устранения"]["value"] == 6.0
    assert out[summaries.IMPOSSIBLE_ROW]["value"] == 1.0 and out[summaries.IMPOSSIBLE_ROW]["share_of_violations"] is None
    assert out["Устранено в срок"]["per_100_violations"] == pytest.approx(9 / 11 * 100)


def test_top_risk_breaks_ties_by_key(enriched):
    top = [r["org_id"] for r in summaries.top_risk(enriched, 10).collect()]
    again = [r["org_id"] for r in summaries.top_risk(enriched.repartition(7), 10).collect()]
    assert top == again and len(top) == 10


# ---- sources ----------------------------------------------------------------------------------

GOOD = f""""Сводный отчет";;
;;
"№ п/п";"Наименование{NBSP}организации";"Статус отчета";"Тип организации";"Тип организации"
1;"Институт";"Принят";"a";"Научные учреждения"
2;"Музей";"Не заполнен";"b";"Культура"
"""
OTHER = """Статус отчета;Наименование организации;Среднесписочная  численность;№ п/п
Принят;Вуз;1 000,5;1
"""
BROKEN = """Наименование организации;Сумма
Ничей;5
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import os

    path = tmp_path_factory.mktemp("raw")
    for age, (name, text) in enumerate((("a.csv", GOOD), ("b.csv", OTHER), ("c.csv", BROKEN))):
        (path / name).write_text(text, encoding="utf-8")
        os.utime(path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    return path


def test_sheets_to_report(spark, folder):
    raw = stage(sheets.read_sheets(spark, str(folder), sep=";"), "sheets")
    headers = sheets.detect_headers(raw, ["block", "row"])
    got = {r["source"][-5:]: (r["header_row"], r["markers"], r["accepted"]) for r in headers.collect()}
    # an empty line is not a row of a delimited file; ";;" is
    assert got["a.csv"][1:] == (2, True) or got["a.csv"][1:] == (3, True)
    assert got["a.csv"][0] == 2 and got["b.csv"] == (0, 3, True) and got["c.csv"][2] is False
    with pytest.raises(ValueError, match="c.csv"):
        sheets.data_rows(raw, headers, ["block", "row"])
    assert [r["source"][-5:] for r in sheets.rejected_sources(headers).collect()] == ["c.csv"]
    rows = sheets.data_rows(raw, headers, ["block", "row"], on_rejected="skip")
    report = schema.canonical_rows(schema.with_org_id(rows, ["block", "row"]), headers, keep=["org_id"])
    assert set(report.columns) == {"source", "org_id", "org_name", "org_type", "report_status", "staff_avg"}
    out = {r["org_name"]: r for r in report.collect()}
    assert set(out) == {"Институт", "Музей", "Вуз"} and len({r["org_id"] for r in out.values()}) == 3
    assert out["Институт"]["org_type"] == "Научные учреждения"  # the second of two equal headers
    scored = {r["org_name"]: r for r in scoring.enrich(report.drop("source"), CFG).collect()}
    assert scored["Вуз"]["staff_avg"] == 1000.5 and scored["Музей"]["risk_group"].startswith("E")


def test_a_source_with_most_rows_among_many(spark):
    # Sources in the shuffle and in the broadcast: one with two thirds of the rows, one row each for the others.
    body = [("big", i + 1, [str(i)]) for i in range(6_000)] + [(f"s{i}", 1, ["x"]) for i in range(3_000)]
    rows = spark.createDataFrame(body + [(None, 1, ["no source"])], "source string, pos long, cells array<string>")
    names = ["big", *[f"s{i}" for i in range(0, 3_000, 2)], "without rows"]
    per_source = spark.createDataFrame([(n, len(n)) for n in names], "source string, size int")
    got = sheets.join_source(rows.repartition(6), per_source)
    assert got.columns == ["source", "pos", "cells", "size"]
    got = got.toPandas()
    assert len(got) == 6_000 + 1_500 and (got["size"] == got["source"].str.len()).all()
    assert sorted(got.loc[got["source"] == "big", "pos"]) == list(range(1, 6_001))
    assert sheets.join_source(rows.limit(0), per_source).count() == 0


def test_wide_sheet(spark, tmp_path):
    head = ";".join([f"колонка {i}" for i in range(298)] + ["Наименование организации", "Среднесписочная численность"])
    (tmp_path / "wide.csv").write_text(head + "\n" + ";".join(["x"] * 299 + ["7"]) + "\n", encoding="utf-8")
    raw = stage(sheets.read_sheets(spark, str(tmp_path), sep=";"), "wide")
    headers = sheets.detect_headers(raw, ["block", "row"], min_markers=1)
    rows = sheets.data_rows(raw, headers, ["block", "row"], on_rejected="skip")
    report = schema.canonical_rows(rows, headers, keep=[])
    assert [r["staff_avg"] for r in report.collect()] == ["7"]


@pytest.mark.parametrize(
    ("text", "options"),
    [
        ('h1,h2,"x\ny",h4,h5\n1,2\n', {"multiLine": "true"}),
        ('"x\ny";"a\nb";"c\nd";h4;h5\n1;2\n', {"multiline": "true", "delimiter": ";"}),
        ("h1;h2;h3;h4;h5\n1;2\n", {"delimiter": ";"}),
        ("h1;h2;h3;h4;h5\n1;2\n", {"DELIMITER": ";"}),
        ("h1;h2;h3;h4;h5\n1,2\n", {"SEP": ";", "delimiter": ","}),
        ("h1\th2\th3\th4\th5\n1\t2\n", {"sep": "\\t"}),
        ("h1||h2||h3||h4||h5\n1||2\n", {"sep": "||"}),
        ("1,2\nh1,h2,h3,h4,h5\n", {}),
    ],
)
def test_last_cell_of_the_widest_record_is_kept(spark, tmp_path, text, options):
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    cells = [r["cells"] for r in sheets.read_sheets(spark, str(tmp_path), **options).collect()]
    assert len(cells) == 2 and max(c[4] or "" for c in cells) == "h5"


def test_width_of_one_column_and_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\nb\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("", encoding="utf-8")
    assert sheets.sheet_width(spark, str(tmp_path / "a.csv")) == sheets.sheet_width(spark, str(tmp_path / "b.csv")) == 1


def test_absent_columns(spark, enriched):
    gone = ["report_status", "risk_methodology", "effectiveness_review", "federal_district", *summaries.BASIC_ELEMENTS]
    sparse = enriched.drop(*gone)
    for table in (
        summaries.report_status(sparse),
        summaries.basic_package(sparse),
        summaries.risk_methodology(sparse),
        summaries.effectiveness(sparse),
        summaries.by_dimension(sparse, "federal_district"),
    ):
        assert table.count() == 0
    assert summaries.overview(sparse).count() == summaries.overview(enriched).count()


def test_staged_tables_follow_their_inputs(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    first = staged_once(spark, path, "t", lambda: spark.read.parquet(path), [path])
    assert staged_once(spark, path, "t", lambda: spark.read.parquet(path), [path]) is first
    spark.range(5).write.mode("overwrite").parquet(path)
    assert staged_once(spark, path, "t", lambda: spark.read.parquet(path), [path]).count() == 5


def test_newest_file(spark, folder):
    assert sheets.newest_file(spark, str(folder)).endswith("a.csv")
    assert sheets.newest_file(spark, str(folder), "*.json") is None


def test_resolution_order(spark):
    df = spark.createDataFrame(
        [("f", ["Среднесписочная численность персонала", "Среднесписочная численность", None, "ПРОЕКТНАЯ деятельность"])],
        "source string, headers array<string>",
    )
    report = {r["canonical"]: r for r in schema.resolution_report(df).collect()}
    assert len(report) == len(REPORT_COLUMNS) == 64
    assert report["staff_avg"]["original"] == "Среднесписочная численность"  # equality before search
    assert report["cover_project"]["original"] == "ПРОЕКТНАЯ деятельность"
    assert not report["region"]["found"] and report["region"]["original"] is None
    assert schema.unresolved(schema.resolution_report(df)).count() == 62


def test_write_tables(spark, enriched, tmp_path):
    short = sinks.short_tables(enriched, CFG)
    assert len(short) == 7
    paths = sinks.write_tables({k: v for k, v in short.items() if k in ("risk_groups", "direction_summary")}, str(tmp_path), "csv")
    back = spark.read.option("header", True).csv(paths["risk_groups"])
    assert sum(int(r["orgs"]) for r in back.collect()) == 60
    full = sinks.bundle_tables(enriched, CFG)
    assert len(full) == 21
    path = sinks.write_table(full["cloud_peer_3d"], str(tmp_path / "peers"), "csv")
    assert "neighbors" not in spark.read.option("header", True).csv(path).columns
    year = sinks.write_table(enriched.withColumn("analysis_year", F.lit(2025)), str(tmp_path / "y"), partition_by="analysis_year")
    assert spark.read.parquet(year).where("analysis_year = 2025").count() == 60


def test_extract_tables(enriched):
    tables = sinks.extract_tables(enriched, CFG)
    assert len(tables) == 7
    assert tables["scale_profile_trimmed"].columns[-1] == "profile_trim_reason"
    assert tables["scale_profile_bin_1"].columns[-1] == "signed_scale" and tables["scale_profile_bin_1"].count() > 0
    assert tables["extreme_values"].count() > 0


def small_set(spark, n, extra=False):
    totals = spark.createDataFrame([("orgs", float(n))], "metric string, value double")
    if extra:
        totals = totals.withColumn("unit", F.lit("pcs"))
    return {"totals": totals, "rows": spark.range(n).select(F.col("id").alias("org_id"))}


def test_one_year_is_rewritten_and_the_other_stays(spark, tmp_path):
    folder = str(tmp_path / "sets")
    assert sinks.write_year(small_set(spark, 3), folder, 2024) == 1
    assert sinks.write_year(small_set(spark, 5), folder, 2025) == 1
    assert sinks.write_year(small_set(spark, 7, extra=True), folder, 2025) == 2
    totals = sinks.read_years(spark, folder, "totals").orderBy("analysis_year").collect()
    assert [(r["analysis_year"], r["value"], r["unit"]) for r in totals] == [(2024, 3.0, None), (2025, 7.0, "pcs")]
    assert sinks.read_years(spark, folder, "rows", [2025]).count() == 7
    assert sinks.write_year({"rows": spark.range(0).select(F.col("id").alias("org_id"))}, folder, 2024) == 2
    assert sinks.read_years(spark, folder, "rows", [2024]).count() == 0
    with pytest.raises(ValueError, match="2024"):
        sinks.read_years(spark, folder, "totals", [2024])  # the last set of that year has no such table


def test_a_lost_writer_leaves_the_former_set(spark, tmp_path):
    folder = str(tmp_path / "sets")
    with pytest.raises(ValueError, match="no complete table"):
        sinks.read_years(spark, folder, "rows")
    sinks.write_year(small_set(spark, 3), folder, 2025)
    broken = small_set(spark, 9)
    broken["rows"] = broken["rows"].withColumn("bad", F.raise_error(F.lit("writer lost")).cast("string"))
    with pytest.raises(Exception, match="writer lost"):
        sinks.write_year(broken, folder, 2025)
    assert sinks.read_years(spark, folder, "totals").first()["value"] == 3.0
    assert sinks.read_years(spark, folder, "rows").count() == 3
    assert len(sinks.complete_tables(spark, folder)) == 2
    # The next writer takes its own folder beside what the lost one left.
    sinks.write_year(small_set(spark, 4), folder, 2025)
    assert sinks.read_years(spark, folder, "rows").count() == 4


def test_rows_of_another_year_are_refused(spark, tmp_path):
    for year in (2024, None):
        df = spark.createDataFrame([(1, 2025), (2, year)], "org_id int, analysis_year int")
        with pytest.raises(ValueError, match="another year"):
            sinks.write_year({"rows": df}, str(tmp_path / "sets"), 2025)
    with pytest.raises(ValueError, match="at least one"):
        sinks.write_year({}, str(tmp_path / "sets"), 2025)


def test_cells(spark):
    df = spark.createDataFrame(
        [("a", 1.00000049, 2, True, "5", [1]), (None, None, None, None, None, None)],
        "org_name string, share double, n int, flag boolean, note string, ids array<int>",
    )
    got = {tuple(r) for r in sinks.cells({"t": df}, {"t": 6}).collect()}
    assert got == {
        ("t", "a", "share", 1.0, None),
        ("t", "a", "n", 2.0, None),
        ("t", "a", "flag", None, "true"),
        ("t", "a", "note", None, "5"),
    }
