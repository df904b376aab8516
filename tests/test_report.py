"""The report derived from the order tables: its plan against the text of the SQL it stands for."""

from __future__ import annotations

import random

import pytest

from orgpulse.plans import fixture

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
    " l_returnflag string, l_linestatus string"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Repeated and null keys, customers without orders, orders without lines, lines without an order, one customer
    with half of all orders."""
    rng = random.Random(5)
    some = lambda values: rng.choice([*values, None])
    customers = [(k, f"c{k}", some(range(3)), some(["BUILDING", "MACHINERY", "OTHER"])) for k in [*range(60), 7, 8, None]]
    orders = [
        (some(range(300)), 3 if i % 2 else some(range(50)), some("FOP"), some([10.5, 2.25]), some(["1-URGENT", "5-LOW"]))
        for i in range(400)
    ]
    lines = [
        (some(range(350)), some(range(40)), some(range(9)), some([1.0, 2.5]), some([7.25, 9.99]), some("RAN"), some("FO"))
        for _ in range(1500)
    ]
    at = str(tmp_path_factory.mktemp("report"))
    tables = {
        "customer": (customers, CUSTOMER),
        "orders": (orders, ORDERS),
        "lineitem": (lines, LINEITEM),
        "nation": ([(n, f"n{n}", n % 2) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50])
def test_report_has_the_rows_of_its_sql(spark, folder, monkeypatch, rows_per_task):
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", rows_per_task)
    expected = spark.sql(fixture.REPORT_SQL, **{t: fixture.table(spark, folder, t) for t in fixture.TABLES})
    found = fixture.report_view(spark, folder)
    assert found.dtypes == expected.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_report_copies_no_line_with_its_sums(spark, folder):
    """Distinct counts over copied lines held all of them, with every buffer, in one task before the shuffle."""
    plan = fixture.report_view(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_distinct_values_are_dealt_by_number_of_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", 50)
    li = fixture.lines_by_org(fixture.table(spark, folder, "orders"), fixture.table(spark, folder, "lineitem"))
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and ", 60), REPARTITION_BY_NUM" in plan
