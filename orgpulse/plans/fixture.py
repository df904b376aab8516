"""The organisation report derived from the given order tables (one customer = one organisation)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.config import ScoringConfig
from orgpulse.operators import scoring
from orgpulse.staging import staged_once

TABLES = ("customer", "orders", "lineitem", "nation", "region")
# Rows that one task sorts or aggregates, whatever the size of the tables.
ROWS_PER_TASK = 1_000_000
# Parts by value of the distinct values of a customer: one with a large share of all lines is not one task.
SPREAD = 16

# Portable SQL: the oracles use the same text. All orders and lines are aggregated; every 61st
# organisation leaves its number cells blank, as some reports do. Money is summed as DECIMAL so that the order of
# addition can neither break ties nor change a value.
ORDERS_SQL = """\
  SELECT o_custkey AS k, COUNT(*) AS n_ord,
    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS tot,
    SUM(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS n_urg,
    SUM(CASE WHEN o_orderpriority='1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS amt_urg,
    SUM(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS n_p,
    SUM(CASE WHEN o_orderstatus='P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS amt_p
  FROM {orders} GROUP BY o_custkey"""
ORGS_SQL = """\
SELECT c.c_custkey AS org_id, c.c_name AS org_name,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Высшее образование' WHEN 'MACHINERY' THEN 'Научные учреждения' ELSE c.c_mktsegment END AS org_type,
  CASE WHEN c.c_custkey % 97 = 5 THEN NULL ELSE r.r_name END AS federal_district, n.n_name AS region,
  CASE WHEN c.c_custkey % 50 = 7 THEN 'Не заполнен' WHEN c.c_custkey % 50 = 8 THEN '-' ELSE 'Отчет  принят ' END AS report_status,
  CASE WHEN c.c_custkey % 11 < 8 THEN 'Да' WHEN c.c_custkey % 11 = 8 THEN 'Нет' WHEN c.c_custkey % 11 = 9 THEN 'нет данных' ELSE NULL END AS svk_organized,
  CASE WHEN c.c_custkey % 7 < 5 THEN ' да, раздел' ELSE 'Нет' END AS accounting_policy,
  CASE WHEN c.c_custkey % 13 < 10 THEN 'Да' ELSE 'Нет' END AS lna_approved,
  CASE WHEN c.c_custkey % 17 < 14 THEN 'Да' ELSE NULL END AS powers_defined,
  CASE WHEN c.c_custkey % 19 < 13 THEN 'Да' ELSE 'Нет' END AS plan_schedule,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Да' ELSE 'Нет' END AS form_responsible_person,
  CASE WHEN c.c_custkey % 4 = 1 THEN 'Да' ELSE 'Нет' END AS form_temporary_body,
  CASE WHEN c.c_custkey % 5 = 2 THEN 'Да' ELSE 'Нет' END AS form_permanent_body,
  CASE WHEN c.c_custkey % 6 = 4 THEN 'Да' ELSE 'Нет' END AS form_structural_unit,
  CASE WHEN c.c_custkey % 23 < 21 THEN 'Да' ELSE 'Нет' END AS cover_fhd,
  CASE WHEN c.c_custkey % 29 < 25 THEN 'Да' ELSE 'Нет' END AS cover_procurement,
  CASE WHEN c.c_custkey % 31 < 26 THEN 'Да' ELSE 'Нет' END AS cover_property,
  CASE WHEN c.c_custkey % 37 < 24 THEN 'Да' ELSE NULL END AS cover_project,
  CASE c.c_custkey % 5 WHEN 0 THEN 'Методика отсутствует' WHEN 1 THEN 'Применяется фрагментарно' WHEN 2 THEN 'Методика утверждена, карты рисков' WHEN 3 THEN 'Иное' ELSE NULL END AS risk_methodology,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Оценка не проводится' WHEN 1 THEN 'Проводится нерегулярно' WHEN 2 THEN 'Регулярно, не реже раза в год' ELSE '—' END AS effectiveness_review,
  CASE c.c_custkey % 6 WHEN 0 THEN 'Не планируются' WHEN 1 THEN 'Реализуются не в полном объеме' WHEN 2 THEN 'Разрабатываются и реализуются' WHEN 3 THEN 'Прочее' ELSE NULL END AS improvement_actions,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE od.tot END AS DOUBLE) AS cash_receipts, CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.ext END AS DOUBLE) AS cash_payments,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.qty END AS DOUBLE) AS staff_avg, CAST(CASE WHEN c.c_custkey % 53 = 2 THEN 0 ELSE CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_lines END END AS DOUBLE) AS fkhz_count,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE od.n_urg END AS DOUBLE) AS procurement_count, CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE od.amt_urg END AS DOUBLE) AS procurement_amount,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_parts END AS DOUBLE) AS buildings_count, CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_supp END AS DOUBLE) AS land_count,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE od.n_p END AS DOUBLE) AS project_count, CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE od.amt_p END AS DOUBLE) AS project_amount,
  CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret END AS DOUBLE) AS violations_total, CAST(CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret_f END AS DOUBLE) AS violations_fixed_on_time,
  CAST(CASE WHEN c.c_custkey % 41 = 3 THEN CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret END ELSE CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret END - CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret_f END END AS DOUBLE) AS violations_fixed_late,
  CAST(CASE WHEN c.c_custkey % 43 = 1 THEN CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret END ELSE c.c_custkey % 4 END AS DOUBLE) AS remediation_plans,
  CAST(CASE WHEN c.c_custkey % 43 = 1 THEN CASE WHEN c.c_custkey % 61 = 0 THEN NULL ELSE li.n_ret END ELSE c.c_custkey % 3 END AS DOUBLE) AS lna_changes,
  CAST(c.c_custkey % 5 AS DOUBLE) AS disciplinary_decisions, CAST(c.c_custkey % 7 % 3 AS DOUBLE) AS cancelled_decisions,
  CAST(c.c_custkey % 6 AS DOUBLE) AS materials_law_enforcement, CAST(c.c_custkey % 11 % 4 AS DOUBLE) AS returned_refused,
  CAST(c.c_custkey % 4 AS DOUBLE) AS materials_court, CAST(c.c_custkey % 13 % 3 AS DOUBLE) AS refused_satisfaction
FROM {customer} c
LEFT JOIN {nation} n ON n.n_nationkey=c.c_nationkey LEFT JOIN {region} r ON r.r_regionkey=n.n_regionkey
LEFT JOIN od ON od.k=c.c_custkey LEFT JOIN li ON li.k=c.c_custkey
"""
REPORT_SQL = (
    """
WITH li AS (
  SELECT o.o_custkey AS k,
    COUNT(*) AS n_lines, COUNT(DISTINCT l.l_partkey) AS n_parts, COUNT(DISTINCT l.l_suppkey) AS n_supp,
    SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS qty,
    SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS ext,
    SUM(CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret,
    SUM(CASE WHEN l.l_returnflag='R' AND l.l_linestatus='F' THEN 1 ELSE 0 END) AS n_ret_f,
    SUM(CASE WHEN l.l_returnflag='A' THEN 1 ELSE 0 END) AS n_a
  FROM {orders} o JOIN {lineitem} l ON l.l_orderkey=o.o_orderkey GROUP BY o.o_custkey),
od AS (
"""
    + ORDERS_SQL
    + ")\n"
    + ORGS_SQL
)

# Ceilings that suit the size of the derived organisations; the defaults suit a real yearly report.
FIXTURE_CEILINGS = {
    "violations_total": 28,
    "staff_avg": 1_900,
    "cash_payments": 4_000_000,
    "procurement_count": 5,
    "procurement_amount": 1_600_000,
    "fkhz_count": 75,
}
CONFIG = ScoringConfig().with_ceilings(FIXTURE_CEILINGS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The rows dealt over as many tasks as keep each at about `ROWS_PER_TASK` of them."""
    tasks = math.ceil(rows / ROWS_PER_TASK)
    # Few rows are dealt by Spark's own number, which adaptive execution lowers to the cores.
    return df.repartition(tasks, *by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*by)


def lines_by_org(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The part `li` of `REPORT_SQL`, one row per customer.

    Several distinct counts in one aggregate copy every line once for each of them and once more, all with the
    buffers of all sums. Here the sums take the lines as they are and the distinct counts narrow rows of customer,
    kind and value, so that a task holds a bounded number of narrow rows."""
    n = lines.count()  # answered from the footers of the files
    owners = _dealt(orders.select("o_orderkey", F.col("o_custkey").alias("k")), n, "o_orderkey")
    joined = owners.join(_dealt(lines, n, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    returned = F.col("l_returnflag") == "R"
    sums = joined.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("ext"),
        F.count_if(returned).alias("n_ret"),
        F.count_if(returned & (F.col("l_linestatus") == "F")).alias("n_ret_f"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
    )
    spread = F.pmod(F.xxhash64("value"), F.lit(SPREAD))
    kinds = [F.struct(F.lit(no).alias("kind"), F.col(c).alias("value")) for no, c in enumerate(("l_partkey", "l_suppkey"))]
    pairs = joined.select("k", F.inline(F.array(*kinds))).where(F.col("value").isNotNull())
    pairs = pairs.select("k", (spread * 2 + F.col("kind")).cast("int").alias("part"), "value")
    pairs = _dealt(pairs, 2 * n, "k", "part").distinct()
    kind = F.col("part") % 2
    distinct = pairs.groupBy("k").agg(F.count_if(kind == 0).alias("n_parts"), F.count_if(kind == 1).alias("n_supp"))
    return sums.join(distinct, "k", "left").fillna(0, ["n_parts", "n_supp"])


def report_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `REPORT_SQL`, its two aggregates planned for tables of any size."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    li = lines_by_org(tables["orders"], tables.pop("lineitem"))
    orders = tables["orders"]
    tables["orders"] = _dealt(orders, orders.count(), "o_orderkey", "o_custkey")
    return spark.sql("WITH li AS (SELECT * FROM {li}), od AS (" + ORDERS_SQL + ")\n" + ORGS_SQL, li=li, **tables)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, staged: every statistic of the analysis reads it more than once."""
    return staged_once(spark, sf_dir, "report", lambda: report_view(spark, sf_dir), inputs(sf_dir))


def inputs(sf_dir: str) -> list[str]:
    """The tables that the report is derived from; what is staged follows their modification times."""
    return [f"{sf_dir}/{t}.parquet" for t in TABLES]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored report, staged: summaries and analyses all start from it."""
    return staged_once(
        spark, sf_dir, "enriched", lambda: scoring.enrich(report(spark, sf_dir), CONFIG), inputs(sf_dir)
    )
