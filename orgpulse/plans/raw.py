"""Raw inputs derived from the given tables: sheets with title rows, header layouts, dirty answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.plans.fixture import table

NBSP = "\u00a0"

# Header row of a derived sheet; every fifth source spells it so that too few markers remain.
SHEET_HEADERS = ["№ п/п", "Наименование организации", "Статус отчета", "Общая сумма кассовых поступлений, руб."]
BROKEN_HEADERS = ["Номер", "Наименование организации", "Статус", "Сумма"]

# Header layouts of derived report files, chosen by the key modulo their number.
LAYOUTS = (
    [
        "№ п/п",
        "Наименование организации",
        "Тип организации",
        "Тип организации",
        "Регион",
        "Статус отчета",
        "Общая сумма кассовых поступлений, руб.",
    ],
    [f"Наименование{NBSP}организации", "Тип\nорганизации", "Среднесписочная численность", " Количество выявленных   нарушений, ед."],
    ["наименование организации", "ЗДАНИЯ И СООРУЖЕНИЯ, ЕД.", "здания и сооружения, кв.м.", "Эл.почта"],
    ["Регион", "Федеральный округ", "Финансово-хозяйственная деятельность", "Проектная деятельность", "Проектная деятельность (план)"],
)

YES_NO_ANSWERS = ("Да", " да, частично", "Нет", "нетипично", "данные", "нет данных", "-", None)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per nation: two title rows, a header row, one row per customer."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    header = F.when(F.col("n_nationkey") % 5 == 4, F.array(*[F.lit(h) for h in BROKEN_HEADERS])).otherwise(
        F.array(*[F.lit(h) for h in SHEET_HEADERS])
    )
    top = nation.select(
        F.col("n_name").alias("source"),
        F.posexplode(
            F.array(
                F.array(F.lit("Сводный отчет"), F.col("n_name"), none, none),
                F.array(F.lit("  "), none, none, none),
                header,
            )
        ).alias("pos", "cells"),
    )
    status = F.when(F.col("c_custkey") % 50 == 7, "Не заполнен").otherwise("Отчет принят")
    body = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("source"),
        (F.col("c_custkey") + 10).alias("pos"),
        F.array(F.col("c_custkey").cast("string"), F.col("c_name"), status, F.col("c_acctbal").cast("string")).alias("cells"),
    )
    return top.select("source", F.col("pos").cast("long").alias("pos"), "cells").unionByName(body)


def uneven_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet that holds every second customer, and a sheet for each of the others; a fifth of the small
    ones has a header with too few markers."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    shared = key % 2 == 0
    source = F.when(shared, "all").otherwise(F.concat(F.lit("file "), key.cast("string")))
    good, broken = (F.array(*[F.lit(h) for h in headers]) for headers in (SHEET_HEADERS, BROKEN_HEADERS))
    row = F.array(key.cast("string"), F.col("c_name"), F.lit("Отчет принят"), F.col("c_acctbal").cast("string"))
    body = customer.select(source.alias("source"), (key + 10).cast("long").alias("pos"), row.alias("cells"))
    tops = customer.select(
        source.alias("source"), F.lit(0).cast("long").alias("pos"), F.when(key % 10 == 9, broken).otherwise(good).alias("cells")
    )
    return tops.dropDuplicates(["source"]).unionByName(body)


def header_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file header per customer."""
    which = F.col("c_custkey") % len(LAYOUTS)
    headers = F.array(*[F.lit(h) for h in LAYOUTS[0]])
    for i, layout in enumerate(LAYOUTS[1:], start=1):
        headers = F.when(which == i, F.array(*[F.lit(h) for h in layout])).otherwise(headers)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source"), headers.alias("headers"))


def dirty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, yes/no answers and free text as people type them."""
    key = F.col("c_custkey")
    amount = F.format_number("c_acctbal", 2)
    spaced = F.translate(amount, ",.", NBSP + ",")
    plain = F.concat(F.regexp_replace(amount, ",", ""), F.lit(" руб."))
    number = F.when(key % 10 == 0, spaced).when(key % 10 == 1, plain)
    for case, text in enumerate(("(500)", "-", "—", "", "нет данных", "12.05.2024", "5-3"), start=2):
        number = number.when(key % 10 == case, text)
    answer = F.lit(None).cast("string")
    for case, text in enumerate(YES_NO_ANSWERS):
        if text is not None:
            answer = F.when(key % 8 == case, text).otherwise(answer)
    words = F.concat(F.lit(f" {NBSP} "), F.col("c_name"), F.lit("\n \t"), F.col("c_mktsegment"), F.lit(" "))
    text = F.when(key % 6 == 0, "Не  указано").when(key % 6 == 1, f"{NBSP}—").otherwise(words)
    return table(spark, sf_dir, "customer").select(
        key.alias("org_id"),
        number.alias("amount_text"),
        answer.alias("answer_text"),
        text.alias("free_text"),
        F.col("c_acctbal").alias("balance"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations of every nation's file, with the time of the nation's newest order."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    # Newest order per customer first: an even key, where the nation alone would be 25 hot ones.
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    rows = customer.join(newest, F.col("o_custkey") == F.col("c_custkey"), "left")
    times = rows.groupBy("c_nationkey").agg(F.max("at").alias("modified"))
    nation = table(spark, sf_dir, "nation").join(times, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "n_nationkey", F.col("n_name").alias("source"), "modified"
    )
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "source", "modified", F.col("c_custkey").alias("org_id"), F.col("c_name").alias("org_name")
    )
