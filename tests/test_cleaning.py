import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.functions import cleaning as C
from orgpulse.functions.labels import relabel

NBSP = "\u00a0"


def one(spark, values, make):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.StringType())])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("out")).collect()]


def test_clean_text(spark):
    cases = {
        None: None,
        "": None,
        f" {NBSP} ": None,
        "-": None,
        "—": None,
        "NaN": None,
        "None": None,
        "Нет  данных": None,
        "НЕ ЗАПОЛНЕНО": None,
        f"не{NBSP}указано": None,
        f" a{NBSP} \n\tb ": "a b",
        "нет данных по форме": "нет данных по форме",
    }
    assert one(spark, list(cases), C.clean_text) == list(cases.values())


def test_yes_flag_agrees_with_cleaned_prefix(spark):
    cases = {
        "Да": 1.0,
        " да, частично": 1.0,
        f"{NBSP}ДА": 1.0,
        "данные": 1.0,
        "Нет": 0.0,
        "нетипично": 0.0,
        "нет данных": None,
        f" Нет{NBSP} данных\n": None,
        "нет данных за год": 0.0,
        "-": None,
        "": None,
        None: None,
        "не знаю": None,
    }
    assert one(spark, list(cases), C.yes_flag) == list(cases.values())

    def by_prefix(c):
        low = F.lower(C.clean_text(c))
        return F.when(low.startswith("да"), 1.0).when(low.startswith("нет"), 0.0)

    assert one(spark, list(cases), by_prefix) == list(cases.values())


def test_to_number(spark):
    cases = {
        f"1{NBSP}234,56": 1234.56,
        "1 234.5": 1234.5,
        "1234.56 руб.": None,
        "(500)": 500.0,
        "1e5": 15.0,
        "№ 7 шт": 7.0,
        "1.2.3": None,
        "5-3": None,
        "-12,5": -12.5,
        "5.": 5.0,
        ".5": 0.5,
        "-": None,
        ".": None,
        "-.": None,
        "—": None,
        "": None,
        "нет данных": None,
        None: None,
    }
    got = one(spark, list(cases), lambda c: C.to_number(c, T.StringType()))
    assert got == list(cases.values())


def test_numbers_pass_through_and_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, 1e7, 5), (2, float("nan"), None)], "i int, d double, n int")
    rows = df.orderBy("i").select(C.number_or_null(df, "d"), C.number_or_zero(df, "n"), C.number_or_null(df, "no")).collect()
    assert [tuple(r) for r in rows] == [(1e7, 5.0, None), (None, 0.0, None)]


def test_filled(spark):
    cases = {
        None: True,
        "-": True,
        "Не заполнен": False,
        f"Отчёт  не{NBSP}заполнен ": False,
        "не заполнено": True,  # a placeholder, so the status is unknown
        "Не заполнено полностью": False,
        "Принят": True,
    }
    assert one(spark, list(cases), C.is_filled) == list(cases.values())


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (
            C.risk_methodology_class,
            {
                "Методика отсутствует, план есть": C.RISK_ABSENT,
                "применяется фрагментарно": C.RISK_FRAGMENTARY,
                "План по рискам": C.RISK_FULL,
                "карты рисков": C.RISK_FULL,
                "план": "план",
                "-": "Не указано",
                None: "Не указано",
            },
        ),
        (
            C.effectiveness_class,
            {
                "Не проводится регулярно": C.REVIEW_NONE,
                "Нерегулярно": C.REVIEW_IRREGULAR,
                "не реже раза в год": C.REVIEW_REGULAR,
                "Иное  мнение": "Иное мнение",
            },
        ),
        (
            C.improvement_class,
            {
                "не планируются": C.IMPROVE_NONE,
                "реализуются не в полном объеме": C.IMPROVE_PARTIAL,
                "Документированы": C.IMPROVE_DONE,
                "": "Не указано",
            },
        ),
        (
            C.org_type_class,
            {
                f" Высшее образование{NBSP}": "Высшее образование",
                "Научные учреждения": "Научные учреждения",
                "Культура": "Другие",
                None: "Другие",
            },
        ),
    ],
)
def test_classes(spark, make, cases):
    assert one(spark, list(cases), make) == list(cases.values())


def test_clean_frame(spark):
    df = spark.createDataFrame([("1,5", "Да", " a  b ", 2.0)], "n string, y string, t string, d double")
    out = C.clean_frame(df, ["n", "d"], ["y"])
    assert out.columns == ["n", "y", "t", "d", "y__flag"]
    assert tuple(out.first()) == (1.5, "Да", "a b", 2.0, 1.0)


def test_float_text(spark):
    df = spark.createDataFrame([(5.0,), (1e7,), (12.25,), (123456789.5,)], "v double")
    got = [r[0] for r in df.select(C.python_float_text(F.col("v"))).collect()]
    assert got == [str(v) for v in (5.0, 1e7, 12.25, 123456789.5)]


def test_relabel(spark):
    df = spark.createDataFrame([("ФХД", "оценка СВК", 1), (None, "Иное", 2)], "a string, b string, n int")
    rows = [tuple(r) for r in relabel(df).orderBy("n").collect()]
    assert rows[0] == (
        "Финансово-хозяйственная деятельность",
        "оценка эффективности организации и осуществления внутреннего контроля",
        1,
    )
    assert rows[1] == (None, "Иная форма", 2)
    assert relabel(df, ["b", "absent"]).where("n = 1").first()["a"] == "ФХД"
