"""Row-level rule flags. Each rule is a condition with a fixed text; texts are joined by "; "."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.config import BASIC_ELEMENTS, REPEATED_VALUE_FIELDS, ScoringConfig
from orgpulse.functions import cleaning as C

# ---- fixed values: rule texts -----------------------------------------------------------------

FIXED_OVER_TOTAL = "Устраненных нарушений больше, чем выявленных"
CANCELLED_OVER_DECIDED = "Отменено больше дисциплинарных решений, чем принято"
RETURNED_OVER_SENT = "Возвращено больше материалов, чем направлено в правоохранительные органы"
REFUSED_OVER_SENT = "Отказано в удовлетворении больше материалов, чем направлено в суд"
ELEMENTS_WITHOUT_CONTROL = "СВК не организован, но заполнены элементы СВК"
CEILING = "Аномально высокое значение {wording} (>{limit})"
COPY_PASTE = "Подозрительно одинаковые значения в нескольких полях ("
NO_VIOLATIONS = "Ноль нарушений при большой организации (персонал >{limit})"
NO_PURCHASES = "Ноль закупок при большой организации (персонал >{limit})"
HIGH_RATIO = "Аномально высокое соотношение нарушений к ФХЖ (>{limit})"
CONTROL_WITHOUT_ELEMENTS = "СВК организован, но отсутствует один или несколько базовых элементов"
WEAK_FORM = "Высокая нагрузка при отсутствующей/минимальной форме СВК"
LOADED_UNCOVERED = "Высокая нагрузка по направлению '{key}', но направление не покрыто СВК"


def join_texts(texts: list[Column]) -> Column:
    return F.concat_ws("; ", *texts) if texts else F.lit("")


def _have(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _exceeds(df: DataFrame, part: Column, whole: str, text: str) -> Column:
    total = C.number_or_zero(df, whole)
    return F.when((total > 0) & (part > total), text)


def _fixed(df: DataFrame) -> Column:
    return C.number_or_zero(df, "violations_fixed_on_time") + C.number_or_zero(df, "violations_fixed_late")


def _any_element(df: DataFrame, test) -> Column:
    present = [test(C.flag_or_zero(df, c)) for c in BASIC_ELEMENTS if c in df.columns]
    return reduce(lambda a, b: a | b, present, F.lit(False))


def contradictions(df: DataFrame) -> Column:
    """Answers that contradict each other; a rule is skipped when one of its columns is absent."""
    texts = []
    if _have(df, "violations_total", "violations_fixed_on_time", "violations_fixed_late"):
        texts.append(_exceeds(df, _fixed(df), "violations_total", FIXED_OVER_TOTAL))
    for whole, part, text in (
        ("disciplinary_decisions", "cancelled_decisions", CANCELLED_OVER_DECIDED),
        ("materials_law_enforcement", "returned_refused", RETURNED_OVER_SENT),
        ("materials_court", "refused_satisfaction", REFUSED_OVER_SENT),
    ):
        if _have(df, whole, part):
            texts.append(_exceeds(df, C.number_or_zero(df, part), whole, text))
    if _have(df, "svk_organized"):
        not_organised = C.flag_or_zero(df, "svk_organized") != 1
        texts.append(F.when(not_organised & _any_element(df, lambda f: f == 1), ELEMENTS_WITHOUT_CONTROL))
    return join_texts(texts)


def ceiling_texts(df: DataFrame, cfg: ScoringConfig) -> list[Column]:
    return [
        F.when(
            C.number_or_zero(df, c.column) > F.lit(float(c.limit)),
            CEILING.format(wording=c.wording, limit=f"{c.limit:,.0f}"),
        )
        for c in cfg.ceilings
        if c.column in df.columns
    ]


def copy_paste_texts(df: DataFrame) -> list[Column]:
    """Three or more positive values, all of them equal."""
    if not _have(df, *REPEATED_VALUE_FIELDS):
        return []
    values = F.filter(F.array(*[C.number_or_zero(df, c) for c in REPEATED_VALUE_FIELDS]), lambda v: v > 0)
    same = (F.size(values) >= 3) & (F.array_min(values) == F.array_max(values))
    return [F.when(same, F.concat(F.lit(COPY_PASTE), C.python_float_text(F.array_min(values)), F.lit(")")))]


def _around(text: str, limit: Column) -> Column:
    """A rule text around the limit as it is shown."""
    before, after = text.split("{limit}")
    return F.concat(F.lit(before), limit, F.lit(after))


@dataclass(frozen=True)
class Limits:
    """The two limits that follow from the whole report, as columns, and how the texts show them."""

    staff: Column
    staff_shown: Column
    ratio: Column
    ratio_shown: Column

    @classmethod
    def of(cls, staff_p75: float, ratio_p99: float) -> Limits:
        return cls(*[F.lit(v) for v in limit_values(staff_p75, ratio_p99).values()])


def limit_values(staff_p75: float, ratio_p99: float) -> dict[str, float | str]:
    return {
        "staff": float(staff_p75),
        "staff_shown": f"{staff_p75:.0f}",
        "ratio": float(ratio_p99),
        "ratio_shown": f"{ratio_p99:.4f}",
    }


def zero_large_texts(df: DataFrame, limits: Limits) -> list[Column]:
    """Nothing reported although the organisation is in the upper quarter by staff."""
    large = C.number_or_zero(df, "staff_avg") > limits.staff
    return [
        F.when(large & (C.number_or_zero(df, name) == 0), _around(text, limits.staff_shown))
        for name, text in (("violations_total", NO_VIOLATIONS), ("procurement_count", NO_PURCHASES))
        if _have(df, name, "staff_avg")
    ]


def ratio_texts(df: DataFrame, limits: Limits) -> list[Column]:
    if not _have(df, "violations_total", "fkhz_count"):
        return []
    ratio = C.safe_ratio(C.number_or_zero(df, "violations_total"), C.number_or_zero(df, "fkhz_count"))
    return [F.when(ratio > limits.ratio, _around(HIGH_RATIO, limits.ratio_shown))]


def anomalies(df: DataFrame, cfg: ScoringConfig, staff_p75: float, ratio_p99: float) -> Column:
    return anomalies_within(df, cfg, Limits.of(staff_p75, ratio_p99))


def anomalies_within(df: DataFrame, cfg: ScoringConfig, limits: Limits) -> Column:
    return join_texts(
        ceiling_texts(df, cfg)
        + copy_paste_texts(df)
        + zero_large_texts(df, limits)
        + ratio_texts(df, limits)
    )


def quality_flags(df: DataFrame, cfg: ScoringConfig) -> Column:
    """Flags of a scored report: missing elements, arithmetic, weak form, uncovered load."""
    texts = []
    if _have(df, "svk_organized"):
        organised = C.flag_or_zero(df, "svk_organized") == 1
        texts.append(F.when(organised & _any_element(df, lambda f: f != 1), CONTROL_WITHOUT_ELEMENTS))
    if _have(df, "violations_total", "violations_fixed_on_time", "violations_fixed_late"):
        texts.append(_exceeds(df, _fixed(df), "violations_total", FIXED_OVER_TOTAL))
    texts.append(F.when((F.col("max_direction_load_level") >= 3) & (F.col("svk_form_level") <= 1), WEAK_FORM))
    for d in cfg.directions:
        loaded = (F.col(f"{d.key}_load_level") >= 3) & (F.col(f"{d.key}_covered") != 1)
        texts.append(F.when(loaded, LOADED_UNCOVERED.format(key=d.key)))
    return join_texts(texts)
