"""Immutable settings of the report analysis.

Everything a yearly report may want to change (thresholds, ceilings, forms, directions, header
patterns) is data here; operators take a :class:`ScoringConfig` and never read module globals.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields, replace

# ---- fixed values: level and form names -------------------------------------------------------

FORM_NAMES = {
    0: "Иная форма",
    1: "Уполномоченное должностное лицо",
    2: "Временный коллегиальный орган / комиссия",
    3: "Постоянно действующий коллегиальный орган",
    4: "Уполномоченное структурное подразделение",
}
UNKNOWN_FORM = "Неизвестно"

KEPT_ORG_TYPES = ("Высшее образование", "Научные учреждения")
OTHER_ORG_TYPE = "Другие"

RISK_GROUPS = {
    "A": "A. Сбалансированная СВК",
    "B": "B. Недопокрытие активных направлений",
    "C": "C. Слабая форма СВК при имеющейся нагрузке",
    "D": "D. Двойной риск: непокрытие + слабая форма",
    "E": "E. Отчет не заполнен / данные требуют проверки",
}

NOT_STATED = "Не указано"

# ---- fixed values: the three scale axes and their unit ratios ---------------------------------

AXES = ("cash_receipts", "staff_avg", "fkhz_count")
AXIS_LABELS = {
    "cash_receipts": "Сумма кассовых поступлений",
    "staff_avg": "Среднесписочная численность",
    "fkhz_count": "Количество фактов ФХЖ",
}
# name, numerator, denominator, wording in the reason text
AXIS_RATIOS = (
    ("cash_per_staff", "cash_receipts", "staff_avg", "поступления на 1 сотрудника"),
    ("fkhz_per_staff", "fkhz_count", "staff_avg", "факты ФХЖ на 1 сотрудника"),
    ("cash_per_fkhz", "cash_receipts", "fkhz_count", "поступления на 1 факт ФХЖ"),
)
ROBUST_Z_LIMIT = 3.5
CHI2_3_P99 = 11.345

# ---- fixed values: column classes -------------------------------------------------------------

BASIC_ELEMENTS = ("accounting_policy", "lna_approved", "powers_defined", "plan_schedule")
ELEMENT_LABELS = {
    "svk_organized": "СВК организован и осуществляется",
    "accounting_policy": "Раздел СВК в учетной политике",
    "lna_approved": "Организация СВК утверждена ЛНА",
    "powers_defined": "Определены полномочия ответственных лиц",
    "plan_schedule": "План-график мероприятий СВК",
}
MEASURES = (
    "violations_total",
    "disciplinary_decisions",
    "cancelled_decisions",
    "materials_law_enforcement",
    "returned_refused",
    "materials_court",
    "refused_satisfaction",
)
REPEATED_VALUE_FIELDS = (
    "violations_total",
    "violations_fixed_on_time",
    "violations_fixed_late",
    "remediation_plans",
    "lna_changes",
)


@dataclass(frozen=True)
class Form:
    column: str
    level: int
    name: str


@dataclass(frozen=True)
class Direction:
    key: str
    name: str
    cover_column: str
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class Ceiling:
    """Absolute limit above which a value is reported as suspicious."""

    column: str
    wording: str
    limit: float


FORMS = (
    Form("form_responsible_person", 1, "Уполномоченное должностное лицо"),
    Form("form_temporary_body", 2, "Временный коллегиальный орган / комиссия"),
    Form("form_permanent_body", 3, "Постоянно действующий коллегиальный орган"),
    Form("form_structural_unit", 4, "Уполномоченное структурное подразделение"),
)

DIRECTIONS = (
    Direction(
        "fhd",
        "Финансово-хозяйственная деятельность",
        "cover_fhd",
        ("cash_receipts", "cash_payments", "staff_avg", "fkhz_count"),
    ),
    Direction("procurement", "Закупки", "cover_procurement", ("procurement_count", "procurement_amount")),
    Direction(
        "property",
        "Имущество",
        "cover_property",
        (
            "buildings_count",
            "buildings_area",
            "land_count",
            "land_area",
            "ocdi_count",
            "ocdi_value",
            "real_estate_ops_count",
            "real_estate_ops_area",
            "ocdi_ops_count",
            "ocdi_ops_value",
        ),
    ),
    Direction(
        "project",
        "Проектная деятельность",
        "cover_project",
        ("project_count", "project_amount", "contracts_count", "contracts_amount"),
    ),
)

CEILINGS = (
    Ceiling("violations_total", "нарушений", 605),
    Ceiling("staff_avg", "среднесписочной численности", 4238),
    Ceiling("cash_payments", "кассовых выплат", 20175413543),
    Ceiling("procurement_count", "закупок", 11941),
    Ceiling("procurement_amount", "объема закупок", 6138122952),
    Ceiling("fkhz_count", "ФХЖ", 2392993),
)


@dataclass(frozen=True)
class ScoringConfig:
    level_cuts: tuple[float, float, float] = (0.75, 0.90, 0.95)
    bump_enabled: bool = True
    bump_min_directions: int = 3
    bump_min_level: int = 2
    bump_by: int = 1
    min_group_size: int = 5
    n_bins: int = 12
    forms: tuple[Form, ...] = FORMS
    directions: tuple[Direction, ...] = DIRECTIONS
    ceilings: tuple[Ceiling, ...] = CEILINGS

    @property
    def metrics(self) -> tuple[str, ...]:
        return tuple(m for d in self.directions for m in d.metrics)

    def with_min_group_size(self, size: int) -> "ScoringConfig":
        return replace(self, min_group_size=int(size))

    def with_ceilings(self, limits: dict[str, float]) -> "ScoringConfig":
        return replace(
            self, ceilings=tuple(replace(c, limit=limits.get(c.column, c.limit)) for c in self.ceilings)
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "ScoringConfig":
        """Settings from a JSON object; what it leaves out keeps its default, unknown names are an error."""
        given = json.loads(text)
        unknown = given.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        parts = {"forms": Form, "directions": Direction, "ceilings": Ceiling}
        for name, kind in parts.items():
            if name in given:
                given[name] = tuple(kind(**_tupled(x)) for x in given[name])
        return cls(**_tupled(given))


def _tupled(values: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}


@dataclass(frozen=True)
class ReportColumn:
    """Canonical column: display label and ordered header patterns."""

    name: str
    label: str
    patterns: tuple[str, ...] = field(default=())


def columns_to_json(columns: Iterable[ReportColumn]) -> str:
    return json.dumps([asdict(c) for c in columns], ensure_ascii=False, indent=2)


def columns_from_json(text: str) -> tuple[ReportColumn, ...]:
    """The column map of a report: canonical names, labels and header patterns in order."""
    return tuple(ReportColumn(**_tupled(c)) for c in json.loads(text))


def _rc(name: str, label: str, *patterns: str) -> ReportColumn:
    return ReportColumn(name, label, patterns)


# ---- fixed values: canonical columns and the header patterns that identify them ---------------

REPORT_COLUMNS = (
    _rc("org_name", "Наименование организации", r"^Наименование организации$"),
    _rc("org_type", "Тип организации", r"^Тип организации\.1$", r"^Тип организации$"),
    _rc("federal_district", "Федеральный округ", r"^Федеральный округ$"),
    _rc("region", "Регион", r"^Регион$"),
    _rc("report_status", "Статус отчета", r"^Статус отчета$"),
    _rc("report_date", "Дата заполнения", r"^Дата заполнения$"),
    _rc("contact_name", "ФИО контактного лица", r"^ФИО$"),
    _rc("contact_phone", "Телефон", r"^Телефон$"),
    _rc("contact_email", "Эл.почта", r"^Эл\.почта$"),
    _rc("svk_organized", "СВК организован и осуществляется", r"организован и осуществляется внутренний контроль"),
    _rc("accounting_policy", "Раздел СВК в учетной политике", r"Наличие в учетной политике.*внутреннего контроля"),
    _rc("lna_approved", "Организация СВК утверждена ЛНА", r"Организация и осуществление внутреннего контроля утверждена ЛНА"),
    _rc("powers_defined", "Определены полномочия ответственных лиц", r"Определены ли полномочия ответственных лиц"),
    _rc("plan_schedule", "План-график мероприятий СВК", r"план-графика мероприятий.*внутреннего контроля"),
    _rc("form_permanent_body", "Постоянно действующий коллегиальный орган", r"Создан постоянно действующий уполномоченный коллегиальный орган"),
    _rc("form_temporary_body", "Временный коллегиальный орган / комиссия", r"коллегиальный орган.*создается на период проведения мероприятия"),
    _rc("form_structural_unit", "Уполномоченное структурное подразделение", r"Создано уполномоченное структурное подразделение"),
    _rc("form_responsible_person", "Уполномоченное должностное лицо", r"Назначено уполномоченное должностное лицо"),
    _rc("form_other", "Иной способ обеспечения СВК", r"Иной способ обеспечения функционирования системы внутреннего контроля"),
    _rc("form_other_text", "Описание иного способа обеспечения СВК", r"Укажите иной способ обеспечения функционирования системы внутреннего контроля"),
    _rc("cover_fhd", "Контроль ФХД", r"Финансово-хозяйственная деятельность"),
    _rc("cover_procurement", "Контроль закупок", r"Деятельность по закупке товаров, работ, услуг"),
    _rc("cover_property", "Контроль имущества", r"Деятельность по использованию и распоряжению федеральным имуществом"),
    _rc("cover_project", "Контроль проектной деятельности", r"Проектная деятельность"),
    _rc("cover_other", "Контроль иных видов деятельности", r"Иные виды деятельности"),
    _rc("cover_other_text", "Описание иных направлений контроля", r"Укажите иные виды направления деятельности"),
    _rc("violations_total", "Выявленные нарушения", r"Количество выявленных нарушений"),
    _rc("violations_fixed_on_time", "Нарушения устранены в срок", r"Из них устранено в срок"),
    _rc("violations_fixed_late", "Нарушения устранены с нарушением срока", r"Из них устранено с нарушением срока"),
    _rc("remediation_plans", "Планы устранения нарушений", r"Количество разработанных планов по устранению"),
    _rc("lna_changes", "Решения по внесению изменений в ЛНА", r"решений по внесению изменений в ЛНА"),
    _rc("disciplinary_decisions", "Дисциплинарная ответственность", r"привлечении к дисциплинарной ответственности"),
    _rc("materials_law_enforcement", "Материалы в правоохранительные органы / контрольные органы", r"материалов, направленных в правоохранительные органы"),
    _rc("materials_court", "Материалы в суд", r"материалов, направленных в суд"),
    _rc("cancelled_decisions", "Отменены в порядке обжалования", r"Из них отменены в порядке обжалования"),
    _rc("returned_refused", "Возвращены, получен отказ", r"Из них возвращены, получен отказ"),
    _rc("refused_satisfaction", "Отказано в удовлетворении", r"Из них отказано в удовлетворении"),
    _rc("risk_methodology", "Методика выявления и оценки рисков", r"Наличие и реализация методики по выявлению и оценке рисков"),
    _rc("effectiveness_review", "Внутренняя оценка эффективности СВК", r"Проведение внутренней оценки эффективности"),
    _rc("improvement_actions", "Совершенствование СВК на основе оценки", r"Совершенствование организации и осуществления внутреннего контроля"),
    _rc("cash_receipts", "Кассовые поступления", r"Общая сумма кассовых поступлений"),
    _rc("cash_payments", "Кассовые выплаты", r"Общая сумма кассовых выплат"),
    _rc("staff_planned_start", "Штатная численность на начало года", r"Штатная численность 01\.01"),
    _rc("staff_planned_end", "Штатная численность на конец года", r"Штатная численность 31\.12"),
    _rc("staff_actual_start", "Фактическая численность на начало года", r"Фактическая численность 01\.01"),
    _rc("staff_actual_end", "Фактическая численность на конец года", r"Фактическая численность 31\.12"),
    _rc("staff_avg", "Среднесписочная численность", r"Среднесписочная численность"),
    _rc("buildings_count", "Здания и сооружения, ед.", r"здания и сооружения.*ед"),
    _rc("buildings_area", "Здания и сооружения, кв.м.", r"здания и сооружения.*кв.м"),
    _rc("land_count", "Земельные участки, ед.", r"земля.*земельные участки.*ед"),
    _rc("land_area", "Земельные участки, кв.м.", r"земля.*земельные участки.*кв.м"),
    _rc("ocdi_count", "ОЦДИ, ед.", r"Особо ценное движимое имущество.*ед"),
    _rc("ocdi_value", "ОЦДИ, руб.", r"Особо ценное движимое имущество.*руб"),
    _rc("real_estate_ops_count", "Операции с недвижимым имуществом, ед.", r"Операции по распоряжению недвижимым имуществом.*ед"),
    _rc("real_estate_ops_area", "Операции с недвижимым имуществом, кв.м.", r"Операции по распоряжению недвижимым имуществом.*кв.м"),
    _rc("ocdi_ops_count", "Операции с ОЦДИ, ед.", r"Операции по распоряжению особо ценным движимым имуществом.*ед"),
    _rc("ocdi_ops_value", "Операции с ОЦДИ, руб.", r"Операции по распоряжению особо ценным движимым имуществом.*руб"),
    _rc("procurement_count", "Закупки, ед.", r"Совокупный годовой объем закупок.*ед"),
    _rc("procurement_amount", "Закупки, руб.", r"Совокупный годовой объем закупок.*руб"),
    _rc("project_count", "Нацпроекты / госпрограммы, ед.", r"участия в национальных проектах.*ед"),
    _rc("project_amount", "Нацпроекты / госпрограммы, руб.", r"участия в национальных проектах.*руб"),
    _rc("contracts_count", "Хозяйственные договоры, ед.", r"хозяйственным договорам.*ед"),
    _rc("contracts_amount", "Хозяйственные договоры, руб.", r"хозяйственным договорам.*руб"),
    _rc("fkhz_count", "Факты хозяйственной жизни, ед.", r"Общее количество Фактов хозяйственной жизни"),
)

# Three texts that mark the header row of a report sheet; two of them are enough.
HEADER_MARKERS = ("№ п/п", "Наименование организации", "Статус отчета")
