"""Display relabelling: exact dictionary lookup, then an ordered chain of substring replacements."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: display text of whole labels -----------------------------------------------

DISPLAY_LABELS = {
    "% заполненных отчетов": "Доля заполненных отчётов",
    "% организаций, где СВК организован": "Доля организаций, где внутренний контроль организован и осуществляется",
    "% организаций с полным базовым комплектом СВК": "Доля организаций, где организация внутреннего контроля полностью формализована",
    "% организаций с полноценной методикой оценки рисков": "Доля организаций, где методика по выявлению и оценке рисков применяется",
    "% организаций с регулярной оценкой эффективности СВК": "Доля организаций с регулярной оценкой эффективности организации и осуществления внутреннего контроля",
    "Выявленные нарушения": "Количество выявленных нарушений, ед.",
    "% нарушений, устраненных в срок": "Доля нарушений, устранённых в срок",
    "Организаций, где СВК организован": "Количество организаций, где внутренний контроль организован и осуществляется",
    "Организаций с полным базовым комплектом СВК": "Количество организаций, где организация внутреннего контроля полностью формализована",
    "Организаций с регулярной оценкой эффективности СВК": "Количество организаций с регулярной оценкой эффективности организации и осуществления внутреннего контроля",
    "Организаций со слабой формой СВК": "Количество организаций, где форма обеспечения функционирования внутреннего контроля ниже расчётной рекомендации",
    "СВК организован": "Внутренний контроль организован и осуществляется",
    "СВК организован и осуществляется": "Внутренний контроль организован и осуществляется",
    "Раздел СВК в учетной политике": "Раздел/положение об организации и осуществлении внутреннего контроля в учётной политике",
    "Организация СВК утверждена ЛНА": "Организация и осуществление внутреннего контроля утверждена ЛНА",
    "СВК утвержден ЛНА": "Организация и осуществление внутреннего контроля утверждена ЛНА",
    "Определены полномочия": "Определены полномочия ответственных лиц",
    "План-график мероприятий СВК": "Утверждённый план-график мероприятий по организации и осуществлению внутреннего контроля",
    "План-график мероприятий": "Утверждённый план-график мероприятий по организации и осуществлению внутреннего контроля",
    "Уполномоченное должностное лицо": "Уполномоченное должностное лицо",
    "Назначено уполномоченное должностное лицо": "Уполномоченное должностное лицо",
    "Временный коллегиальный орган": "Временный коллегиальный орган",
    "Временный коллегиальный орган / комиссия": "Временный коллегиальный орган",
    "Постоянный коллегиальный орган": "Постоянный коллегиальный орган",
    "Постоянно действующий коллегиальный орган": "Постоянный коллегиальный орган",
    "Структурное подразделение": "Уполномоченное структурное подразделение",
    "Уполномоченное структурное подразделение": "Уполномоченное структурное подразделение",
    "Иная форма": "Иная форма",
    "Иное": "Иная форма",
    "ФХД": "Финансово-хозяйственная деятельность",
    "Закупки": "Деятельность по закупкам",
    "Имущество": "Использование и распоряжение имуществом",
    "Проекты": "Проектная деятельность",
    "Количество выявленных нарушений": "Количество выявленных нарушений, ед.",
    "Устранено в срок": "Из них устранено в срок, ед.",
    "Устранено с нарушением срока": "Из них устранено с нарушением срока, ед.",
    "Остаток без отраженного устранения": "Остаток без отражённого устранения, ед.",
    "Планы устранения": "Количество разработанных планов устранения, ед.",
    "Изменения в ЛНА": "Количество принятых решений по внесению изменений в ЛНА, ед.",
    "Дисциплинарные решения": "Количество решений о привлечении к дисциплинарной ответственности, ед.",
    "Дисциплинарная ответственность: решений принято": "Количество решений о привлечении к дисциплинарной ответственности, ед.",
    "  → из них отменены в порядке обжалования": "Из них отменены в порядке обжалования",
    "Отменены в порядке обжалования": "Из них отменены в порядке обжалования",
    "Материалы в правоохранительные органы": "Количество материалов, направленных в правоохранительные органы и органы госконтроля и надзора, ед.",
    "Материалы в правоохранительные органы: направлено": "Количество материалов, направленных в правоохранительные органы и органы госконтроля и надзора, ед.",
    "  → из них возвращены, получен отказ": "Из них возвращены, получен отказ",
    "Возвращены / отказ": "Из них возвращены, получен отказ",
    "Материалы в суд": "Количество материалов, направленных в суд, ед.",
    "Материалы в суд: направлено": "Количество материалов, направленных в суд, ед.",
    "  → из них отказано в удовлетворении": "Из них отказано в удовлетворении",
    "Отказано в удовлетворении": "Из них отказано в удовлетворении",
    "Полноценная методика": "Методика по выявлению и оценке рисков применяется",
    "полноценная методика": "Методика по выявлению и оценке рисков применяется",
    "Фрагментарная методика": "Методика применяется фрагментарно",
    "фрагментарная / несистемная методика": "Методика применяется фрагментарно",
    "Методика отсутствует": "Методика оценки рисков отсутствует",
    "методика отсутствует": "Методика оценки рисков отсутствует",
    "Регулярная оценка": "Регулярная оценка эффективности внутреннего контроля проводится",
    "регулярная оценка": "Регулярная оценка эффективности внутреннего контроля проводится",
    "Нерегулярная оценка": "Оценка проводится нерегулярно или результаты не оформляются",
    "нерегулярная оценка / результаты не оформляются": "Оценка проводится нерегулярно или результаты не оформляются",
    "Оценка не проводится": "Оценка эффективности внутреннего контроля не проводится",
    "оценка не проводится": "Оценка эффективности внутреннего контроля не проводится",
    "Документированные мероприятия реализуются": "Мероприятия по совершенствованию внутреннего контроля реализуются",
    "документированные мероприятия реализуются": "Мероприятия по совершенствованию внутреннего контроля реализуются",
    "Мероприятия планируются или выполняются частично": "Мероприятия планируются или выполняются не в полном объёме",
    "мероприятия планируются или выполняются частично": "Мероприятия планируются или выполняются не в полном объёме",
    "Мероприятия не планируются": "Мероприятия не планируются и не проводятся",
    "мероприятия не планируются / не проводятся": "Мероприятия не планируются и не проводятся",
    "Покрыто": "Включено в контур внутреннего контроля",
    "Не покрыто": "Не включено в контур внутреннего контроля",
    "covered_orgs": "Включено в контур внутреннего контроля",
    "uncovered_orgs": "Не включено в контур внутреннего контроля",
    "A. Сбалансированная СВК": "Группа A — сбалансированный внутренний контроль (расчётный показатель)",
    "B. Недопокрытие активных направлений": "Группа B — активные направления контроля вне контура внутреннего контроля (расчётный показатель)",
    "C. Слабая форма СВК": "Группа C — форма обеспечения функционирования внутреннего контроля ниже расчётной рекомендации",
    "C. Слабая форма СВК при имеющейся нагрузке": "Группа C — форма обеспечения функционирования внутреннего контроля ниже расчётной рекомендации при имеющейся нагрузке",
    "D. Двойной риск": "Группа D — двойной расчётный риск",
    "D. Двойной риск: непокрытие + слабая форма": "Группа D — двойной расчётный риск",
    "E. Отчет не заполнен / данные требуют проверки": "Группа E — отчёт не заполнен / данные требуют проверки",
    "E. Отчёт не заполнен / данные требуют проверки": "Группа E — отчёт не заполнен / данные требуют проверки",
}

# ---- fixed values: substring replacements, applied in this order ------------------------------

TEXT_REPLACEMENTS = {
    "форма СВК": "форма обеспечения функционирования внутреннего контроля",
    "Форма СВК": "Форма обеспечения функционирования внутреннего контроля",
    "элементы СВК": "элементы организации и осуществления внутреннего контроля",
    "Элементы СВК": "Элементы организации и осуществления внутреннего контроля",
    "оценка СВК": "оценка эффективности организации и осуществления внутреннего контроля",
    "Оценка СВК": "Оценка эффективности организации и осуществления внутреннего контроля",
    "СВК": "внутренний контроль",
}


def _label_map() -> Column:
    """The dictionary as one constant, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(DISPLAY_LABELS, ensure_ascii=False)), "map<string,string>")


def display_label(c: Column, labels: Column | None = None) -> Column:
    labels = _label_map() if labels is None else labels
    text = F.coalesce(F.try_element_at(labels, c), c)
    for old, new in TEXT_REPLACEMENTS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(c.isNotNull(), text)


def relabel(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Relabel the named columns, or every string column when none are named."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    labels = _label_map()
    return df.withColumns({c: display_label(F.col(c), labels) for c in columns if c in df.columns})
