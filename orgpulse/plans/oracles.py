"""DuckDB counterparts of the registered queries, written in the naive single-node form.

They compute on their own: ranks are plain windows, quantiles are `quantile_cont`, nearest peers come
from the full distance table. Constants (labels, flag texts, thresholds, the report SQL) are imported
from the package; tests pin those with literals.
"""

from __future__ import annotations

from orgpulse.config import (
    AXES,
    AXIS_LABELS,
    AXIS_RATIOS,
    BASIC_ELEMENTS,
    ELEMENT_LABELS,
    FORM_NAMES,
    MEASURES,
    REPORT_COLUMNS,
    RISK_GROUPS,
    UNKNOWN_FORM,
)
from orgpulse.functions.labels import DISPLAY_LABELS, TEXT_REPLACEMENTS
from orgpulse.operators import flags as T
from orgpulse.plans.fixture import CONFIG, FIXTURE_CEILINGS, REPORT_SQL, TABLES
from orgpulse.plans.queries import ENRICHED_COLUMNS, SELECTED
from orgpulse.plans.raw import BROKEN_HEADERS, LAYOUTS, SHEET_HEADERS, YES_NO_ANSWERS
from orgpulse.sources.sinks import ORG_KEYS, ROW_KEYS

ORACLES: dict[str, str] = {}

REPORT = REPORT_SQL.format(**{t: t for t in TABLES})
METRICS = [
    "cash_receipts",
    "cash_payments",
    "staff_avg",
    "fkhz_count",
    "procurement_count",
    "procurement_amount",
    "buildings_count",
    "land_count",
    "project_count",
    "project_amount",
]
PRESENT = {d.key: [m for m in d.metrics if m in METRICS] for d in CONFIG.directions}
KEYS = list(PRESENT)
MISSING = "('', '-', '—', 'nan', 'none', 'нет данных', 'не заполнено', 'не указано')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(c: str) -> str:
    text = f"trim(regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
    return f"CASE WHEN lower({text}) NOT IN {MISSING} THEN {text} END"


def yes(c: str) -> str:
    low = f"lower({clean(c)})"
    return f"CASE WHEN starts_with({low}, 'да') THEN 1.0::DOUBLE WHEN starts_with({low}, 'нет') THEN 0.0::DOUBLE END"


def yes0(c: str) -> str:
    return f"coalesce({yes(c)}, 0.0::DOUBLE)"


def rank_pct(c: str, within: str = "") -> str:
    """Average rank over the positive values, divided by their number."""
    return (
        f"CASE WHEN {c} > 0 THEN (rank() OVER (PARTITION BY {c} > 0 ORDER BY {c})"
        f" + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {c} > 0)"
        f" ELSE 0.0::DOUBLE END"
    )


def level(p: str) -> str:
    return f"CASE WHEN {p} <= 0 THEN 0 WHEN {p} <= 0.75 THEN 1 WHEN {p} <= 0.90 THEN 2 WHEN {p} <= 0.95 THEN 3 ELSE 4 END"


def form(c: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in FORM_NAMES.items())
    return f"CASE {c} {cases} ELSE {lit(UNKNOWN_FORM)} END"


def share(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100"


def texts(*cases: str) -> str:
    return f"concat_ws('; ', {', '.join(cases)})"


def when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} END"


def num(c: str) -> str:
    return f"coalesce({c}, 0.0::DOUBLE)"


# ---- scored report ----------------------------------------------------------------------------

_replace = ", ".join(f"coalesce({m}, 0.0::DOUBLE) AS {m}" for m in METRICS)
_pcts = ", ".join(f"{rank_pct(m)} AS {m}_p" for m in METRICS)
_forms = ", ".join(f"{yes0(f.column)} AS {f.column}__yes" for f in CONFIG.forms)
_dirs = ",\n".join(
    f"CAST({yes0(d.cover_column)} AS INTEGER) AS {d.key}_covered, "
    f"CAST(({' + '.join(PRESENT[d.key])}) > 0 AS INTEGER) AS {d.key}_active, "
    f"greatest({', '.join(m + '_p' for m in PRESENT[d.key])}) AS {d.key}_load_score"
    for d in CONFIG.directions
)
_levels = ", ".join(
    f"{level(k + '_load_score')} AS {k}_load_level, CAST({k}_active = 1 AND {k}_covered <> 1 AS INTEGER) AS {k}_uncovered"
    for k in KEYS
)


def _sum(part: str) -> str:
    return " + ".join(f"{k}_{part}" for k in KEYS)


def _max(part: str) -> str:
    return "greatest(" + ", ".join(f"{k}_{part}" for k in KEYS) + ")"


_fixed = f"({num('violations_fixed_on_time')} + {num('violations_fixed_late')})"
_fixed_over = when(
    f"{num('violations_total')} > 0 AND {_fixed} > {num('violations_total')}", lit(T.FIXED_OVER_TOTAL)
)


def _over(part: str, whole: str, text: str) -> str:
    return when(f"{num(whole)} > 0 AND {num(part)} > {num(whole)}", lit(text))


CONTRADICTIONS = texts(
    _fixed_over,
    _over("cancelled_decisions", "disciplinary_decisions", T.CANCELLED_OVER_DECIDED),
    _over("returned_refused", "materials_law_enforcement", T.RETURNED_OVER_SENT),
    _over("refused_satisfaction", "materials_court", T.REFUSED_OVER_SENT),
    when(
        f"{yes0('svk_organized')} <> 1 AND (" + " OR ".join(f"{yes0(c)} = 1" for c in BASIC_ELEMENTS) + ")",
        lit(T.ELEMENTS_WITHOUT_CONTROL),
    ),
)
CEILINGS = [
    when(
        f"{num(c.column)} > {FIXTURE_CEILINGS[c.column]}",
        lit(T.CEILING.format(wording=c.wording, limit=f"{FIXTURE_CEILINGS[c.column]:,.0f}")),
    )
    for c in CONFIG.ceilings
]
_five = (
    "list_filter([" + ", ".join(
        num(c)
        for c in (
            "violations_total",
            "violations_fixed_on_time",
            "violations_fixed_late",
            "remediation_plans",
            "lna_changes",
        )
    ) + "], lambda x: x > 0)"
)
COPY_PASTE = when(
    f"len({_five}) >= 3 AND list_min({_five}) = list_max({_five})",
    f"{lit(T.COPY_PASTE)} || list_min({_five})::VARCHAR || ')'",
)
_P75 = f"(SELECT quantile_cont({num('staff_avg')}, 0.75) FROM rep)"
_P99 = f"(SELECT quantile_cont({num('violations_total')} / nullif({num('fkhz_count')}, 0), 0.99) FROM rep)"


def _limit_text(text: str, fmt: str, value: str) -> str:
    head, tail = text.split("{limit}")
    return f"{lit(head)} || format('{fmt}', {value}) || {lit(tail)}"


ZERO_LARGE = [
    when(f"{num('staff_avg')} > {_P75} AND {num(c)} = 0", _limit_text(t, "{:.0f}", _P75))
    for c, t in (("violations_total", T.NO_VIOLATIONS), ("procurement_count", T.NO_PURCHASES))
]
RATIO = when(
    f"{num('violations_total')} / nullif({num('fkhz_count')}, 0) > {_P99}",
    _limit_text(T.HIGH_RATIO, "{:.4f}", _P99),
)
ANOMALIES = texts(*CEILINGS, COPY_PASTE, *ZERO_LARGE, RATIO)
QUALITY = texts(
    when(
        f"{yes0('svk_organized')} = 1 AND (" + " OR ".join(f"{yes0(c)} <> 1" for c in BASIC_ELEMENTS) + ")",
        lit(T.CONTROL_WITHOUT_ELEMENTS),
    ),
    _fixed_over,
    when("max_direction_load_level >= 3 AND svk_form_level <= 1", lit(T.WEAK_FORM)),
    *[when(f"{k}_load_level >= 3 AND {k}_covered <> 1", lit(T.LOADED_UNCOVERED.format(key=k))) for k in KEYS],
)


def _peer(name: str, key: str) -> str:
    return (
        f"{name} AS (SELECT {key} AS k, count(org_name) AS size, median(svk_form_level) AS form,"
        f" median(coverage_share_active) AS cov FROM s5 GROUP BY 1)"
    )


_profile = "concat_ws('-', " + ", ".join(f"{k}_load_level" for k in KEYS) + ")"
_max_act = "max_direction_load_level || '_act' || active_directions_count"
_max_key = "'max_' || max_direction_load_level"


def _pick(field: str) -> str:
    return f"CASE WHEN g1.size >= 5 THEN g1.{field} WHEN g2.size >= 5 THEN g2.{field} ELSE g3.{field} END"


SCORED = f"""WITH rep AS ({REPORT}),
s1 AS (SELECT * REPLACE ({_replace}) FROM rep),
s2 AS (SELECT *, {_pcts}, {_forms},
  CASE WHEN trim(org_type) IN ('Высшее образование', 'Научные учреждения') THEN trim(org_type) ELSE 'Другие' END AS org_type_classified,
  NOT coalesce(contains(lower({clean('report_status')}), 'не заполн'), false) AS is_report_filled FROM s1),
s3 AS (SELECT *, {_dirs},
  CAST(greatest(0, {', '.join(f'{f.column}__yes * {f.level}' for f in CONFIG.forms)}) AS INTEGER) AS svk_form_level FROM s2),
s4 AS (SELECT *, {_levels}, {form('svk_form_level')} AS svk_form_name FROM s3),
s4b AS (SELECT *, {', '.join(f'{k}_uncovered * {k}_load_level AS {k}_uncovered_load' for k in KEYS)} FROM s4),
s4c AS (SELECT *, {_sum('active')} AS active_directions_count,
  {' + '.join(f'{k}_active * {k}_covered' for k in KEYS)} AS covered_active_directions_count,
  {_sum('uncovered')} AS uncovered_active_directions_count, {_sum('uncovered_load')} AS uncovered_load_sum,
  {_max('uncovered_load')} AS max_uncovered_load, {_max('load_level')} AS max_direction_load_level FROM s4b),
s5 AS (SELECT *, covered_active_directions_count / nullif(active_directions_count, 0)::DOUBLE AS coverage_share_active,
  least(4, max_direction_load_level + CASE WHEN {' + '.join(f'CAST({k}_load_level >= 2 AS INTEGER)' for k in KEYS)} >= 3 THEN 1 ELSE 0 END)
    AS recommended_form_level, {_profile} AS load_profile FROM s4c),
{_peer('g_profile', _profile)},
{_peer('g_max_act', _max_act)},
{_peer('g_max', _max_key)},
s6 AS (SELECT s5.*, {form('recommended_form_level')} AS recommended_form_name,
  svk_form_level - recommended_form_level AS form_gap,
  {_pick('k')} AS peer_group_key,
  CASE WHEN g1.size >= 5 THEN 'profile' WHEN g2.size >= 5 THEN 'max_act' ELSE 'max' END AS peer_group_level,
  {_pick('size')} AS peer_group_size,
  CAST(round_even({_pick('form')}, 0) AS INTEGER) AS peer_form_median, {_pick('cov')} AS peer_coverage_median
  FROM s5 JOIN g_profile g1 ON g1.k = {_profile} JOIN g_max_act g2 ON g2.k = {_max_act} JOIN g_max g3 ON g3.k = {_max_key}),
enr AS (SELECT *, svk_form_level - peer_form_median AS form_vs_peer,
  CASE WHEN NOT is_report_filled THEN {lit(RISK_GROUPS['E'])}
    WHEN uncovered_active_directions_count > 0 AND form_gap < 0 THEN {lit(RISK_GROUPS['D'])}
    WHEN uncovered_active_directions_count > 0 THEN {lit(RISK_GROUPS['B'])}
    WHEN form_gap < 0 THEN {lit(RISK_GROUPS['C'])} ELSE {lit(RISK_GROUPS['A'])} END AS risk_group,
  {CONTRADICTIONS} AS contradictions, {ANOMALIES} AS anomalies, {QUALITY} AS data_quality_flags FROM s6),
fil AS (SELECT * FROM enr WHERE is_report_filled)
"""
RAW = f"WITH rep AS ({REPORT})\n"


def scored(name: str, sql: str) -> None:
    ORACLES[name] = SCORED + sql


def r(c: str, digits: int, name: str | None = None) -> str:
    return f"round({c}, {digits}) AS {name or c}"


# ---- sources ----------------------------------------------------------------------------------

_cells = lambda hs: ", ".join(lit(h) for h in hs)
_sheet = f"""sheet AS (
  SELECT n_name AS source, 0 AS pos, 'Сводный отчет' AS a, n_name AS b, NULL AS c, NULL AS d FROM nation
  UNION ALL SELECT n_name, 1, '  ', NULL, NULL, NULL FROM nation
  UNION ALL SELECT n_name, 2, {_cells(SHEET_HEADERS)} FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT n_name, 2, {_cells(BROKEN_HEADERS)} FROM nation WHERE n_nationkey % 5 = 4
  UNION ALL SELECT n_name, c_custkey + 10, c_custkey::VARCHAR, c_name,
    CASE WHEN c_custkey % 50 = 7 THEN 'Не заполнен' ELSE 'Отчет принят' END, c_acctbal::VARCHAR
    FROM customer JOIN nation ON n_nationkey = c_nationkey),
scan AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS n,
  {' + '.join("CAST(coalesce(contains(concat_ws(chr(1), a, b, c, d), " + lit(m) + "), false) AS INTEGER)" for m in ('№ п/п', 'Наименование организации', 'Статус отчета'))} AS hits FROM sheet),
head AS (SELECT source, coalesce(min(n) FILTER (WHERE hits >= 2 AND n < 30), 0) AS n FROM scan GROUP BY source),
found AS (SELECT s.source, s.n AS header_row, s.hits AS markers, s.hits >= 2 AS accepted, s.pos AS at
  FROM scan s JOIN head h ON h.source = s.source AND h.n = s.n)"""
ORACLES["header_detect"] = f"WITH {_sheet} SELECT source, header_row, markers, accepted FROM found"
ORACLES["rejected_sources"] = f"WITH {_sheet} SELECT source, markers FROM found WHERE NOT accepted"
ORACLES["canonical_frame"] = (
    f"WITH {_sheet} SELECT s.source, s.pos, s.b AS org_name, s.c AS report_status, s.d AS cash_receipts"
    " FROM sheet s JOIN found f ON f.source = s.source AND f.accepted AND s.pos > f.at"
)
ORACLES["canonical_frame_uneven"] = """SELECT
  CASE WHEN c_custkey % 2 = 0 THEN 'all' ELSE 'file ' || c_custkey END AS source, c_custkey + 10 AS pos,
  c_name AS org_name, 'Отчет принят' AS report_status, CAST(c_acctbal AS VARCHAR) AS cash_receipts
FROM customer WHERE c_custkey % 10 <> 9"""
ORACLES["latest_snapshot"] = """WITH t AS (SELECT n_name AS source, max(o_orderdate) AS modified
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1),
newest AS (SELECT source FROM t ORDER BY modified DESC, source LIMIT 1)
SELECT source, c_custkey AS org_id, c_name AS org_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN newest ON source = n_name"""

_layout_rows = ", ".join(
    f"({i}, {j}, {lit(h)})" for i, layout in enumerate(LAYOUTS) for j, h in enumerate(layout)
)
_pattern_rows = ", ".join(
    f"({i}, {lit(c.name)}, {lit(c.label)}, {j}, {lit(p)})"
    for i, c in enumerate(REPORT_COLUMNS)
    for j, p in enumerate(c.patterns)
)
_resolution = f"""WITH h0(layout, pos, raw) AS (VALUES {_layout_rows}),
h1 AS (SELECT *, row_number() OVER (PARTITION BY layout, raw ORDER BY pos) - 1 AS earlier FROM h0),
h2 AS (SELECT layout, pos, CASE WHEN earlier > 0 THEN raw || '.' || earlier ELSE raw END AS raw FROM h1),
h AS (SELECT *, trim(regexp_replace(raw, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS normal,
  translate(trim(raw), chr(10) || chr(13), '  ') AS shown FROM h2),
p(no, canonical, label, pattern_no, pattern) AS (VALUES {_pattern_rows}),
hits AS (
  SELECT layout, canonical, shown, 1 AS pass, pattern_no, -pos AS pos FROM h JOIN p ON normal = pattern
  UNION ALL SELECT layout, canonical, shown, 2, pattern_no, pos FROM h JOIN p ON regexp_matches(normal, pattern, 'i')),
best AS (SELECT *, row_number() OVER (PARTITION BY layout, canonical ORDER BY pass, pattern_no, pos) AS rn FROM hits),
names AS (SELECT DISTINCT canonical, label FROM p),
res AS (SELECT c_custkey::VARCHAR AS source, n.canonical, n.label, b.shown AS original, b.shown IS NOT NULL AS found
  FROM customer CROSS JOIN names n
  LEFT JOIN best b ON b.layout = c_custkey % {len(LAYOUTS)} AND b.canonical = n.canonical AND b.rn = 1)
"""
ORACLES["resolution_report"] = _resolution + "SELECT * FROM res"
ORACLES["resolution_many_layouts"] = ORACLES["resolution_report"]  # a further header changes no column
ORACLES["unresolved_columns"] = _resolution + "SELECT source, canonical, label FROM res WHERE NOT found"

# ---- cleaning ---------------------------------------------------------------------------------

_number_cases = " ".join(
    f"WHEN {i} THEN {lit(t)}"
    for i, t in enumerate(("(500)", "-", "—", "", "нет данных", "12.05.2024", "5-3"), start=2)
)
_answer_cases = " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(YES_NO_ANSWERS) if t is not None)
_dirty = f"""WITH a AS (SELECT *, format('{{:,.2f}}', c_acctbal) AS amount FROM customer),
dirty AS (SELECT c_custkey AS org_id,
  CASE c_custkey % 10 WHEN 0 THEN translate(amount, ',.', chr(160) || ',') WHEN 1 THEN replace(amount, ',', '') || ' руб.' {_number_cases} END AS amount_text,
  CASE c_custkey % 8 {_answer_cases} END AS answer_text,
  CASE c_custkey % 6 WHEN 0 THEN 'Не  указано' WHEN 1 THEN chr(160) || '—'
    ELSE ' ' || chr(160) || ' ' || c_name || chr(10) || ' ' || chr(9) || c_mktsegment || ' ' END AS free_text,
  c_acctbal AS balance FROM a)
"""
_to_number = "TRY_CAST(regexp_replace(replace(amount_text, ',', '.'), '[^0-9.\\-]', '', 'g') AS DOUBLE)"
ORACLES["clean_text"] = _dirty + f"SELECT org_id, {clean('free_text')} AS text FROM dirty"
ORACLES["yes_flag"] = _dirty + f"SELECT org_id, {yes('answer_text')} AS flag FROM dirty"
ORACLES["to_number"] = _dirty + f"SELECT org_id, {_to_number} AS amount FROM dirty"
ORACLES["clean_frame"] = (
    _dirty
    + f"SELECT org_id, {_to_number} AS amount_text, answer_text, {clean('free_text')} AS free_text, balance, {yes('answer_text')} AS answer_text__flag FROM dirty"
)
ORACLES["form_name"] = RAW + f"SELECT org_id, CAST(org_id % 6 AS INTEGER) AS level, {form('(org_id % 6)')} AS name FROM rep"
ORACLES["org_type_class"] = (
    RAW
    + "SELECT org_id, CASE WHEN trim(org_type) IN ('Высшее образование', 'Научные учреждения') THEN trim(org_type) ELSE 'Другие' END AS org_class FROM rep"
)


def _class(c: str, *rules: tuple[str, str]) -> str:
    text = clean(c)
    cases = " ".join(f"WHEN {cond.replace('@', f'lower({text})')} THEN {lit(name)}" for cond, name in rules)
    return f"CASE WHEN ({text}) IS NULL THEN 'Не указано' {cases} ELSE {text} END"


RISK_CLASS = _class(
    "risk_methodology",
    ("@ LIKE '%отсутств%' OR @ LIKE '%не применяется%'", "Методика отсутствует"),
    ("@ LIKE '%фрагментар%' OR @ LIKE '%несистем%'", "Фрагментарная / несистемная"),
    (
        "@ LIKE '%утвержден%' OR @ LIKE '%карты рисков%' OR (@ LIKE '%риск%' AND @ LIKE '%план%')",
        "Полноценная методика",
    ),
)
REVIEW_CLASS = _class(
    "effectiveness_review",
    ("@ LIKE '%не проводится%'", "Оценка не проводится"),
    ("@ LIKE '%нерегуляр%' OR @ LIKE '%не оформ%'", "Нерегулярная / без оформления"),
    ("@ LIKE '%регуляр%' OR @ LIKE '%не реже%'", "Регулярная оценка"),
)
IMPROVE_CLASS = _class(
    "improvement_actions",
    ("@ LIKE '%не планируются%' OR @ LIKE '%не проводятся%'", "Не планируются / не проводятся"),
    ("@ LIKE '%не в полном объеме%' OR @ LIKE '%планируются%'", "Планируются / частично выполняются"),
    (
        "@ LIKE '%разрабатываются%' OR @ LIKE '%реализуются%' OR @ LIKE '%документирован%'",
        "Документированные мероприятия реализуются",
    ),
)
ORACLES["answer_classes"] = (
    RAW
    + f"SELECT org_id, {RISK_CLASS} AS risk_class, {REVIEW_CLASS} AS effectiveness_class, {IMPROVE_CLASS} AS improvement_class FROM rep"
)
ORACLES["filled_flag"] = (
    RAW
    + f"SELECT org_id, NOT coalesce(contains(lower({clean('report_status')}), 'не заполн'), false) AS filled FROM rep"
)


def _label(c: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in DISPLAY_LABELS.items())
    out = f"CASE {c} {cases} ELSE {c} END"
    for old, new in TEXT_REPLACEMENTS.items():
        out = f"replace({out}, {lit(old)}, {lit(new)})"
    return f"{out} AS {c}"


scored(
    "relabelled",
    "SELECT org_id, " + ", ".join(_label(c) for c in ("risk_group", "svk_form_name", "data_quality_flags")) + " FROM enr",
)
ORACLES["axis_log"] = (
    RAW
    + "SELECT org_id, "
    + ", ".join(f"round(ln(1 + {a}), 8) AS {a}_ln1p, round(CASE WHEN {a} > 0 THEN log10({a}) END, 8) AS {a}_lg" for a in AXES)
    + " FROM rep"
)

# ---- filters and extracts ---------------------------------------------------------------------

scored(
    "filter_dims",
    "SELECT org_id, federal_district, region, org_type_classified, risk_group FROM enr"
    " WHERE federal_district IN ('ASIA', 'EUROPE') AND org_type_classified IN ('Другие', 'Научные учреждения')",
)
scored(
    "filter_options",
    " UNION ".join(
        f"SELECT {lit(c)} AS dimension, {c} AS value FROM enr WHERE {c} IS NOT NULL"
        for c in ("federal_district", "region", "org_type_classified", "risk_group")
    ),
)
scored("contradictions", "SELECT org_name, federal_district, region, contradictions FROM enr WHERE contradictions <> ''")
scored("anomalies", "SELECT org_name, federal_district, region, anomalies FROM enr WHERE anomalies <> ''")
scored(
    "quality_issues",
    "SELECT org_name, org_type, federal_district, region, report_status, data_quality_flags FROM enr WHERE data_quality_flags <> ''",
)
scored(
    "form_scatter",
    f"SELECT org_name, svk_form_level, recommended_form_level, max_direction_load_level, {r('coverage_share_active', 8)}, risk_group FROM enr",
)
scored(
    "peer_scatter",
    "SELECT org_name, svk_form_level, peer_form_median, form_vs_peer, peer_group_size, peer_group_level, risk_group FROM enr",
)

# ---- scoring ----------------------------------------------------------------------------------

scored(
    "load_percentile",
    " UNION ALL ".join(f"SELECT org_id, {lit(m)} AS name, round({m}_p, 10) AS pct FROM enr WHERE {m} > 0" for m in METRICS),
)
scored("load_level", "SELECT org_id, " + ", ".join(f"{level(m + '_p')} AS {m}_level" for m in METRICS) + " FROM enr")
scored(
    "direction_load",
    "SELECT org_id, "
    + ", ".join(
        f"{k}_active, {k}_covered, {r(k + '_load_score', 10)}, {k}_load_level, {k}_uncovered, {k}_uncovered_load" for k in KEYS
    )
    + " FROM enr",
)
scored(
    "coverage",
    f"SELECT org_id, active_directions_count, covered_active_directions_count, {r('coverage_share_active', 8)},"
    " uncovered_active_directions_count, uncovered_load_sum, max_uncovered_load, max_direction_load_level FROM enr",
)
scored(
    "form_level",
    "SELECT org_id, " + ", ".join(f"{f.column}__yes" for f in CONFIG.forms) + ", svk_form_level, svk_form_name FROM enr",
)
scored("recommended_form", "SELECT org_id, recommended_form_level, recommended_form_name, form_gap FROM enr")
scored(
    "peer_benchmark",
    "SELECT org_id, load_profile, peer_group_key, peer_group_level, peer_group_size, peer_form_median,"
    f" {r('peer_coverage_median', 8)}, form_vs_peer FROM enr",
)
scored("risk_group", "SELECT org_id, risk_group FROM enr")
_round8 = {"coverage_share_active", "peer_coverage_median", *[f"{k}_load_score" for k in KEYS]}
scored("enrich", "SELECT " + ", ".join(r(c, 8) if c in _round8 else c for c in ENRICHED_COLUMNS) + " FROM enr")

# ---- rule flags -------------------------------------------------------------------------------

for _name, _text in (
    ("flag_contradictions", CONTRADICTIONS),
    ("flag_ceiling", texts(*CEILINGS)),
    ("flag_copypaste", texts(COPY_PASTE)),
    ("flag_zero_large", texts(*ZERO_LARGE)),
    ("flag_ratio", texts(RATIO)),
):
    ORACLES[_name] = RAW + f"SELECT * FROM (SELECT org_id, {_text} AS text FROM rep) WHERE text <> ''"
scored("flag_quality", "SELECT org_id, data_quality_flags AS text FROM enr WHERE data_quality_flags <> ''")

# ---- summaries --------------------------------------------------------------------------------

_n = "(SELECT count(*) FROM enr)"
_f = "(SELECT count(*) FROM fil)"
scored(
    "report_status",
    f"SELECT coalesce({clean('report_status')}, 'Не указано') AS status, count(*) AS orgs, round({share('count(*)', _n)}, 6) AS percent FROM enr GROUP BY 1",
)
scored(
    "elements",
    " UNION ALL ".join(
        f"SELECT {lit(k)} AS element_key, {lit(v)} AS element, count(*) FILTER (WHERE {yes(k)} = 1) AS yes_orgs,"
        f" count(*) FILTER (WHERE {yes(k)} = 0) AS no_orgs, count(*) FILTER (WHERE ({yes(k)}) IS NULL) AS missing_orgs,"
        f" count(*) AS filled_reports, round({share(f'count(*) FILTER (WHERE {yes(k)} = 1)', 'count(*)')}, 6) AS yes_rate_pct FROM fil"
        for k, v in ELEMENT_LABELS.items()
    ),
)
_package = " AND ".join(f"{yes0(c)} = 1" for c in BASIC_ELEMENTS)
scored(
    "basic_package",
    "SELECT 'Организаций с полным базовым комплектом СВК' AS metric,"
    f" count(*) FILTER (WHERE {_package}) AS value, count(*) AS denominator,"
    f" round({share(f'count(*) FILTER (WHERE {_package})', 'count(*)')}, 6) AS percent,"
    f" {lit(', '.join(BASIC_ELEMENTS))} AS included_elements FROM fil",
)
scored(
    "form_flags",
    " UNION ALL ".join(
        f"SELECT {lit(f.column)} AS form_key, {lit(f.name)} AS form, {f.level} AS level,"
        f" count(*) FILTER (WHERE {f.column}__yes = 1) AS yes_orgs, count(*) AS filled_reports,"
        f" round({share(f'count(*) FILTER (WHERE {f.column}__yes = 1)', 'count(*)')}, 6) AS percent_filled FROM fil"
        for f in CONFIG.forms
    ),
)
scored(
    "form_levels",
    f"SELECT svk_form_level, svk_form_name, count(*) AS orgs, round({share('count(*)', _f)}, 6) AS percent_filled FROM fil GROUP BY 1, 2",
)
_sums = ", ".join(f"sum({num(m)}) AS {m}" for m in MEASURES)
_rates = (
    "round(violations_total / orgs, 6) AS violations_per_org,"
    f" round({share('cancelled_decisions', 'disciplinary_decisions')}, 6) AS cancelled_decisions_rate_pct,"
    f" round({share('returned_refused', 'materials_law_enforcement')}, 6) AS returned_refused_rate_pct,"
    f" round({share('refused_satisfaction', 'materials_court')}, 6) AS refused_satisfaction_rate_pct"
)
scored(
    "form_activity",
    f"SELECT *, round({share('orgs', _f)}, 6) AS percent_filled, {_rates} FROM (SELECT svk_form_level, svk_form_name, count(*) AS orgs, {_sums} FROM fil GROUP BY 1, 2)",
)
for _name, _class_sql in (("risk_methodology", RISK_CLASS), ("effectiveness", REVIEW_CLASS), ("improvement", IMPROVE_CLASS)):
    scored(
        _name,
        f"SELECT {_class_sql} AS category, count(*) AS orgs, round({share('count(*)', _f)}, 6) AS percent_filled FROM fil GROUP BY 1",
    )
_viol = f""", v AS (SELECT sum({num('violations_total')}) AS total, sum({num('violations_fixed_on_time')}) AS on_time,
  sum({num('violations_fixed_late')}) AS late, sum(greatest({num('violations_total')} - {_fixed}, 0)) AS unresolved,
  sum({num('remediation_plans')}) AS plans, sum({num('lna_changes')}) AS lna, sum({num('disciplinary_decisions')}) AS disc,
  sum({num('materials_law_enforcement')}) AS law, sum({num('materials_court')}) AS court,
  sum({num('cancelled_decisions')}) AS cancelled, sum({num('returned_refused')}) AS returned, sum({num('refused_satisfaction')}) AS refused,
  count(*) FILTER (WHERE {num('violations_total')} > 0 AND {_fixed} > {num('violations_total')})::DOUBLE AS impossible FROM fil)
"""
_viol_rows = (
    ("Выявленные нарушения", "total"),
    ("Устранено в срок", "on_time"),
    ("Устранено с нарушением срока", "late"),
    ("Остаток без отраженного устранения", "unresolved"),
    ("Планы устранения нарушений", "plans"),
    ("Решения по внесению изменений в ЛНА", "lna"),
    ("Решения о дисциплинарной ответственности", "disc"),
    ("Материалы в правоохранительные / контрольные органы", "law"),
    ("Материалы в суд", "court"),
)
scored(
    "violations",
    _viol
    + " UNION ALL ".join(
        f"SELECT {lit(t)} AS metric, {c} AS value, round({c} / nullif(total, 0), 6) AS share_of_violations, round({c} / nullif(total, 0) * 100, 6) AS per_100_violations FROM v"
        for t, c in _viol_rows
    )
    + " UNION ALL SELECT 'Строк с арифметическим противоречием: устранено больше выявлено', impossible, NULL, NULL FROM v",
)
for _name, _rows in (("remediation", _viol_rows[:4]), ("management", _viol_rows[4:6])):
    scored(
        _name,
        _viol
        + " UNION ALL ".join(
            f"SELECT {lit(t)} AS metric, {c} AS value, round({share(c, 'total')}, 6) AS percent_of_violations FROM v" for t, c in _rows
        ),
    )
scored(
    "legal",
    _viol
    + " UNION ALL ".join(
        f"SELECT {lit(t)} AS metric, {c} AS value, {c if w else 'NULL::DOUBLE'} AS cancelled_returned_refused,"
        f" {f'round({share(c, w)}, 6)' if w else 'NULL::DOUBLE'} AS cancellation_rate_pct FROM v"
        for t, c, w in (
            ("Дисциплинарная ответственность: решений принято", "disc", None),
            ("  → из них отменены в порядке обжалования", "cancelled", "disc"),
            ("Материалы в правоохранительные органы: направлено", "law", None),
            ("  → из них возвращены, получен отказ", "returned", "law"),
            ("Материалы в суд: направлено", "court", None),
            ("  → из них отказано в удовлетворении", "refused", "court"),
        )
    ),
)
_norm = f""", v AS (SELECT sum({num('violations_total')}) AS bad, sum(staff_avg) AS staff, sum(CAST(cash_payments AS DECIMAL(18,2)))::DOUBLE AS paid,
  sum(fkhz_count) AS facts, sum(procurement_count) AS buys, sum(CAST(procurement_amount AS DECIMAL(18,2)))::DOUBLE AS spent FROM fil)
"""
scored(
    "normalized",
    _norm
    + " UNION ALL ".join(
        f"SELECT {lit(m)} AS metric, round({v}, 2) AS value, {lit(u)} AS unit FROM v"
        for m, v, u in (
            ("Среднесписочная численность, всего", "staff", "чел."),
            ("Кассовые выплаты, всего", "paid", "руб."),
            ("Кассовые выплаты, всего", "paid / 1e9", "млрд руб."),
            ("Нарушений на 100 среднесписочных сотрудников", "bad / nullif(staff, 0) * 100", "ед."),
            ("Нарушений на 1 млрд руб. кассовых выплат", "bad / nullif(paid / 1e9, 0)", "ед."),
            ("Нарушений на 1 000 фактов хозяйственной жизни", "bad / nullif(facts, 0) * 1000", "ед."),
            ("Закупок на 100 сотрудников", "buys / nullif(staff, 0) * 100", "ед."),
            ("Совокупный объем закупок", "spent", "руб."),
            ("Совокупный объем закупок", "spent / 1e9", "млрд руб."),
            ("Доля объема закупок в кассовых выплатах", "spent / nullif(paid, 0) * 100", "%"),
        )
    ),
)
_over_cte = f""", v AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_report_filled) AS filled,
  count(*) FILTER (WHERE is_report_filled AND {yes0('svk_organized')} = 1) AS organised,
  count(*) FILTER (WHERE is_report_filled AND {_package}) AS package,
  count(*) FILTER (WHERE is_report_filled AND {RISK_CLASS} = 'Полноценная методика') AS risk,
  count(*) FILTER (WHERE is_report_filled AND {REVIEW_CLASS} = 'Регулярная оценка') AS review,
  sum({num('violations_total')}) FILTER (WHERE is_report_filled) AS bad,
  sum({num('violations_fixed_on_time')}) FILTER (WHERE is_report_filled) AS fixed,
  avg(coverage_share_active) AS coverage, count(*) FILTER (WHERE uncovered_active_directions_count > 0) AS uncovered,
  count(*) FILTER (WHERE form_gap < 0) AS weak, count(*) FILTER (WHERE risk_group LIKE 'D.%') AS double_risk,
  count(*) FILTER (WHERE data_quality_flags <> '') AS flagged FROM enr)
"""
_over_rows = (
    ("Организаций в отчете", "n"),
    ("Заполненных отчетов", "filled"),
    ("% заполненных отчетов", share("filled", "n")),
    ("Организаций, где СВК организован", "organised"),
    ("% организаций, где СВК организован", share("organised", "filled")),
    ("Организаций с полным базовым комплектом СВК", "package"),
    ("% организаций с полным базовым комплектом СВК", share("package", "filled")),
    ("Организаций с полноценной методикой оценки рисков", "risk"),
    ("% организаций с полноценной методикой оценки рисков", share("risk", "filled")),
    ("Организаций с регулярной оценкой эффективности СВК", "review"),
    ("% организаций с регулярной оценкой эффективности СВК", share("review", "filled")),
    ("Выявленные нарушения", "bad"),
    ("% нарушений, устраненных в срок", share("fixed", "bad")),
    ("Среднее покрытие активных направлений, %", "coverage * 100"),
    ("Организаций с непокрытыми активными направлениями", "uncovered"),
    ("Организаций со слабой формой СВК", "weak"),
    ("Организаций с двойным риском", "double_risk"),
    ("Организаций с флагами качества данных", "flagged"),
)
scored(
    "overview",
    _over_cte + " UNION ALL ".join(f"SELECT {lit(m)} AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM v" for m, v in _over_rows),
)
scored("overview_metric", _over_cte + f"SELECT round({share('filled', 'n')}, 6) AS value FROM v")
scored(
    "overview_extra",
    _over_cte
    + "SELECT n AS total_organizations, round(coverage * 100, 6) AS avg_coverage, uncovered AS uncovered_count, weak AS weak_form_count, double_risk AS double_risk_count FROM v",
)


def _direction(k: str, name: str) -> str:
    a, c, h = f"{k}_active = 1", f"{k}_covered = 1", f"{k}_load_level >= 3"
    return (
        f"SELECT {lit(k)} AS direction_key, {lit(name)} AS direction, count(*) FILTER (WHERE {a}) AS active_orgs,"
        f" count(*) FILTER (WHERE {a} AND {c}) AS covered_orgs, count(*) FILTER (WHERE {a} AND NOT {c}) AS uncovered_orgs,"
        f" round({share(f'count(*) FILTER (WHERE {a} AND {c})', f'count(*) FILTER (WHERE {a})')}, 6) AS coverage_pct_active,"
        f" count(*) FILTER (WHERE {h}) AS high_load_orgs, count(*) FILTER (WHERE {h} AND {a} AND NOT {c}) AS high_load_uncovered_orgs,"
        f" round(avg({k}_load_level), 6) AS avg_load_level FROM enr"
    )


_directions = " UNION ALL ".join(_direction(d.key, d.name) for d in CONFIG.directions)
scored("directions", _directions)
scored(
    "directions_long",
    f", d AS ({_directions}) SELECT direction, 'covered_orgs' AS status, covered_orgs AS orgs FROM d UNION ALL SELECT direction, 'uncovered_orgs', uncovered_orgs FROM d",
)
scored("risk_groups", f"SELECT risk_group, count(*) AS orgs, round({share('count(*)', _n)}, 6) AS percent FROM enr GROUP BY 1")
for _name, _dim in (("by_district", "federal_district"), ("by_org_type", "org_type")):
    scored(
        _name,
        f"SELECT {_dim}, count(org_name) AS orgs, round(avg(coverage_share_active), 6) AS avg_coverage, round(avg(form_gap), 6) + 0.0::DOUBLE AS avg_form_gap,"
        " count(*) FILTER (WHERE risk_group LIKE 'D.%') AS double_risk_orgs, count(*) FILTER (WHERE form_gap < 0) AS weak_form_orgs,"
        " count(*) FILTER (WHERE uncovered_active_directions_count > 0) AS uncovered_orgs FROM enr GROUP BY 1",
    )
scored("gap_dist", "SELECT form_gap, count(*) AS orgs FROM enr GROUP BY 1")
scored("peer_dist", "SELECT form_vs_peer, count(*) AS orgs FROM enr GROUP BY 1")
scored(
    "top_risk",
    "SELECT org_id, org_name, org_type, federal_district, region, risk_group, round(coverage_share_active, 8) AS coverage_share_active,"
    " uncovered_load_sum, max_uncovered_load, svk_form_name, recommended_form_name, form_gap, peer_form_median, form_vs_peer, peer_group_size, "
    + ", ".join(f"{k}_load_level" for k in KEYS)
    + ", "
    + ", ".join(f"{k}_covered" for k in KEYS)
    + ", data_quality_flags FROM enr ORDER BY uncovered_load_sum * 10 + max_uncovered_load * 5 + greatest(-form_gap, 0) * 3"
    " + CAST(data_quality_flags <> '' AS INTEGER) DESC, org_id LIMIT 50",
)

# ---- proportionality --------------------------------------------------------------------------

_axis_ranks = ", ".join(f"{rank_pct(a)} AS {a}_r" for a in AXES)
_logs = ", ".join(f"CASE WHEN cash_receipts + staff_avg + fkhz_count <> 0 THEN ln(1 + {a}) END AS l{i}" for i, a in enumerate(AXES))
_det = "(c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02))"
_inv = {
    "00": "(c11 * c22 - c12 * c12)",
    "11": "(c00 * c22 - c02 * c02)",
    "22": "(c00 * c11 - c01 * c01)",
    "01": "(c02 * c12 - c01 * c22)",
    "02": "(c01 * c12 - c02 * c11)",
    "12": "(c01 * c02 - c00 * c12)",
}
_quad = " + ".join(
    f"(l{k[0]} - m{k[0]}) * (l{k[1]} - m{k[1]}) * {v} / det * {1 if k[0] == k[1] else 2}" for k, v in _inv.items()
)


def _z(n: str) -> str:
    return f"(ln({n}) - {n}_med) / (1.4826 * {n}_mad)"


_ratio_cols = ", ".join(f"CASE WHEN {a} > 0 THEN {a} / nullif({b}, 0) END AS {n}" for n, a, b, _ in AXIS_RATIOS)
_meds = ", ".join(f"median(ln({n})) AS {n}_med" for n, _, _, _ in AXIS_RATIOS)
_mads = ", ".join(f"median(abs(ln({n}) - {n}_med)) AS {n}_mad" for n, _, _, _ in AXIS_RATIOS)
_zs = ", ".join(f"{_z(n)} AS {n}_x" for n, _, _, _ in AXIS_RATIOS)
_reasons = texts(
    when("scale_outlier", "'Нетипичное сочетание объёмов (многомерный выброс)'"),
    *[
        f"CASE WHEN {n}_x > 3.5 THEN 'Аномально высокое: {w}' WHEN {n}_x < -3.5 THEN 'Аномально низкое: {w}' END"
        for n, _, _, w in AXIS_RATIOS
    ],
    "CASE WHEN scale_level >= 3 AND svk_form_level <= 1 THEN 'Крупный масштаб при слабой форме СВК'"
    " WHEN scale_level <= 1 AND svk_form_level >= 4 THEN 'Развитая форма СВК при малом масштабе' END",
)
PROPORTION = f""", p1 AS (SELECT *, {_axis_ranks}, {_ratio_cols}, {_logs} FROM fil),
p2 AS (SELECT *, (cash_receipts_r + staff_avg_r + fkhz_count_r) / 3 AS score FROM p1),
p3 AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS score_rank FROM p2),
cv AS (SELECT *, {_det} AS det FROM (SELECT avg(l0) AS m0, avg(l1) AS m1, avg(l2) AS m2, covar_samp(l0, l0) AS c00, covar_samp(l0, l1) AS c01,
  covar_samp(l0, l2) AS c02, covar_samp(l1, l1) AS c11, covar_samp(l1, l2) AS c12, covar_samp(l2, l2) AS c22 FROM p1)),
md AS (SELECT {_meds} FROM p1),
mad AS (SELECT {_mads} FROM p1, md),
p4 AS (SELECT p3.*, {level('score_rank')} AS scale_level, {_quad} AS distance_sq, {_zs} FROM p3, cv, md, mad),
p5 AS (SELECT *, coalesce(distance_sq > 11.345, false) AS scale_outlier FROM p4),
prop AS (SELECT *, scale_level - svk_form_level AS scale_vs_form, {_reasons} AS anomaly_reasons,
  round_even(coalesce(sqrt(distance_sq), 0) + coalesce(greatest({', '.join(f'abs({n}_x)' for n, _, _, _ in AXIS_RATIOS)}), 0)
    + abs(scale_level - svk_form_level), 2) AS anomaly_score FROM p5)
"""
scored("scale_level", PROPORTION + f"SELECT org_id, {r('score', 8, 'scale_score')}, scale_level FROM prop")
scored("mahalanobis", PROPORTION + f"SELECT org_id, {r('distance_sq', 5)}, scale_outlier AS outlier FROM prop")
scored(
    "robust_z",
    PROPORTION + "SELECT org_id, " + ", ".join(f"round({n}_x, 6) + 0.0::DOUBLE AS {n}_z" for n, _, _, _ in AXIS_RATIOS) + " FROM prop",
)
scored("unit_ratios", PROPORTION + "SELECT org_id, " + ", ".join(n for n, _, _, _ in AXIS_RATIOS) + " FROM prop")
scored(
    "proportionality_all",
    PROPORTION
    + "SELECT org_id, org_name, org_type, org_type_classified, federal_district, region, cash_receipts, staff_avg, fkhz_count, "
    + ", ".join(f"round_even({a}_r * 100, 1) AS {a}_pct" for a in AXES)
    + ", round_even(score, 3) AS scale_score, scale_level, svk_form_level, svk_form_name, round_even(sqrt(distance_sq), 2) AS mahalanobis, scale_outlier, "
    + ", ".join(f"{n}, round_even({n}_x, 2) + 0.0::DOUBLE AS {n}_z" for n, _, _, _ in AXIS_RATIOS)
    + ", scale_vs_form, anomaly_reasons, anomaly_reasons <> '' AS is_anomaly, anomaly_score FROM prop",
)
scored(
    "proportionality_flagged",
    PROPORTION
    + "SELECT org_id, org_name, org_type_classified, federal_district, region, cash_receipts, staff_avg, fkhz_count, scale_level, svk_form_name,"
    " scale_vs_form, round_even(sqrt(distance_sq), 2) AS mahalanobis, anomaly_score, anomaly_reasons FROM prop WHERE anomaly_reasons <> ''",
)


def _limits(shares: dict[str, float], source: str, name: str) -> str:
    return f"{name} AS (SELECT {', '.join(f'quantile_cont({a}, {q}) AS {a}_q' for a, q in shares.items())} FROM {source})"


_hi = {a: 0.995 for a in AXES}
_ext_reason = texts(
    *[
        when(
            f"{a} > q.{a}_q",
            f"{lit(AXIS_LABELS[a] + ': ')} || format('{{:,.0f}}', {a}) || ' (×' || format('{{:.1f}}', {a} / q.{a}_q) || ' от порога)'",
        )
        for a in AXES
    ]
)
_any_over = " OR ".join(f"{a} > q.{a}_q" for a in AXES)
scored(
    "extremes",
    PROPORTION
    + f", {_limits(_hi, 'prop', 'q')} SELECT org_id, cash_receipts, staff_avg, fkhz_count, anomaly_score, {_ext_reason} AS extreme_reason FROM prop, q WHERE {_any_over}",
)
scored(
    "extremes_kept",
    PROPORTION
    + f", {_limits({'cash_receipts': 0.99, 'staff_avg': 0.9, 'fkhz_count': 0.995}, 'prop', 'q')} SELECT org_id FROM prop, q WHERE NOT ({_any_over})",
)
TRIM = f", {_limits(_hi, 'enr', 'q')}, {_limits({a: 0.005 for a in AXES}, 'enr', 'lo')}"
_outside = " OR ".join(f"{a} < lo.{a}_q OR {a} > q.{a}_q" for a in AXES)
_trim_reason = texts(
    *[
        f"CASE WHEN {a} < lo.{a}_q THEN {lit(AXIS_LABELS[a] + ': ')} || format('{{:,.0f}}', {a}) || ' (ниже p0.5%, порог ' || format('{{:,.0f}}', lo.{a}_q) || ')'"
        f" WHEN {a} > q.{a}_q THEN {lit(AXIS_LABELS[a] + ': ')} || format('{{:,.0f}}', {a}) || ' (выше p99.5%, порог ' || format('{{:,.0f}}', q.{a}_q) || ')' END"
        for a in AXES
    ]
)
scored(
    "trimmed",
    TRIM + f" SELECT org_id, cash_receipts, staff_avg, fkhz_count, {_trim_reason} AS profile_trim_reason FROM enr, q, lo WHERE {_outside}",
)

# ---- nearest peers ----------------------------------------------------------------------------


def _med(c: str) -> str:
    return f"median({c})"


PEERS = """, pt AS (SELECT *, ln(1 + greatest(cash_receipts, 0)) AS x, ln(1 + greatest(staff_avg, 0)) AS y, ln(1 + greatest(fkhz_count, 0)) AS z FROM fil),
pr AS (SELECT a.org_id, b.org_id AS nid, b.org_name AS nname, b.svk_form_level AS nform, b.x AS nx, b.y AS ny, b.z AS nz,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
  FROM pt a JOIN pt b ON a.org_id <> b.org_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY dist, nid) AS rn FROM pr) WHERE rn <= 5),
ag AS (SELECT org_id, CAST(round_even(median(nform), 0) AS INTEGER) AS med, median(nx) AS mx, median(ny) AS my, median(nz) AS mz, count(*) AS size,
  round_even(avg(dist), 4) AS mean_dist, string_agg(nname, '; ' ORDER BY rn) AS names FROM nn GROUP BY org_id),
cp1 AS (SELECT pt.*, ag.* EXCLUDE (org_id), svk_form_level - med AS dev, abs(x - mx) AS sx, abs(y - my) AS sy, abs(z - mz) AS sz FROM pt JOIN ag ON ag.org_id = pt.org_id),
cp AS (SELECT *, round_even(1 - (rank() OVER (ORDER BY mean_dist) + (count(*) OVER (PARTITION BY mean_dist) - 1) / 2.0::DOUBLE) / count(*) OVER (), 2) AS conf,
  CASE WHEN sx >= sy AND sx >= sz THEN 'cash_receipts' WHEN sy >= sz THEN 'staff_avg' ELSE 'fkhz_count' END AS axis FROM cp1)
"""
_peer_tail = (
    "med AS peer_3d_form_median, dev AS form_vs_peer_3d, {rest}round_even(greatest(sx, sy, sz), 3) AS profile_skew_3d, axis AS profile_skew_3d_axis,"
    " CAST(size AS INTEGER) AS peer_3d_group_size, mean_dist AS peer_3d_mean_distance"
)
scored(
    "cloud_peers",
    PEERS
    + "SELECT org_id, org_name, org_type, org_type_classified, federal_district, region, cash_receipts, staff_avg, fkhz_count, svk_form_level, svk_form_name, form_vs_peer, "
    + _peer_tail.format(rest="")
    + ", names AS peer_3d_neighbors, conf AS peer_3d_confidence FROM cp",
)
scored(
    "cloud_priority",
    PEERS
    + "SELECT org_id, org_name, org_type_classified, federal_district, region, cash_receipts, staff_avg, fkhz_count, svk_form_level, svk_form_name, "
    + _peer_tail.format(rest="form_vs_peer, ")
    + ", conf AS peer_3d_confidence FROM cp WHERE dev <= -1 AND conf >= 0.5",
)
scored(
    "cloud_overview",
    PEERS
    + "SELECT count(*) AS orgs, count(*) FILTER (WHERE dev <= -1 AND conf >= 0.5) AS below_peers, round(avg(conf), 6) AS avg_confidence FROM cp",
)
scored(
    "cloud_form_scatter",
    PEERS
    + "SELECT org_id, org_name, med AS peer_3d_form_median, svk_form_level, dev AS form_vs_peer_3d, conf AS peer_3d_confidence FROM cp",
)
scored(
    "peers_kept",
    PEERS
    + f", {_limits(_hi, 'fil', 'q')} SELECT org_id, dev AS form_vs_peer_3d, conf AS peer_3d_confidence FROM cp, q WHERE NOT ({_any_over})",
)
scored(
    "neighbors_of",
    PEERS
    + "SELECT rn AS rank, nid AS id, nname AS name, round(dist, 8) AS dist FROM nn WHERE org_id = (SELECT min(org_id) FROM pt)",
)
scored(
    "neighbor_tags",
    PEERS
    + ", me AS (SELECT min(org_id) AS id FROM pt) SELECT org_id, org_name, round(x, 8) AS log_cash, round(y, 8) AS log_staff, round(z, 8) AS log_fkhz,"
    " CASE WHEN org_id = (SELECT id FROM me) THEN 'Выбранная организация'"
    " WHEN org_id IN (SELECT nid FROM nn WHERE org_id = (SELECT id FROM me)) THEN 'Соседи' ELSE 'Прочие' END AS tag FROM cp",
)

# ---- scale profile ----------------------------------------------------------------------------

_BINS = CONFIG.n_bins
_pos = " + ".join(f"(ln(1 + {a}) - m{i}) / s{i} * g{i}" for i, a in enumerate(AXES))
_edges = "lo + (hi - lo) * j / " + f"{_BINS}.0::DOUBLE"
_short = "CASE WHEN abs(@) >= 1 THEN round_even(@, 3) ELSE round_even(@, CAST(2 - floor(log10(abs(@))) AS INTEGER)) END"
# The leading eigenvalue of a 3x3 correlation matrix is 1 plus the largest root of
# t^3 - (a^2 + b^2 + c^2) t - 2abc = 0; its eigenvector is a cross product of two rows.
SCALE = (
    TRIM
    + f""", kept AS (SELECT enr.* FROM enr, q, lo WHERE NOT ({_outside}) AND is_report_filled),
act AS (SELECT * FROM kept WHERE cash_receipts > 0 AND staff_avg > 0 AND fkhz_count > 0),
st AS (SELECT {', '.join(f'avg(ln(1 + {a})) AS m{i}, stddev_samp(ln(1 + {a})) AS s{i}' for i, a in enumerate(AXES))},
  corr(ln(1 + {AXES[0]}), ln(1 + {AXES[1]})) AS a, corr(ln(1 + {AXES[0]}), ln(1 + {AXES[2]})) AS b, corr(ln(1 + {AXES[1]}), ln(1 + {AXES[2]})) AS c FROM act),
ev AS (SELECT *, 2 * sqrt((a*a + b*b + c*c) / 3) * cos(acos(a * b * c / pow((a*a + b*b + c*c) / 3, 1.5)) / 3) AS t FROM st),
vc AS (SELECT *, a * c + t * b AS v0, a * b + t * c AS v1, t * t - a * a AS v2 FROM ev),
ax AS (SELECT *, {', '.join(f'v{i} / sqrt(v0*v0 + v1*v1 + v2*v2) * sign(v0 + v1 + v2) AS g{i}' for i in range(3))} FROM vc),
ps AS (SELECT kept.*, cash_receipts > 0 AND staff_avg > 0 AND fkhz_count > 0 AS active,
  CASE WHEN cash_receipts > 0 AND staff_avg > 0 AND fkhz_count > 0 THEN {_pos} END AS signed_scale FROM kept, ax),
rg AS (SELECT min(signed_scale) AS lo, max(signed_scale) AS hi, stddev_pop(signed_scale) AS sd FROM ps),
ed AS (SELECT j, {_edges} - CASE WHEN j = 0 THEN (hi - lo) * 0.001 ELSE 0 END AS e FROM rg, range(0, {_BINS + 1}) t(j)),
sh AS (SELECT j, e, {_short.replace('@', 'e')} AS shown FROM ed),
bn AS (SELECT l.j AS b, l.shown AS signed_scale_left, u.shown AS signed_scale_right, 0.5 * (l.shown + u.shown) AS signed_scale_mid FROM sh l JOIN sh u ON u.j = l.j + 1),
mb AS (SELECT ps.*, (SELECT count(*) FROM ed WHERE j BETWEEN 1 AND {_BINS - 1} AND ps.signed_scale > e) AS b FROM ps WHERE active),
ix AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS bin_idx FROM (SELECT DISTINCT b FROM mb)),
mem AS (SELECT mb.*, ix.bin_idx, bn.* EXCLUDE (b) FROM mb JOIN ix ON ix.b = mb.b JOIN bn ON bn.b = mb.b)
"""
)


def _bin_table(median: str) -> str:
    shares = ", ".join(f"round(avg(CAST(svk_form_level = {i} AS DOUBLE)), 4) AS form_share_{i}" for i in range(5))
    short = (("cash", AXES[0]), ("staff", AXES[1]), ("fkhz", AXES[2]))
    return (
        "SELECT bin_idx, round(signed_scale_mid, 4) AS signed_scale_mid, round(signed_scale_left, 4) AS signed_scale_left, round(signed_scale_right, 4) AS signed_scale_right, "
        + ", ".join(f"round(exp(avg(ln(1 + {a}))) - 1, 4) AS typical_{s}, min({a}) AS {s}_min, max({a}) AS {s}_max" for s, a in short)
        + f", count(*) AS n, {median} AS form_median, quantile_cont(svk_form_level, 0.25) AS form_q25, quantile_cont(svk_form_level, 0.75) AS form_q75,"
        f" count(*) < 10 AS low_n, {shares} FROM mem GROUP BY bin_idx, mem.signed_scale_mid, mem.signed_scale_left, mem.signed_scale_right"
    )


scored("scale_axis", SCALE + "SELECT org_id, active, round(signed_scale, 6) + 0.0::DOUBLE AS signed_scale FROM ps")
scored("scale_bins", SCALE + _bin_table("round_even(median(svk_form_level), 0)"))
scored("scale_bins_share", SCALE + _bin_table("median(svk_form_level)"))
scored(
    "bin_orgs",
    SCALE
    + "SELECT org_id, bin_idx, round(signed_scale_left, 4) AS signed_scale_left, round(signed_scale_right, 4) AS signed_scale_right,"
    " round(signed_scale_mid, 4) + 0.0::DOUBLE AS signed_scale_mid, round(signed_scale, 4) + 0.0::DOUBLE AS signed_scale, org_name, cash_receipts, staff_avg, fkhz_count,"
    " svk_form_level, svk_form_name, " + ", ".join(MEASURES) + " FROM mem",
)
scored(
    "bin_forms",
    SCALE
    + f"SELECT *, {_rates} FROM (SELECT svk_form_name, count(*) AS orgs, {_sums} FROM mem WHERE bin_idx = (SELECT count(*) // 2 FROM ix) GROUP BY 1)",
)
scored(
    "scale_peak",
    SCALE
    + f", tb AS ({_bin_table('round_even(median(svk_form_level), 0)').replace('round(signed_scale_mid, 4)', 'signed_scale_mid')})"
    " SELECT bin_idx, n, form_median, typical_cash, typical_staff, typical_fkhz, round(signed_scale_mid, 4) AS signed_scale_mid,"
    " round(signed_scale_mid / sd, 4) AS sigma FROM tb, rg ORDER BY n DESC, bin_idx LIMIT 1",
)
scored(
    "scale_centre",
    SCALE
    + "SELECT " + ", ".join(f"round(exp(avg(ln(1 + {a}))) - 1, 4) AS typical_{s}" for s, a in (("cash", AXES[0]), ("staff", AXES[1]), ("fkhz", AXES[2]))) + " FROM act",
)

# The same results through the paths for large reports.
ORACLES["load_percentile_ranges"] = ORACLES["load_percentile"]
ORACLES["cloud_peers_boxes"] = ORACLES["cloud_peers"]
ORACLES["cloud_peers_nested"] = ORACLES["cloud_peers"]

# Two yearly reports, each scored by itself.
_later = ORACLES["enrich"].replace(f"rep AS ({REPORT})", f"rep AS (SELECT * FROM ({REPORT}) WHERE staff_avg IS NOT NULL)", 1)
ORACLES["enrich_two_years"] = (
    f"SELECT 2023 AS analysis_year, * FROM ({ORACLES['enrich']}) UNION ALL SELECT 2024 AS analysis_year, * FROM ({_later})"
)


def _counted(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM ({ORACLES[q]})" for n, q in tables.items())


_checks = {"contradictions": "contradictions", "anomalies": "anomalies"}
_short = {
    "enriched_organizations": "enrich",
    "direction_summary": "directions",
    "risk_groups": "risk_groups",
    "general_statistics": "overview",
    "data_quality_issues": "quality_issues",
}
_bundle = {
    "overview": "overview",
    "report_status": "report_status",
    "svk_elements": "elements",
    "basic_package": "basic_package",
    "svk_form_flags": "form_flags",
    "svk_form_level": "form_levels",
    "risk_methodology": "risk_methodology",
    "effectiveness_review": "effectiveness",
    "improvement_actions": "improvement",
    "violations": "violations",
    "normalized_metrics": "normalized",
    "directions": "directions",
    "risk_groups": "risk_groups",
    "quality_issues": "quality_issues",
    "by_federal_district": "by_district",
    "by_org_type": "by_org_type",
    "cloud_peer_3d": "cloud_peers",
}
ORACLES["short_counts"] = _counted(_short | _checks)
ORACLES["bundle_counts"] = (
    _counted(_bundle | _checks)
    + f" UNION ALL SELECT 'top_risk_orgs' AS name, least(100, count(*)) AS n_rows FROM ({ORACLES['enrich']})"
)

# Cells of the table sets: numbers and texts apart, empty cells left out.


def _table_cells(name: str, sql: str) -> str:
    keys = ", ".join(ROW_KEYS.get(name, ORG_KEYS))
    number = "try_cast(value AS DOUBLE)"
    return (
        f"SELECT {lit(name)} AS table_name, row_key, column_name, {number} AS number, CASE WHEN {number} IS NULL THEN value END AS text"
        f" FROM (UNPIVOT (SELECT concat_ws('|', {keys}) AS row_key, COLUMNS(* EXCLUDE ({keys}))::VARCHAR FROM ({sql}))"
        " ON COLUMNS(* EXCLUDE (row_key)) INTO NAME column_name VALUE value)"
    )


def _over_scored(sql: str) -> str:
    """What an oracle asks of the scored report, as a query inside another that has it."""
    rest = sql.removeprefix(SCORED).lstrip()
    return "WITH " + rest[1:] if rest.startswith(",") else rest


def _all_cells(tables: dict[str, str]) -> str:
    """The scored report is computed once for all tables."""
    once = SCORED.replace("enr AS (", "enr AS MATERIALIZED (")
    return once + " UNION ALL ".join(_table_cells(n, _over_scored(sql)) for n, sql in tables.items())


_untrimmed = SCALE.replace(
    f"kept AS (SELECT enr.* FROM enr, q, lo WHERE NOT ({_outside}) AND is_report_filled)",
    "kept AS (SELECT * FROM enr WHERE is_report_filled)",
)
ORACLES["bundle_cells"] = _all_cells(
    {n: ORACLES[q] for n, q in (_bundle | _checks).items()}
    | {
        "top_risk_orgs": ORACLES["top_risk"].replace("LIMIT 50", "LIMIT 100"),
        "scale_profile_bins": SCORED + _untrimmed + _bin_table("round_even(median(svk_form_level), 0)"),
    }
)
_place = "e.org_name, e.org_type_classified, e.federal_district, e.region, e.cash_receipts, e.staff_avg, e.fkhz_count, e.svk_form_name"
_extreme = f"SELECT {_place}, x.extreme_reason FROM enr e JOIN ({_over_scored(ORACLES['extremes'])}) x ON x.org_id = e.org_id"
scored(
    "extracts_trimmed",
    f"SELECT {_place}, x.profile_trim_reason FROM enr e JOIN ({_over_scored(ORACLES['trimmed'])}) x ON x.org_id = e.org_id",
)
ORACLES["extract_cells"] = _all_cells(
    {
        "extreme_values": _extreme,
        "scale_profile_trimmed": ORACLES["extracts_trimmed"],
        "scale_profile_bin_1": "SELECT org_name, cash_receipts, staff_avg, fkhz_count, svk_form_name, signed_scale"
        f" FROM ({_over_scored(ORACLES['bin_orgs'])}) WHERE bin_idx = 0",
    }
)
scored(
    "years_rewritten",
    f"SELECT 2023 AS analysis_year, risk_group, count(*) AS orgs, round({share('count(*)', _n)}, 6) AS percent FROM enr GROUP BY 2"
    f" UNION ALL SELECT 2024, risk_group, count(*), round({share('count(*)', _f)}, 6) FROM fil GROUP BY 2",
)

# Reports without some columns.
_unknown = ", ".join(lit(m) for m, v in _over_rows if any(c in v for c in ("package", "risk", "review")) and "double" not in v)
ORACLES["overview_sparse"] = (
    f"SELECT metric, CASE WHEN metric NOT IN ({_unknown}) THEN value END AS value FROM ({ORACLES['overview']})"
)
_less = " AND ".join(f"{yes0(c)} = 1" for c in BASIC_ELEMENTS[1:])
ORACLES["basic_package_sparse"] = (
    ORACLES["basic_package"].replace(_package, _less).replace(lit(", ".join(BASIC_ELEMENTS)), lit(", ".join(BASIC_ELEMENTS[1:])))
)
ORACLES["classes_sparse"] = ORACLES["improvement"]
ORACLES["by_district_sparse"] = ORACLES["by_district"]
ORACLES["load_level_brackets"] = ORACLES["load_level"]

# A selection, computed from its own rows.
_chosen = " AND ".join(f"{c} IN ({', '.join(lit(v) for v in values)})" for c, values in SELECTED.items())
SELECTION = SCORED + f", sel AS (SELECT * FROM enr WHERE {_chosen})\n"


def _of_selection(name: str) -> str:
    return SELECTION + ORACLES[name].removeprefix(SCORED).replace("FROM enr", "FROM sel")


ORACLES["cube_overview"] = _of_selection("overview")
ORACLES["cube_directions"] = _of_selection("directions")
_axis_pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
ORACLES["cube_moments"] = (
    SELECTION
    + ", act AS (SELECT * FROM sel WHERE is_report_filled AND "
    + " AND ".join(f"{a} > 0" for a in AXES)
    + ") "
    + " UNION ALL ".join(
        f"SELECT {lit(a)} AS axis_1, {lit(b)} AS axis_2, count(*) AS n, round(avg(ln(1 + {a})), 6) AS mean_1,"
        f" round(avg(ln(1 + {b})), 6) AS mean_2, round(covar_samp(ln(1 + {a}), ln(1 + {b})), 6) AS covariance FROM act"
        for a, b in _axis_pairs
    )
)
