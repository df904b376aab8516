"""Cleaning of free-form answers: text, yes/no, locale-formatted numbers, answer classes."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.config import FORM_NAMES, KEPT_ORG_TYPES, NOT_STATED, OTHER_ORG_TYPE, UNKNOWN_FORM

# Answers that mean "no answer" (compared after cleaning, in lower case).
MISSING_TEXTS = ("", "-", "—", "nan", "none", "нет данных", "не заполнено", "не указано")

# `(?U)` makes \s cover NBSP and the other Unicode spaces; the ASCII separators are not in it.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def clean_text(c: Column) -> Column:
    """Collapse whitespace and trim; placeholders become null."""
    text = F.trim(F.regexp_replace(c.cast("string"), _SPACES, " "))
    return F.when(~F.lower(text).isin(*MISSING_TEXTS), text)


# The white space that \\s covers in Unicode mode, for trims that stay on the UTF-8 bytes.
_BLANKS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NO_DATA = r"(?iuU)^[\s\x1c-\x1f]*нет[\s\x1c-\x1f]+данных[\s\x1c-\x1f]*$"
_NOT_FILLED = (
    r"(?iuUs)^(?![\s\x1c-\x1f]*не[\s\x1c-\x1f]+заполнено[\s\x1c-\x1f]*$).*не[\s\x1c-\x1f]+заполн"
)


def _spellings(word: str) -> list[str]:
    """All upper/lower case spellings of a short word."""
    return ["".join(p) for p in product(*[(ch.lower(), ch.upper()) for ch in word])]


def yes_flag(c: Column) -> Column:
    """1.0 for answers beginning with "да", 0.0 for "нет", null otherwise; "нет данных" is no answer.

    Equal to testing the prefix of the cleaned lower-case text, without building that text.
    """
    text = F.ltrim(c.cast("string"), F.lit(_BLANKS))
    yes = F.substring(text, 1, 2).isin(_spellings("да"))
    no = F.substring(text, 1, 3).isin(_spellings("нет"))
    return F.when(yes, F.lit(1.0)).when(no & ~text.rlike(_NO_DATA), F.lit(0.0))


def to_number(c: Column, data_type: T.DataType) -> Column:
    """Parse a locale-formatted number; numeric columns pass through with NaN turned into null."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(data_type, T.NumericType):
        return c.cast("double")
    digits = F.regexp_replace(F.translate(c.cast("string"), ",", "."), r"[^0-9.\-]", "")
    return digits.try_cast("double")


def number_or_null(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return to_number(F.col(name), df.schema[name].dataType)


def number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(number_or_null(df, name), F.lit(0.0))


def flag_or_null(df: DataFrame, name: str) -> Column:
    return yes_flag(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def flag_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(flag_or_null(df, name), F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """Ratio that is null, not an error, when the denominator is zero or null."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def clean_frame(df: DataFrame, numeric: Iterable[str], yes_no: Iterable[str]) -> DataFrame:
    """Clean a whole frame by column class; yes/no columns get a ``__flag`` companion."""
    numeric, yes_no = set(numeric), set(yes_no)
    cols: list[Column] = []
    flags: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in numeric:
            cols.append(to_number(c, f.dataType).alias(f.name))
        elif f.name in yes_no:
            cols.append(c)
            flags.append(yes_flag(c).alias(f"{f.name}__flag"))
        elif isinstance(f.dataType, T.StringType):
            cols.append(clean_text(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols, *flags)


def form_name(level: Column) -> Column:
    out = F.when(level == 0, FORM_NAMES[0])
    for value in sorted(FORM_NAMES)[1:]:
        out = out.when(level == value, FORM_NAMES[value])
    return out.otherwise(UNKNOWN_FORM)


def org_type_class(c: Column) -> Column:
    text = F.trim(c.cast("string"), F.lit(_BLANKS))
    return F.when(text.isin(*KEPT_ORG_TYPES), text).otherwise(OTHER_ORG_TYPE)


def is_filled(c: Column) -> Column:
    """A report counts as filled unless its status says otherwise; no status means filled."""
    return ~F.coalesce(c.cast("string").rlike(_NOT_FILLED), F.lit(False))


def _answer_class(c: Column, rules: list[tuple[str, object]]) -> Column:
    text = clean_text(c)
    low = F.lower(text)
    out = F.when(text.isNull(), NOT_STATED)
    for name, test in rules:
        out = out.when(test(low), name)
    return out.otherwise(text)


def _has(*parts: str):
    def test(low: Column) -> Column:
        found = low.contains(parts[0])
        for p in parts[1:]:
            found = found | low.contains(p)
        return found

    return test


# Fixed values of the three rule sets: class name and the substrings that select it, first hit wins.
RISK_ABSENT = "Методика отсутствует"
RISK_FRAGMENTARY = "Фрагментарная / несистемная"
RISK_FULL = "Полноценная методика"
REVIEW_NONE = "Оценка не проводится"
REVIEW_IRREGULAR = "Нерегулярная / без оформления"
REVIEW_REGULAR = "Регулярная оценка"
IMPROVE_NONE = "Не планируются / не проводятся"
IMPROVE_PARTIAL = "Планируются / частично выполняются"
IMPROVE_DONE = "Документированные мероприятия реализуются"


def risk_methodology_class(c: Column) -> Column:
    def full(low: Column) -> Column:
        return _has("утвержден", "карты рисков")(low) | (low.contains("риск") & low.contains("план"))

    return _answer_class(
        c,
        [
            (RISK_ABSENT, _has("отсутств", "не применяется")),
            (RISK_FRAGMENTARY, _has("фрагментар", "несистем")),
            (RISK_FULL, full),
        ],
    )


def effectiveness_class(c: Column) -> Column:
    return _answer_class(
        c,
        [
            (REVIEW_NONE, _has("не проводится")),
            (REVIEW_IRREGULAR, _has("нерегуляр", "не оформ")),
            (REVIEW_REGULAR, _has("регуляр", "не реже")),
        ],
    )


def improvement_class(c: Column) -> Column:
    return _answer_class(
        c,
        [
            (IMPROVE_NONE, _has("не планируются", "не проводятся")),
            (IMPROVE_PARTIAL, _has("не в полном объеме", "планируются")),
            (IMPROVE_DONE, _has("разрабатываются", "реализуются", "документирован")),
        ],
    )


def log_axis(c: Column) -> Column:
    """Decimal logarithm with non-positive values as null."""
    return F.when(c > 0, F.log10(c))


def python_float_text(c: Column) -> Column:
    """Plain decimal text of a double ("5.0", "12345678.0"), never in E notation."""
    plain = F.regexp_replace(c.cast("string").cast("decimal(38,16)").cast("string"), "0+$", "")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
