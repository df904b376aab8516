"""Resolving free-form headers to canonical columns, and projecting rows to them.

Distinct headers form a dictionary: each is matched once against all patterns, which are constants of the
job. A source's layout is then the least entry of its headers for every canonical column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.config import REPORT_COLUMNS, ReportColumn
from orgpulse.functions.ranking import lookup_by_value
from orgpulse.sources.sheets import SHARED, join_source
from orgpulse.staging import stage


def distinct_headers(headers: Column) -> Column:
    """Blank headers get a positional name, repeated ones a numeric suffix (".1", ".2", ...)."""
    named = F.transform(
        headers, lambda h, i: F.coalesce(h, F.concat(F.lit("Unnamed: "), i.cast("string")))
    )

    def suffix(h: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x == h))
        return F.when(earlier > 0, F.concat(h, F.lit("."), earlier.cast("string"))).otherwise(h)

    return F.transform(named, suffix)


def normal_header(h: Column) -> Column:
    """Line breaks, NBSP and runs of whitespace become one space."""
    return F.trim(F.regexp_replace(h, r"(?U)[\s\x1c-\x1f]+", " "))


def _shown(h: Column) -> Column:
    """The header as it is reported: trimmed, line breaks as spaces."""
    return F.translate(F.regexp_replace(h, r"(?U)^\s+|\s+$", ""), "\n\r", "  ")


def _first(flags: Column) -> Column:
    """0-based index of the first true element, null when there is none."""
    return F.nullif(F.array_position(flags, True), F.lit(0).cast("long")) - 1


def _constants(columns: Sequence[ReportColumn]) -> Column:
    """The column map as one constant array, folded by the optimizer."""
    spec = [{"canonical": c.name, "label": c.label, "patterns": list(c.patterns)} for c in columns]
    return F.from_json(
        F.lit(json.dumps(spec, ensure_ascii=False)),
        "array<struct<canonical:string,label:string,patterns:array<string>>>",
    )


def header_dictionary(found: DataFrame, columns: Sequence[ReportColumn] = REPORT_COLUMNS) -> DataFrame:
    """`found` (normal, ...) with `hits`, the canonical columns that a normalised header can stand for:
    number of the column, pass (0: equal to a pattern, 1: found by one) and number of that pattern.
    Headers that stand for nothing are left out."""

    def hit(c: Column, number: Column) -> Column:
        equal = F.nullif(F.array_position(c["patterns"], F.col("normal")), F.lit(0).cast("long")) - 1
        similar = _first(F.transform(c["patterns"], lambda p: F.rlike(F.col("normal"), F.concat(F.lit("(?iu)"), p))))

        def at(step: int, pattern: Column) -> Column:
            return F.struct(
                number.alias("column"), F.lit(step).alias("pass"), pattern.cast("int").alias("pattern")
            )

        return F.when(equal.isNotNull(), at(0, equal)).when(similar.isNotNull(), at(1, similar))

    hits = F.filter(F.transform(_constants(columns), hit), lambda h: h.isNotNull())
    return found.withColumn("hits", hits).where(F.size("hits") > 0)


def resolve(headers: DataFrame, columns: Sequence[ReportColumn] = REPORT_COLUMNS) -> DataFrame:
    """(source, raw, positions): for every source the header index of each canonical column.

    Patterns are tried in order, first for equality (of equal headers the last one counts), then by
    search (the first one counts). Every distinct layout is taken apart once and every distinct header
    matched once, whatever their numbers; a layout takes for each column the least (pass, pattern, place)
    of its headers. Headers and layouts with at least 1/SHARED of all are looked up by broadcast.
    """
    rows = headers.select("source", "headers")
    # Written tables keep the matching behind the grouping: as one plan it would run before it, on every cell.
    counted = rows.groupBy("headers").agg(F.count(F.lit(1)).alias("n")).withColumn("layout", F.monotonically_increasing_id())
    layouts = stage(counted.withColumn("raw", distinct_headers(F.col("headers"))), "layouts")
    places = layouts.select("layout", F.posexplode("raw").alias("at", "header"))
    places = stage(places.select("layout", "at", normal_header(F.col("header")).alias("normal")), "headerplaces")
    words = stage(places.groupBy("normal").agg(F.count(F.lit(1)).alias("n")), "headers")
    dictionary = stage(header_dictionary(words, columns), "headerdictionary")
    total = words.agg(F.sum("n")).first()[0] or 0
    matched = lookup_by_value(places, dictionary, ["normal"], F.col("n") * SHARED >= total, split=True)
    hits = matched.select("layout", "at", F.inline("hits"))
    order = F.struct("pass", "pattern", F.when(F.col("pass") == 0, -F.col("at")).otherwise(F.col("at")).alias("tie"), "at")
    best = hits.groupBy("layout", "column").agg(F.min(order).alias("best"))
    found = best.groupBy("layout").agg(F.map_from_entries(F.collect_list(F.struct("column", "best.at"))).alias("found"))
    positions = F.transform(
        F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.try_element_at(F.col("found"), i).cast("int")
    )
    none = F.array_repeat(F.lit(None).cast("int"), len(columns))
    resolved = layouts.join(found, "layout", "left").select("headers", "n", "raw", F.coalesce(positions, none).alias("positions"))
    resolved = stage(resolved, "resolved")
    sources = resolved.agg(F.sum("n")).first()[0] or 0
    looked_up = lookup_by_value(rows, resolved, ["headers"], F.col("n") * SHARED >= sources, split=True)
    return looked_up.select("source", "raw", "positions")


def resolution_report(headers: DataFrame, columns: Sequence[ReportColumn] = REPORT_COLUMNS) -> DataFrame:
    """(source, canonical, label, original, found), one row per canonical column and source."""
    rows = resolve(headers, columns).select(
        "source", "raw", F.explode(F.arrays_zip(_constants(columns).alias("name"), F.col("positions").alias("at"))).alias("r")
    )
    original = _shown(F.get("raw", F.col("r.at")))
    return rows.select(
        "source",
        F.col("r.name.canonical").alias("canonical"),
        F.col("r.name.label").alias("label"),
        original.alias("original"),
        F.col("r.at").isNotNull().alias("found"),
    )


def unresolved(report: DataFrame) -> DataFrame:
    return report.where(~F.col("found")).select("source", "canonical", "label")


def canonical_rows(
    rows: DataFrame, headers: DataFrame, columns: Sequence[ReportColumn] = REPORT_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """Project sheet rows to canonical names; each source uses its own header layout.

    A column that no source resolves is left out, as operators expect absent columns to be absent.
    """
    layout = resolve(headers, columns).select("source", "positions")
    present = layout.agg(
        *[F.max(F.get("positions", F.lit(i))).alias(c.name) for i, c in enumerate(columns)]
    ).first()
    joined = join_source(rows, layout)
    cells = [
        F.get("cells", F.get("positions", F.lit(i))).alias(c.name)
        for i, c in enumerate(columns)
        if present[c.name] is not None
    ]
    return joined.select("source", *keep, *cells)


def with_org_id(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """A stable organisation key for reports that carry none: the place of the row in its source."""
    return rows.withColumn("org_id", F.concat_ws("#", "source", *[F.col(c).cast("string") for c in order]))
