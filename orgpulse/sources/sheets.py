"""Raw report sheets: reading, header-row detection, newest snapshot.

A sheet is a set of rows `(source, <order columns>, cells)`: the file it came from, columns that
order its rows, and the cells as an array of strings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.config import HEADER_MARKERS
from orgpulse.functions.ranking import lookup_by_value
from orgpulse.staging import stage

# Defaults of header detection: leading rows that are searched, and markers that make a header.
SCAN_ROWS = 30
MIN_MARKERS = 2
# A source with at least 1/SHARED of all rows is looked up by broadcast; there can be at most SHARED.
SHARED = 1_000


_ESCAPES = {"t": "\t", "r": "\r", "b": "\b", "f": "\f", "u0000": "\0"}


def separator(options: dict[str, str]) -> str:
    """The separator as the CSV reader takes it: `sep` before its alias `delimiter`, in any case, escapes resolved."""
    known = {k.lower(): v for k, v in options.items()}
    return re.sub(r"\\(u0000|.)", lambda m: _ESCAPES.get(m[1], m[1]), known.get("sep", known.get("delimiter", ",")))


def sheet_width(spark: SparkSession, path: str, **options: str) -> int:
    """Cells of the widest row at most: one more than the separators inside any record, where a record is
    what the CSV reader with these options takes for one. Against one expected cell every wider record is
    malformed, and the reader hands over its text."""
    own = {"header": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "columnPruning": "false"}
    given = {k: v for k, v in options.items() if k.lower() not in {x.lower() for x in own}}
    records = spark.read.schema("c0 string, _record string").options(**own, **given).csv(path)
    text, sep = F.col("_record"), separator(options)
    seps = (F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))) / len(sep)
    # The reader refuses to return the text of the records alone.
    return int(records.agg(F.max(seps).alias("n"), F.count("c0")).first()["n"] or 0) + 1


def read_sheets(spark: SparkSession, path: str, cells: int | None = None, **options: str) -> DataFrame:
    """Delimited files without assuming where the header is; all rows get as many cells as the widest
    record has (`cells` overrides that). Rows of a file are ordered by the start of their split and their
    place in it, so large files stay splittable. Stage the result: the place is only comparable within
    one scan, and every later step reads the rows again."""
    if cells is None:
        cells = sheet_width(spark, path, **options)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(cells)])
    raw = spark.read.schema(schema).options(header="false", mode="PERMISSIVE", **options).csv(path)
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.array(*[F.col(f"c{i}") for i in range(cells)]).alias("cells"),
    )


def newest_file(spark: SparkSession, folder: str, pattern: str | Sequence[str] = "*.csv") -> str | None:
    """Path of the most recently modified file of one or several patterns; only the listing is read,
    not the contents."""
    if not isinstance(pattern, str):
        pattern = "{" + ",".join(pattern) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime")
        .orderBy(F.desc("modificationTime"), "path")
        .limit(1)
        .collect()
    )
    return files[0]["path"] if files else None


def latest_snapshot(rows: DataFrame, source: str = "source", modified: str = "modified") -> DataFrame:
    """Rows of the most recently modified source (ties: first name), found by scalar subqueries."""
    newest = rows.agg(F.max(modified)).scalar()
    name = rows.where(F.col(modified) == newest).agg(F.min(source)).scalar()
    return rows.where(F.col(source) == name)


def marker_hits(cells: Column) -> Column:
    """How many of the header markers occur in some cell of the row."""
    hits = [
        F.coalesce(F.exists(cells, lambda c: F.coalesce(c.contains(m), F.lit(False))), F.lit(False)).cast("int")
        for m in HEADER_MARKERS
    ]
    return sum(hits[1:], hits[0])


def detect_headers(
    sheets: DataFrame, order: Sequence[str], scan_rows: int = SCAN_ROWS, min_markers: int = MIN_MARKERS
) -> DataFrame:
    """Per source the header row: the first of its `scan_rows` leading rows with at least `min_markers`
    markers, else its first row. `accepted` is false when even that row has too few markers."""
    position = Window.partitionBy("source").orderBy(*order)
    # The row limit is applied before the shuffle, so a source of any size sends only its first rows.
    head = sheets.withColumn("n", F.row_number().over(position)).where(F.col("n") <= scan_rows)
    row = F.struct("n", marker_hits(F.col("cells")).alias("hits"), F.struct(*order).alias("at"), "cells")
    ok = marker_hits(F.col("cells")) >= min_markers
    return (
        head.groupBy("source")
        .agg(F.coalesce(F.min_by(row, F.when(ok, F.col("n"))), F.min_by(row, "n")).alias("r"))
        .select(
            "source",
            (F.col("r.n") - 1).alias("header_row"),
            F.col("r.hits").alias("markers"),
            (F.col("r.hits") >= min_markers).alias("accepted"),
            F.col("r.at").alias("header_at"),
            F.col("r.cells").alias("headers"),
        )
    )


def join_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source, from a table of one row a source. Sources with a share of the
    rows worth mentioning are broadcast, their number is bounded by that share; rows of the others are
    shuffled by source. Neither the number of sources nor a source with half of all rows matters."""
    counts = stage(rows.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows")), "source-rows")
    total = counts.agg(F.sum("source_rows")).first()[0] or 0
    table = stage(per_source.join(counts, "source"), "sources")
    joined = lookup_by_value(rows, table, ["source"], F.col("source_rows") * SHARED >= total, split=True)
    return joined.drop("source_rows")


def rejected_sources(headers: DataFrame) -> DataFrame:
    """The sources whose header was not recognised, with the markers of their best row."""
    return headers.where("not accepted")


def data_rows(sheets: DataFrame, headers: DataFrame, order: Sequence[str], on_rejected: str = "raise") -> DataFrame:
    """Rows below the header of every accepted source. A source without a recognised header is an error
    that names it, unless `on_rejected` is "skip"; `rejected_sources` lists those."""
    if on_rejected == "raise":
        bad = [r["source"] for r in rejected_sources(headers).select("source").orderBy("source").limit(20).collect()]
        if bad:
            raise ValueError(f"no header row found in {', '.join(bad)}")
    elif on_rejected != "skip":
        raise ValueError('on_rejected is "raise" or "skip"')
    joined = join_source(sheets, headers.where("accepted").select("source", "header_at"))
    return joined.where(F.struct(*order) > F.col("header_at")).drop("header_at")
