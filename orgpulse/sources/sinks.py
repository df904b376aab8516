"""Writing result tables: the short set and the full bundle, one directory per table, a set in long form,
and sets of several years of which one can be written anew."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.config import ScoringConfig
from orgpulse.operators import neighbours, proportionality, scale_profile, selection, summaries


def short_tables(enriched: DataFrame, cfg: ScoringConfig) -> dict[str, DataFrame]:
    return {
        "enriched_organizations": enriched,
        "direction_summary": summaries.directions(enriched, cfg),
        "risk_groups": summaries.risk_groups(enriched),
        "general_statistics": summaries.overview(enriched),
        "data_quality_issues": selection.quality_issues(enriched),
        "contradictions": selection.contradictions(enriched),
        "anomalies": selection.anomalies(enriched),
    }


def bundle_tables(
    enriched: DataFrame, cfg: ScoringConfig, key: str = "org_id", peers: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The full bundle; `peers` is the nearest-peer table where the caller has it already."""
    axis = scale_profile.fit_scale_axis(enriched, cfg)
    tables = {
        "overview": summaries.overview(enriched),
        "report_status": summaries.report_status(enriched),
        "svk_elements": summaries.elements(enriched),
        "basic_package": summaries.basic_package(enriched),
        "svk_form_flags": summaries.form_flags(enriched, cfg),
        "svk_form_level": summaries.form_levels(enriched),
        "risk_methodology": summaries.risk_methodology(enriched),
        "effectiveness_review": summaries.effectiveness(enriched),
        "improvement_actions": summaries.improvement(enriched),
        "violations": summaries.violations(enriched),
        "normalized_metrics": summaries.normalized(enriched),
        "directions": summaries.directions(enriched, cfg),
        "risk_groups": summaries.risk_groups(enriched),
        "top_risk_orgs": summaries.top_risk(enriched, 100, (key,)),
        "contradictions": selection.contradictions(enriched),
        "anomalies": selection.anomalies(enriched),
        "quality_issues": selection.quality_issues(enriched),
        "by_federal_district": summaries.by_dimension(enriched, "federal_district"),
        "by_org_type": summaries.by_dimension(enriched, "org_type"),
        "cloud_peer_3d": neighbours.cloud_peers(enriched, cfg, key) if peers is None else peers,
    }
    if axis is not None:
        members = scale_profile.bin_members(enriched, axis, (key,))
        tables["scale_profile_bins"] = scale_profile.bin_statistics(members, whole_median=True)
    return tables


EXTRACT_COLUMNS = (
    "org_name",
    "org_type_classified",
    "federal_district",
    "region",
    "cash_receipts",
    "staff_avg",
    "fkhz_count",
    "svk_form_name",
)
BIN_EXTRACT_COLUMNS = ("org_name", "cash_receipts", "staff_avg", "fkhz_count", "svk_form_name", "signed_scale")


def extract_tables(
    enriched: DataFrame,
    cfg: ScoringConfig,
    key: str = "org_id",
    bin_idx: int = 0,
    peers: DataFrame | None = None,
    proportions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Row lists for checking: what the analyses put aside, and the members of one bin. `peers` and
    `proportions` are the tables of those analyses where the caller has them already."""
    if proportions is None:
        proportions = proportionality.proportionality(enriched, cfg, (key,))
    _, extreme = proportionality.split_extremes(proportions, keys=(key,))
    kept, trimmed = proportionality.split_profile_outliers(enriched)
    tables = {
        "top_risk_organizations": summaries.top_risk(enriched, 100, (key,)),
        "contradictions": selection.contradictions(enriched),
        "anomalies": selection.anomalies(enriched),
        "extreme_values": selection.present(extreme, [*EXTRACT_COLUMNS, "extreme_reason"]),
        "scale_profile_trimmed": selection.present(trimmed, [*EXTRACT_COLUMNS, "profile_trim_reason"]),
        "cloud_peer_3d": neighbours.cloud_peers(enriched, cfg, key) if peers is None else peers,
    }
    axis = scale_profile.fit_scale_axis(kept, cfg)
    if axis is not None:
        members = scale_profile.bin_members(kept, axis, (key,))
        rows = scale_profile.ordered_members(members, bin_idx, (key,))
        tables[f"scale_profile_bin_{bin_idx + 1}"] = selection.present(rows, BIN_EXTRACT_COLUMNS)
    return tables


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> str:
    """Write one table; CSV leaves out nested columns, which its text form already covers."""
    if fmt == "csv":
        flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
        df = df.select(*[F.col(c) for c in flat])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_table(df, f"{folder.rstrip('/')}/{name}", fmt) for name, df in tables.items()}


# ---- a set in long form -----------------------------------------------------------------------

# What names a row of each table; rows of the other tables are named by organisation.
ROW_KEYS = {
    "overview": ("metric",),
    "report_status": ("status",),
    "svk_elements": ("element_key",),
    "basic_package": ("metric",),
    "svk_form_flags": ("form_key",),
    "svk_form_level": ("svk_form_level",),
    "risk_methodology": ("category",),
    "effectiveness_review": ("category",),
    "improvement_actions": ("category",),
    "violations": ("metric",),
    "normalized_metrics": ("metric", "unit"),
    "directions": ("direction_key",),
    "risk_groups": ("risk_group",),
    "by_federal_district": ("federal_district",),
    "by_org_type": ("org_type",),
    "scale_profile_bins": ("bin_idx",),
}
ORG_KEYS = ("org_name",)


def cells(tables: Mapping[str, DataFrame], digits: Mapping[str, int] | None = None) -> DataFrame:
    """(table_name, row_key, column_name, number, text): every filled cell of a set of tables, as one table.

    Numbers are in `number`, flags and texts in `text`; a cell without a value and a column of nested
    values give no row. `digits` rounds the fractions of a table half up.
    """

    def long(name: str, df: DataFrame) -> DataFrame:
        keys = ROW_KEYS.get(name, ORG_KEYS)
        found = []
        for f in df.schema.fields:
            if f.name in keys or isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
                continue
            number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
            if isinstance(f.dataType, T.NumericType):
                number = F.col(f.name).cast("double")
                if digits is not None and name in digits and isinstance(f.dataType, T.FractionalType):
                    number = F.round(number, digits[name]) + F.lit(0.0)
            else:
                text = F.col(f.name).cast("string")
            found.append(F.struct(F.lit(f.name).alias("column_name"), number.alias("number"), text.alias("text")))
        row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        rows = df.select(F.lit(name).alias("table_name"), row_key.alias("row_key"), F.inline(F.array(*found)))
        return rows.where(F.col("number").isNotNull() | F.col("text").isNotNull())

    return reduce(DataFrame.unionByName, [long(n, df) for n, df in tables.items()])


# ---- sets of several years --------------------------------------------------------------------

YEAR = "analysis_year"
MANIFEST = "manifest"
MANIFEST_SCHEMA = f"{YEAR} int, version long, run string, name string, path string"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{MANIFEST}"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def complete_tables(spark: SparkSession, folder: str) -> list:
    """The manifest's rows of the last complete set of every year: one for each table and year."""
    rows = _manifest(spark, folder)
    last = rows.groupBy(YEAR).agg(F.max(F.struct("version", "run")).alias("last"))
    rows = rows.join(F.broadcast(last), YEAR).where(F.struct("version", "run") == F.col("last"))
    return rows.drop("last").orderBy(YEAR, "name").collect()


def write_year(tables: Mapping[str, DataFrame], folder: str, year: int) -> int:
    """Write the set of one year beside those of other years; returns its version.

    Every table goes to a folder of its own version, `<folder>/<name>/analysis_year=<year>/version=<v>`,
    and the manifest names the set in one file, written last. Until then, and after a writer that was lost
    on its way, readers see the year's former set as a whole. A table without rows replaces the former one
    too. Rows of another year in a table that states its year are an error.
    """
    if not tables:
        raise ValueError("a set needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if YEAR in df.columns and df.where(~F.col(YEAR).eqNullSafe(year)).limit(1).count():
            raise ValueError(f"table {name} has rows of another year than {year}")
    former = _manifest(spark, folder).where(F.col(YEAR) == year).agg(F.max("version")).first()[0]
    version, run = (former or 0) + 1, uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}/{YEAR}={year}/version={version}-{run}"
        rows.append((year, version, run, name, write_table(df.drop(YEAR), path)))
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
    manifest.write.mode("append").parquet(f"{folder.rstrip('/')}/{MANIFEST}")
    return version


def read_years(spark: SparkSession, folder: str, name: str, years: Sequence[int] | None = None) -> DataFrame:
    """One table of the last complete sets, of all years or of those named, with `analysis_year`.

    Columns that only some years have are null in the others. A year without such a table is an error
    where it is named, and otherwise has no rows.
    """
    paths = {r[YEAR]: r["path"] for r in complete_tables(spark, folder) if r["name"] == name}
    wanted = sorted(paths) if years is None else list(years)
    missing = [y for y in wanted if y not in paths]
    if missing or not wanted:
        raise ValueError(f"no complete table {name} of {missing or 'any year'} in {folder}")
    reader = spark.read.option("basePath", f"{folder.rstrip('/')}/{name}").option("mergeSchema", True)
    return reader.parquet(*[paths[y] for y in wanted]).drop("version")
