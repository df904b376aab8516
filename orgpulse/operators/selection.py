"""Filters, extracts and projections over the enriched report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_COLUMNS = ("federal_district", "region", "org_type_classified", "risk_group")

FORM_SCATTER = (
    "org_name",
    "svk_form_level",
    "recommended_form_level",
    "max_direction_load_level",
    "coverage_share_active",
    "risk_group",
)
PEER_SCATTER = (
    "org_name",
    "svk_form_level",
    "peer_form_median",
    "form_vs_peer",
    "peer_group_size",
    "peer_group_level",
    "risk_group",
)
PLACE = ("org_name", "federal_district", "region")
CONTACT = ("contact_name", "contact_phone", "contact_email")


def filter_dimensions(df: DataFrame, **selected: Sequence[str]) -> DataFrame:
    """Keep rows whose dimension is in the list; an empty list does not filter."""
    for column in FILTER_COLUMNS:
        values = selected.get(column)
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct non-null values of the filter dimensions, in order."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in FILTER_COLUMNS if c in df.columns]
    )
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct().orderBy("dimension", "value")
    )


def filled_only(df: DataFrame) -> DataFrame:
    if "is_report_filled" not in df.columns:
        return df
    return df.where(F.coalesce("is_report_filled", F.lit(True)))


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def _flagged(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    return present(df.where(F.coalesce(F.col(flag), F.lit("")) != ""), [*columns, flag])


def contradictions(df: DataFrame) -> DataFrame:
    return _flagged(df, "contradictions", [*PLACE, *CONTACT])


def anomalies(df: DataFrame) -> DataFrame:
    return _flagged(df, "anomalies", [*PLACE, *CONTACT])


def quality_issues(df: DataFrame) -> DataFrame:
    return _flagged(
        df, "data_quality_flags", ["org_name", "org_type", "federal_district", "region", "report_status"]
    )


def form_scatter(df: DataFrame) -> DataFrame:
    return present(df, FORM_SCATTER)


def peer_scatter(df: DataFrame) -> DataFrame:
    return present(df, PEER_SCATTER)


def keep_by_org(df: DataFrame, kept: DataFrame, keys: Sequence[str] = ("org_id",)) -> DataFrame:
    """Rows whose organisation survived another selection."""
    return df.join(kept.select(*keys), list(keys), "left_semi")
