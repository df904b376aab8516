"""Fitted scale models kept as a table, so that later analyses of a selection plan no fit.

A model is what the scale profile learns from a selection: the trimming limits of the axes and the fitted
scale axis with its bins. It is one row, kept under a key made of the selection, the shares, the number of
bins, the settings and the state of the input; a changed input or setting has another key. Models are
appended, one file each, so a writer that is lost leaves no half model, and two writers of one key write
the same row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orgpulse.config import ScoringConfig
from orgpulse.operators.proportionality import Limits, profile_limits, split_by_limits
from orgpulse.operators.scale_profile import Bin, ScaleAxis, fit_scale_axis
from orgpulse.operators.selection import filter_dimensions
from orgpulse.staging import modified

SCHEMA = """settings string, limits array<struct<axis: string, share: double, value: double>>, fitted boolean,
means array<double>, stds array<double>, loadings array<double>, edges array<double>,
bins array<struct<number: int, left: double, right: double>>, spread double, n_active long"""


@dataclass(frozen=True)
class ScaleModel:
    """Trimming limits by (axis, share), and the axis fitted to the kept rows; None where they are too few."""

    limits: Limits
    axis: ScaleAxis | None


@dataclass(frozen=True)
class Request:
    """What a model is fitted to. `state` names the state of the input, for instance the modification
    times of its files."""

    selection: Mapping[str, Sequence[str]]
    state: str
    low: float | Mapping[str, float] = 0.005
    high: float | Mapping[str, float] = 0.995
    n_bins: int | None = None

    def settings(self, cfg: ScoringConfig) -> str:
        chosen = {c: sorted(map(str, v)) for c, v in self.selection.items() if v}
        return json.dumps([chosen, self.state, self.low, self.high, self.n_bins, cfg.to_json()], sort_keys=True, ensure_ascii=False)


def fit(df: DataFrame, cfg: ScoringConfig, request: Request) -> ScaleModel:
    rows = filter_dimensions(df, **request.selection)
    limits = profile_limits(rows, request.low, request.high)
    kept, _ = split_by_limits(rows, limits, request.low, request.high)
    return ScaleModel(limits, fit_scale_axis(kept, cfg, request.n_bins))


def _row(settings: str, model: ScaleModel) -> tuple:
    limits = [(a, share, value) for (a, share), value in model.limits.items()]
    a = model.axis
    if a is None:
        return (settings, limits, False, *[None] * 7)
    bins = [(b.number, b.left, b.right) for b in a.bins]
    return (settings, limits, True, list(a.means), list(a.stds), list(a.loadings), list(a.edges), bins, a.spread, a.n_active)


def _path(folder: str, settings: str) -> str:
    return f"{folder.rstrip('/')}/key={hashlib.sha256(settings.encode()).hexdigest()}"


def save(spark: SparkSession, folder: str, settings: str, model: ScaleModel) -> None:
    row = spark.createDataFrame([_row(settings, model)], SCHEMA)
    row.coalesce(1).write.mode("append").parquet(_path(folder, settings))


def load(spark: SparkSession, folder: str, settings: str) -> ScaleModel | None:
    """The model kept for these settings, None where there is none."""
    path = _path(folder, settings)
    if not any(name.endswith(".parquet") for name, *_ in modified(spark, [path])):
        return None
    r = spark.read.schema(SCHEMA).parquet(path).first()
    limits = {(x["axis"], x["share"]): x["value"] for x in r["limits"]}
    if not r["fitted"]:
        return ScaleModel(limits, None)
    bins = tuple(Bin(b["number"], b["left"], b["right"]) for b in r["bins"])
    numbers = [tuple(r[c]) for c in ("means", "stds", "loadings", "edges")]
    return ScaleModel(limits, ScaleAxis(*numbers, bins, r["spread"], r["n_active"]))


def scale_model(df: DataFrame, cfg: ScoringConfig, folder: str, request: Request) -> tuple[DataFrame, ScaleModel]:
    """(kept rows of the selection, its model); fitted and kept the first time, read afterwards."""
    spark, settings = df.sparkSession, request.settings(cfg)
    model = load(spark, folder, settings)
    if model is None:
        model = fit(df, cfg, request)
        save(spark, folder, settings, model)
    kept, _ = split_by_limits(filter_dimensions(df, **request.selection), model.limits, request.low, request.high)
    return kept, model
