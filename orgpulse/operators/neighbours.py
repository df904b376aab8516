"""Exact k nearest organisations in ln(1+axis) space.

Distances are compared inside balanced boxes, never over all pairs:

1. organisations at the same point collapse into one location that remembers only the k+1 smallest
   keys, which is all that any neighbour list can use of it;
2. a tree of boxes, cut again wherever one is overfull, splits the locations into boxes of a few thousand
   points; it is a table a level, without a limit of boxes;
3. every location is answered inside its own box, which bounds its true k-th distance;
4. locations whose bound reaches into other boxes visit those, nearest first, until no unvisited
   box is within the bound. Boxes asked for by many locations are split over several tasks.

Box sizes and the number of visits only affect speed; the answer equals brute force.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.config import AXES, ScoringConfig
from orgpulse.functions import cleaning as C
from orgpulse.functions.boxes import BOUNDS, CELLS, nested_boxes, parents_of_small, within_reach
from orgpulse.functions.ranking import HOT_SHARE, RANGE_ROWS, column_sizes, lookup_by_value, require_unique, value_percentiles
from orgpulse.functions.space import box_distance, nearest
from orgpulse.operators.selection import filled_only, present
from orgpulse.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX_ROWS = 2_000
VISITS_PER_TASK = 20_000
FIRST_FAN = 8

XYZ = ["x", "y", "z"]

CARRIED = (
    "org_name",
    "org_type",
    "org_type_classified",
    "federal_district",
    "region",
    "cash_receipts",
    "staff_avg",
    "fkhz_count",
    "svk_form_level",
    "svk_form_name",
    "form_vs_peer",
)
PRIORITY_COLUMNS = (
    "org_name",
    "org_type_classified",
    "federal_district",
    "region",
    "cash_receipts",
    "staff_avg",
    "fkhz_count",
    "svk_form_level",
    "svk_form_name",
    "peer_3d_form_median",
    "form_vs_peer_3d",
    "form_vs_peer",
    "profile_skew_3d",
    "profile_skew_3d_axis",
    "peer_3d_confidence",
    "peer_3d_group_size",
    "peer_3d_mean_distance",
)


# ---- locations and boxes ----------------------------------------------------------------------


def _locations(points: DataFrame, key: str, keep: int) -> DataFrame:
    """One row per distinct point with its `keep` smallest organisations.

    The row limit per point is applied before the shuffle, so a point shared by a third of all
    organisations sends a handful of rows per task.
    """
    first = Window.partitionBy(*XYZ).orderBy(key)
    members = F.collect_list(F.struct(key, "name", "form")).over(first.rowsBetween(Window.currentRow, keep - 1))
    return (
        points.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= keep)
        .withColumn("members", members)
        .where(F.col("rn") == 1)
        .select(F.col(key).alias("loc"), *XYZ, "members")
    )


def _answers(loc: np.ndarray, ids: np.ndarray, triples, n: int) -> pd.DataFrame:
    """One row per query: sorted neighbour ids and distances."""
    i, j, d = triples
    ends = np.searchsorted(i, np.arange(n + 1))
    near = ids[j]
    return pd.DataFrame(
        {
            "loc": loc,
            "ids": [near[a:b] for a, b in zip(ends[:-1], ends[1:])],
            "dists": [d[a:b] for a, b in zip(ends[:-1], ends[1:])],
        }
    )


def _own_box(k: int):
    def answer(box: pd.DataFrame) -> pd.DataFrame:
        box = box.sort_values("loc", ignore_index=True)
        at = box[XYZ].to_numpy(dtype=float)
        loc = box["loc"].to_numpy()
        out = _answers(loc, loc, nearest(at, at, k), len(box))
        return box[["box", *XYZ]].join(out)

    return answer


def _visit(k: int):
    def answer(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("loc", ignore_index=True)
        triples = nearest(
            asked[XYZ].to_numpy(dtype=float), points[XYZ].to_numpy(dtype=float), k, asked["bound"].to_numpy(dtype=float)
        )
        return _answers(asked["loc"].to_numpy(), points["loc"].to_numpy(), triples, len(asked))

    return answer


def _next_visits(k: int, fan: int):
    """Boxes each location of one box must still look into, nearest first, at most `fan` of them now."""

    def due(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        at = rows[XYZ].to_numpy(dtype=float)
        bound = rows["bound"].to_numpy()
        gaps = box_distance(at, boxes[BOUNDS[:3]].to_numpy(), boxes[BOUNDS[3:]].to_numpy())
        rank = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1, kind="stable")
        # Boxes within the bound are the nearest ones, so their ranks do not depend on the others.
        done = rows["visited"].to_numpy()[:, None]
        open_ = (gaps <= bound[:, None]) & (rank >= done)
        now = open_ & (rank < done + fan)
        last = ~(open_ & ~now).any(axis=1)
        i, j = np.nonzero(now)
        return pd.DataFrame(
            {
                "loc": rows["loc"].to_numpy()[i],
                "to_box": boxes["to_box"].to_numpy()[j],
                "x": at[i, 0],
                "y": at[i, 1],
                "z": at[i, 2],
                "bound": bound[i],
                "last": last[i],
            }
        )

    def plan(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        # One order of the boxes in every round, so that a rank stays what it is.
        boxes = boxes.sort_values("to_box", ignore_index=True)
        step = max(1, 4_000_000 // max(1, len(boxes)))
        return pd.concat([due(rows.iloc[start : start + step], boxes) for start in range(0, max(1, len(rows)), step)])

    return plan


def _with_bound(pending: DataFrame, k: int) -> DataFrame:
    """`bound`: no farther than this is the k-th nearest location."""
    bound = F.coalesce(F.try_element_at("dists", F.lit(k)), F.col("far"))
    # Slack for rounding: one visit too many costs little, one too few is wrong.
    return pending.withColumn("bound", bound * (1 + 1e-9) + 1e-12)


def _farthest(columns: list[str]) -> Column:
    """Distance to the farthest corner of a box."""
    sides = [F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high))) for c, low, high in zip(XYZ, columns[:3], columns[3:])]
    return F.sqrt(reduce(lambda a, b: a + b, [s * s for s in sides]))


def nearest_locations(
    locations: DataFrame, k: int, box_rows: int = BOX_ROWS, fan: int = FIRST_FAN, cells: int = CELLS
) -> DataFrame:
    """(loc, ids, dists): the `k` nearest locations of each location, itself included."""
    points, levels = nested_boxes(locations, box_rows, k, cells)
    loc_type = locations.schema["loc"].dataType.simpleString()
    answer = f"loc {loc_type}, ids array<{loc_type}>, dists array<double>"
    first = points.groupBy("box").applyInPandas(_own_box(k), f"box long, x double, y double, z double, {answer}")
    if len(levels) == 1:
        return first.select("loc", "ids", "dists")

    # A box with fewer than k locations bounds nothing itself, the corners of its parent do.
    first = first.join(parents_of_small(levels, k), "box", "left").withColumn("far", _farthest(BOUNDS)).drop(*BOUNDS)
    pending = stage(_with_bound(first.withColumn("visited", F.lit(0)), k), "own-box")

    done: list[DataFrame] = []
    while True:
        sides = [f(c).alias(f"from_{side}_{c}") for side, f in (("low", F.min), ("high", F.max)) for c in XYZ]
        asking = stage(pending.groupBy("box").agg(*sides, F.max("bound").alias("reach")), "asking")
        near = within_reach(asking, levels)
        visits = stage(
            pending.groupBy("box")
            .cogroup(near.groupBy("box"))
            .applyInPandas(
                _next_visits(k, fan),
                f"loc {loc_type}, to_box long, x double, y double, z double, bound double, last boolean",
            ),
            "visits",
        )
        total = visits.count()
        if not total:
            done.append(pending.select("loc", "ids", "dists"))
            break
        done.append(pending.join(visits.select("loc").distinct(), "loc", "left_anti").select("loc", "ids", "dists"))
        load = stage(visits.groupBy("to_box").agg(F.count(F.lit(1)).alias("c")), "visit-load")
        load = load.withColumn("parts", F.ceil(F.col("c") / VISITS_PER_TASK).cast("int"))
        asked = lookup_by_value(visits, load, ["to_box"], F.col("c") * HOT_SHARE >= total, split=True).withColumn(
            "part", F.pmod(F.xxhash64("loc"), F.col("parts").cast("long")).cast("int")
        )
        copies = points.withColumnRenamed("box", "to_box").join(load, "to_box")
        copies = copies.select("loc", *XYZ, "to_box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = (
            asked.groupBy("to_box", "part")
            .cogroup(copies.groupBy("to_box", "part"))
            .applyInPandas(_visit(k), answer)
        )
        last = visits.groupBy("loc").agg(F.bool_and("last").alias("last"))
        old = pending.drop("bound").join(last, "loc")
        merged = (
            old.select("loc", "ids", "dists")
            .unionByName(found)
            .groupBy("loc")
            .agg(F.flatten(F.collect_list(F.arrays_zip("dists", "ids"))).alias("near"))
            .select("loc", F.slice(F.sort_array("near"), 1, k).alias("near"))
            .select("loc", F.col("near.ids").alias("ids"), F.col("near.dists").alias("dists"))
        )
        rest = old.drop("ids", "dists").join(merged, "loc")
        state = stage(_with_bound(rest.withColumn("visited", F.col("visited") + fan), k), "visited")
        done.append(state.where("last").select("loc", "ids", "dists"))
        pending = state.where(~F.col("last")).drop("last")
        fan *= 4
    return reduce(lambda a, b: a.unionByName(b), done)


# ---- benchmark --------------------------------------------------------------------------------


def _median(values: Column, size: int) -> Column:
    ordered = F.sort_array(values)
    return (F.get(ordered, F.lit((size - 1) // 2)) + F.get(ordered, F.lit(size // 2))) / F.lit(2.0)


def _coordinates(df: DataFrame) -> dict[str, Column]:
    return {n: F.log1p(F.greatest(C.number_or_zero(df, a), F.lit(0.0))) for n, a in zip(XYZ, AXES)}


def cloud_peers(
    df: DataFrame,
    cfg: ScoringConfig,
    key: str = "org_id",
    box_rows: int = BOX_ROWS,
    range_rows: int = RANGE_ROWS,
    fan: int = FIRST_FAN,
    cells: int = CELLS,
) -> DataFrame:
    """Compare every filled organisation with its k nearest in the cloud of the three axes. Filled rows
    that repeat a key or have none are an error."""
    k = max(1, int(cfg.min_group_size))
    base = filled_only(df)
    level = F.coalesce(F.col("svk_form_level"), F.lit(0)) if "svk_form_level" in base.columns else F.lit(0)
    name = F.coalesce("org_name", F.lit("None")) if "org_name" in base.columns else F.col(key).cast("string")
    carried = [c for c in CARRIED if c in base.columns]
    rows = base.select(key, *carried, *[c.alias(n) for n, c in _coordinates(base).items()], level.alias("form"))
    points = stage(
        base.select(
            key,
            *[c.alias(n) for n, c in _coordinates(base).items()],
            name.alias("name"),
            level.cast("int").alias("form"),
        ),
        "cloud-points",
    )
    require_unique(points, [key])
    n = points.count()

    locations = stage(_locations(points, key, k + 1), "cloud-locations")
    near = nearest_locations(locations, k + 1, box_rows, fan, cells)
    pairs = near.select("loc", F.explode(F.arrays_zip("ids", "dists")).alias("p")).select(
        "loc", F.col("p.ids").alias("near_loc"), F.col("p.dists").alias("dist")
    )
    theirs = locations.select(F.col("loc").alias("near_loc"), *[F.col(c).alias(f"n{c}") for c in XYZ], "members")
    entry = F.transform(
        "members",
        lambda m: F.struct(
            F.col("dist"), m[key].alias("id"), m["name"].alias("name"), m["form"].alias("form"), *[F.col(f"n{c}").alias(c) for c in XYZ]
        ),
    )
    # At most (k+1)^2 entries per location before the cut to k+1.
    lists = (
        pairs.join(theirs, "near_loc")
        .select("loc", entry.alias("entries"))
        .groupBy("loc")
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("entries"))), 1, k + 1).alias("near"))
    )
    table = locations.select("loc", *XYZ).join(lists, "loc").drop("loc")
    split = n > range_rows
    if split:
        shared = points.groupBy(*XYZ).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HOT_SHARE >= n)
        table = stage(table.join(F.broadcast(shared), XYZ, "left").fillna(0, ["c"]), "cloud-lists")
        joined = lookup_by_value(rows, table, XYZ, F.col("c") > 0, True).drop("c")
    else:
        joined = rows.join(table, XYZ)

    joined = joined.withColumn("near", F.slice(F.filter("near", lambda m: m["id"] != F.col(key)), 1, k))
    skew = {a: F.abs(F.col(c) - _median(F.col(f"near.{c}"), k)) for c, a in zip(XYZ, AXES)}
    largest = F.greatest(*skew.values())
    axis = F.lit(AXES[-1])
    for a in reversed(AXES[:-1]):
        axis = F.when(skew[a] == largest, a).otherwise(axis)
    total = F.aggregate("near.dist", F.lit(0.0), lambda s, d: s + d)
    median = F.bround(_median(F.col("near.form"), k)).cast("int")
    result = stage(
        joined.where(F.lit(n >= k + 1)).select(
            key,
            *carried,
            median.alias("peer_3d_form_median"),
            (F.col("form") - median).cast("int").alias("form_vs_peer_3d"),
            F.bround(largest, 3).alias("profile_skew_3d"),
            axis.alias("profile_skew_3d_axis"),
            F.size("near").alias("peer_3d_group_size"),
            F.bround(total / k, 4).alias("peer_3d_mean_distance"),
            F.concat_ws("; ", "near.name").alias("peer_3d_neighbors"),
            F.transform("near", lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name"), m["dist"].alias("dist"))).alias(
                "neighbors"
            ),
        ),
        "cloud-result",
    )
    # Rounded distances repeat, so the rank table is far smaller than the result it is joined to.
    long = result.select(F.lit("d").alias("name"), F.col("peer_3d_mean_distance").alias("value"))
    ranks = value_percentiles(long, column_sizes(long), range_rows).drop("name")
    ranked = lookup_by_value(
        result, ranks.withColumnRenamed("value", "peer_3d_mean_distance"), ["peer_3d_mean_distance"],
        F.col("c") * HOT_SHARE >= F.col("n"), split, n,
    )
    factor = F.least(F.col("peer_3d_group_size") / F.lit(float(k)), F.lit(1.0))
    return ranked.withColumn("peer_3d_confidence", F.bround(factor * (1 - F.col("pct")), 2)).select(
        *result.columns, "peer_3d_confidence"
    )


# ---- uses of the benchmark --------------------------------------------------------------------


def _reliably_below() -> Column:
    return (F.col("form_vs_peer_3d") <= -1) & (F.col("peer_3d_confidence") >= 0.5)


def priority(peers: DataFrame, key: str = "org_id") -> DataFrame:
    """Organisations whose form is reliably below that of their neighbours."""
    rows = peers.where(_reliably_below()).orderBy("form_vs_peer_3d", F.desc("peer_3d_confidence"), key)
    return present(rows, [key, *PRIORITY_COLUMNS])


def peers_overview(peers: DataFrame) -> DataFrame:
    return peers.agg(
        F.count(F.lit(1)).alias("orgs"),
        F.count_if(_reliably_below()).alias("below_peers"),
        F.avg("peer_3d_confidence").alias("avg_confidence"),
    )


def peer_form_scatter(peers: DataFrame, key: str = "org_id") -> DataFrame:
    rows = peers.dropna(subset=["peer_3d_form_median", "svk_form_level"])
    return present(
        rows,
        [key, "org_name", "peer_3d_form_median", "svk_form_level", "form_vs_peer_3d", "peer_3d_confidence"],
    )


def neighbours_of(peers: DataFrame, org, key: str = "org_id") -> DataFrame:
    """The neighbour list of one organisation, nearest first."""
    one = peers.where(F.col(key) == F.lit(org))
    return one.select(F.posexplode("neighbors").alias("pos", "n")).select(
        (F.col("pos") + 1).alias("rank"), "n.id", "n.name", "n.dist"
    )


def neighbours_of_named(peers: DataFrame, name: str, key: str = "org_id") -> DataFrame:
    """The neighbour lists of all organisations of this display name, nearest first, with their key."""
    return peers.where(F.col("org_name") == F.lit(name)).select(key, F.posexplode("neighbors").alias("pos", "n")).select(
        key, (F.col("pos") + 1).alias("rank"), "n.id", "n.name", "n.dist"
    )


# fixed values: highlight groups
SELECTED, NEIGHBOUR, OTHER = "Выбранная организация", "Соседи", "Прочие"


def highlight(peers: DataFrame, org, key: str = "org_id") -> DataFrame:
    """Tag every organisation as the selected one, one of its k neighbours, or other."""
    near = F.broadcast(neighbours_of(peers, org, key).select(F.col("id").alias(key), F.lit(True).alias("near")))
    tag = F.when(F.col(key) == F.lit(org), SELECTED).when(F.col("near"), NEIGHBOUR).otherwise(OTHER)
    logs = [F.log1p(C.number_or_null(peers, a)).alias(n) for a, n in zip(AXES, ("log_cash", "log_staff", "log_fkhz"))]
    return present(peers.join(near, key, "left").select(key, "org_name", *logs, tag.alias("tag")), [key, "org_name", "log_cash", "log_staff", "log_fkhz", "tag"])
