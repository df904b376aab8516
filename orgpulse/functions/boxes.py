"""A tree of boxes of any size over distinct points in space, kept as tables.

A box with too many points is cut into at most `cells` boxes, from a bounded sample of its own points; the
first cut is made on the driver, all later ones on the executors, every overfull box by a task of its own.
Each level is a table with one row a box, so neither the driver nor a task ever holds all boxes. The sample
only balances the work; the bounds of a box are those of its points.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.space import CellTree, build_tree
from orgpulse.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Boxes that one cut makes at most; also the rows of the first level, the only one that is broadcast.
CELLS = 4_096
SAMPLE_PER_BOX = 32
# Points of an overfull box that one task sorts into its parts.
POINTS_PER_TASK = 200_000
_HASHES = 1 << 20

XYZ = ("x", "y", "z")
BOUNDS = [f"{side}_{c}" for side in ("low", "high") for c in XYZ]


def _depth(n: float, box_rows: int, cells: int) -> int:
    """Levels of cuts inside one split of `n` points."""
    return max(1, min(math.ceil(math.log2(max(n / box_rows, 2))), int(math.log2(cells))))


def _sampled(points: DataFrame, share: Column) -> DataFrame:
    """The same rows whenever a task is run again."""
    return points.where(F.pmod(F.xxhash64("loc"), F.lit(_HASHES)) < share * _HASHES)


def _bounds() -> list[Column]:
    return [f(c).alias(f"{side}_{c}") for side, f in (("low", F.min), ("high", F.max)) for c in XYZ]


def _first_cut(points: DataFrame, n: int, box_rows: int, cells: int) -> DataFrame:
    depth = _depth(n, box_rows, cells)
    sample = _sampled(points, F.lit(min(1.0, SAMPLE_PER_BOX * 2**depth / n))).select(*XYZ)
    tree = build_tree(sample.toPandas().to_numpy(dtype=float), depth)

    @F.pandas_udf("long")
    def child(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(1 + tree.leaf_of(np.column_stack([x, y, z])))

    return points.withColumn("box", child(*XYZ))


def _tree_of_box(box_rows: int, cells: int):
    def build(sample: pd.DataFrame) -> pd.DataFrame:
        first = sample.iloc[0]
        sample = sample.sort_values("loc")
        tree = build_tree(sample[list(XYZ)].to_numpy(dtype=float), _depth(first["n"], box_rows, cells))
        return pd.DataFrame({"box": [int(first["box"])], "n": [int(first["n"])], "axis": [tree.axis], "cut": [tree.cut]})

    return build


def _placed(cells: int):
    def place(points: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        # A box without a sampled point stays whole.
        if len(points) and len(trees):
            tree = CellTree(np.asarray(trees["axis"].iloc[0]), np.asarray(trees["cut"].iloc[0]))
            leaf = tree.leaf_of(points[list(XYZ)].to_numpy(dtype=float))
            points = points.assign(box=points["box"] * cells + 1 + leaf)
        return points[["loc", *XYZ, "box"]]

    return place


def _next_cut(points: DataFrame, overfull: DataFrame, box_rows: int, cells: int) -> DataFrame:
    """Points of overfull boxes get a box inside theirs, all others keep their own.

    Boxes come from balanced cuts, so the join by box has no hot key of its own; a box still far too large
    is dealt over tasks of `POINTS_PER_TASK` points, each with a copy of the box's small tree."""
    marked = stage(points.join(overfull.select("box", "n"), "box", "left"), "marked")
    inside = marked.where(F.col("n").isNotNull())
    parts = F.ceil(F.col("n") / POINTS_PER_TASK)
    leaves = F.least(F.lit(float(cells)), 2 * F.col("n") / box_rows)
    trees = (
        _sampled(inside, F.least(F.lit(1.0), SAMPLE_PER_BOX * leaves / F.col("n")))
        .groupBy("box")
        .applyInPandas(_tree_of_box(box_rows, cells), "box long, n long, axis array<long>, cut array<double>")
    )
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = inside.withColumn("part", F.pmod(F.xxhash64("loc"), parts))
    loc_type = points.schema["loc"].dataType.simpleString()
    placed = (
        dealt.groupBy("box", "part")
        .cogroup(trees.groupBy("box", "part"))
        .applyInPandas(_placed(cells), f"loc {loc_type}, x double, y double, z double, box long")
    )
    return marked.where(F.col("n").isNull()).select("loc", *XYZ, "box").unionByName(placed)


def nested_boxes(points: DataFrame, box_rows: int, least: int, cells: int = CELLS) -> tuple[DataFrame, list[DataFrame]]:
    """(points with `box`, levels): boxes of at most about twice `box_rows` of the distinct points
    (loc, x, y, z), `cells` being a power of two.

    Every level is a table (box, parent, n, low_x .. high_z, split) of the boxes made by one round of cuts,
    the first one the box of all points; a box that is split has its parts in the next level. Only boxes of
    more than `least` points are split. Box numbers are those of a heap, parents follow from them."""
    most = max(2 * box_rows, least)
    points = points.select("loc", *XYZ, F.lit(0).cast("long").alias("box"))
    levels: list[DataFrame] = []
    first, width = 0, 1
    while True:
        made = points.where(F.col("box") >= first).groupBy("box").agg(F.count(F.lit(1)).alias("n"), *_bounds())
        # Past the range of box numbers boxes stay as large as they are, which costs time only.
        more = first + width + width * cells < 2**63
        parent = F.expr(f"(box - 1) div {cells}")
        made = stage(made.select("box", parent.alias("parent"), "n", *BOUNDS, ((F.col("n") > most) & F.lit(more)).alias("split")), "boxes")
        levels.append(made)
        overfull = made.where("split")
        if len(levels) == 1:
            root = overfull.first()
            if root is None:
                return points, levels
            points = _first_cut(points, root["n"], box_rows, cells)
        elif overfull.isEmpty():
            return points, levels
        else:
            points = _next_cut(points, overfull, box_rows, cells)
        points = stage(points, "boxed")
        first, width = first + width, width * cells


def parents_of_small(levels: Sequence[DataFrame], least: int) -> DataFrame:
    """(box, low_x .. high_z): undivided boxes of fewer than `least` points with the bounds of their parent,
    which has more."""
    found = []
    for upper, lower in zip(levels, levels[1:]):
        small = lower.where((F.col("n") < least) & ~F.col("split")).select("box", F.col("parent").alias("up"))
        found.append(small.join(upper.select(F.col("box").alias("up"), *BOUNDS), "up").drop("up"))
    return reduce(DataFrame.unionByName, found)


def _gap() -> Column:
    """Distance between the bounds asked from (`from_` columns) and those of a box."""
    apart = [
        F.greatest(F.col(f"low_{c}") - F.col(f"from_high_{c}"), F.col(f"from_low_{c}") - F.col(f"high_{c}"), F.lit(0.0))
        for c in XYZ
    ]
    return F.sqrt(reduce(lambda a, b: a + b, [a * a for a in apart]))


def within_reach(asked: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """(box, to_box, low_x .. high_z): the undivided boxes, other than its own, within `reach` of the bounds
    (box, from_low_x .. from_high_z, reach). Level by level only the parts of boxes within reach are looked at."""
    open_, found = asked.withColumn("up", F.lit(0).cast("long")), []
    for no, level in enumerate(levels[1:], start=1):
        parts = level.select(F.col("parent").alias("up"), F.col("box").alias("to_box"), *BOUNDS, "split")
        # The first level has at most `cells` rows.
        near = open_.join(F.broadcast(parts) if no == 1 else parts, "up").where(_gap() <= F.col("reach"))
        if no < len(levels) - 1:
            near = stage(near, "reach")
        found.append(near.where(~F.col("split") & (F.col("to_box") != F.col("box"))).select("box", "to_box", *BOUNDS))
        open_ = near.where("split").select(*asked.columns, F.col("to_box").alias("up"))
    return reduce(DataFrame.unionByName, found)
