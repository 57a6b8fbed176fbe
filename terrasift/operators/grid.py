"""Pairs of boxes that meet, by equi-join on cells of a grid whose cells fit the larger box of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of the cells as powers of two. A box belongs to the first level whose cells are as large as its longer side.
LEVELS = (5, 8, 11, 14, 17, 20, 26)

Box = tuple[Column, Column, Column, Column]  # x0, y0, x1, y1


def _level(box: Box) -> Column:
    """The level that a box belongs to."""
    side = F.greatest(box[2] - box[0], box[3] - box[1])
    fits = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        fits = F.when(side <= float(2**level), level).otherwise(fits)
    return fits


def levels_of(boxes: DataFrame, box: Box) -> list[int]:
    """The levels that the boxes of a frame belong to, read by a job of its own; at most as many as LEVELS."""
    return sorted(r[0] for r in boxes.select(_level(box).alias("l")).distinct().collect())


def _entries(boxes: DataFrame, prefix: str, own_slots: tuple[int, ...], up_slots: tuple[int, ...], others: list[int] | None = None) -> DataFrame:
    """Boxes with one row for each cell that they touch at their own level and at all coarser ones: _slot, _cell, _gx, _gy.

    At no level does a box touch more than 2 x 2 cells, but for boxes of more than the last level's side. others: the levels of
    the boxes to be met; only coarser levels of these, and the own one if some of these are as fine, are entered.
    """
    x0, y0, x1, y1 = (F.col(f"_{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))
    own = F.col("_own")

    def needed(level: Column) -> Column:
        if others is None:
            return level >= own
        return ((level == own) & F.lit(min(others, default=99)).__le__(own)) | ((level > own) & level.isin(others))

    levels = F.filter(F.array(*[F.lit(level) for level in LEVELS]), needed)
    rows = boxes.where((x1 - x0 + y1 - y0).isNotNull()).withColumn("_own", _level((x0, y0, x1, y1))).withColumn("_level", F.explode(levels))
    slots = F.when(F.col("_level") == F.col("_own"), F.array(*[F.lit(s) for s in own_slots])).otherwise(F.array(*[F.lit(s) for s in up_slots]))
    rows = rows.withColumn("_slot", F.explode(slots)).withColumn("_cell", F.pow(F.lit(2.0), F.col("_level")))
    for axis, low, high in (("_gx", x0, x1), ("_gy", y0, y1)):
        rows = rows.withColumn(axis, F.explode(F.sequence(F.floor(low / F.col("_cell")), F.floor(high / F.col("_cell")))))
    return rows.drop("_own", "_level")


def box_pairs(left: DataFrame, left_box: Box, right: DataFrame, right_box: Box, on: list[str], right_levels: list[int] | None = None) -> DataFrame:
    """Rows of left and right, equal in the columns `on`, whose boxes share a point (borders count); column names must differ otherwise.

    A pair meets at the level of its larger box: the left box in its own level's cells meets right boxes of that level and
    smaller ones entered there (slot 0), and the other way round (slot 1). Two boxes entered above their level never meet, so
    a coarse cell full of small boxes costs nothing by itself. Of the cells that a pair shares, the one with the lower left
    corner of its intersection counts. Null boxes meet nothing. right_levels (levels_of the right boxes), if known, spare
    left boxes the cells of other levels.
    """
    def boxed(frame: DataFrame, prefix: str, box: Box) -> DataFrame:
        return frame.select("*", *[c.cast("double").alias(f"_{prefix}{n}") for c, n in zip(box, ("x0", "y0", "x1", "y1"))])

    a = _entries(boxed(left, "a", left_box), "a", (0,), (1,), right_levels)
    b = _entries(boxed(right, "b", right_box), "b", (0, 1), (0,))
    # left: own level in slot 0, coarser ones in slot 1; right: own level in both, coarser ones in slot 0, of which slot 1 holds
    # no pair of one level again, as the left box is above its own level there
    met = a.join(b, [*on, "_slot", "_cell", "_gx", "_gy"])
    meet = (F.col("_ax0") <= F.col("_bx1")) & (F.col("_bx0") <= F.col("_ax1")) & (F.col("_ay0") <= F.col("_by1")) & (F.col("_by0") <= F.col("_ay1"))
    mine = (F.floor(F.greatest("_ax0", "_bx0") / F.col("_cell")) == F.col("_gx")) & (F.floor(F.greatest("_ay0", "_by0") / F.col("_cell")) == F.col("_gy"))
    return met.where(meet & mine).drop("_slot", "_cell", "_gx", "_gy", *[f"_{p}{c}" for p in "ab" for c in ("x0", "y0", "x1", "y1")])
