"""Rasters as blocks of a grid: (raster_id, band, brow, bcol, values), values row by row, null for no data.

A window touches the blocks of an index range, so it meets them by equi-join. Pixels travel as slices of rows,
(window columns, band, r, c, values): the pixels of row r of the window from its column c on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_windows(blocks: DataFrame, windows: DataFrame, side: int, bands: list[int] | None = None) -> DataFrame:
    """Slices of the pixels that each window holds of its raster.

    windows: raster_id, row0, col0, h, w (pixels of the raster, inside it), and any others; side: of the square blocks. Only blocks that a
    window touches are joined, on (raster_id, brow, bcol); blocks at the raster's end are as large as the others. Windows of no
    pixel and windows over missing blocks give nothing there.
    """
    def touched(start: str, length: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / side), F.floor((F.col(start) + F.col(length) - 1) / side)))

    wanted = windows.where("h > 0 AND w > 0").withColumn("brow", touched("row0", "h")).withColumn("bcol", touched("col0", "w"))
    chosen = blocks if bands is None else blocks.where(F.col("band").isin(bands))
    met = wanted.join(chosen.select("raster_id", F.col("brow").cast("long"), F.col("bcol").cast("long"), "band", "values"), ["raster_id", "brow", "bcol"])
    top, left = F.col("brow") * side, F.col("bcol") * side
    first, last = F.greatest(F.col("row0"), top), F.least(F.col("row0") + F.col("h"), top + side) - 1
    c0, c1 = F.greatest(F.col("col0"), left), F.least(F.col("col0") + F.col("w"), left + side)
    rows = met.withColumn("_row", F.explode(F.sequence(first, last)))
    start = ((F.col("_row") - top) * side + (c0 - left) + 1).cast("int")
    return rows.select(*windows.columns, "band", (F.col("_row") - F.col("row0")).alias("r"), (c0 - F.col("col0")).alias("c"), F.slice("values", start, (c1 - c0).cast("int")).alias("values"))


def window_quality(slices: DataFrame, keys: list[str], min_valid: float = 0.35, min_std: float = 5.0, min_contrast: float = 10.0) -> DataFrame:
    """Per window (keys): valid_fraction (pixels with a value in any band), std (population), p2, p98, contrast and passed.

    Statistics are null where too few pixels are valid. Slices of one place are laid over each other for the share; percentiles, which
    interpolate, come from counts of equal values, which add up across blocks: 8-bit data shuffle at most 256 rows a window and task.
    """
    any_band = F.aggregate(
        F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), F.transform(F.col("_all")[0], lambda v: v.isNotNull()),
        lambda a, b: F.zip_with(a, b, lambda x, y: x | y.isNotNull()))
    places = slices.groupBy(*keys, "r", "c").agg(F.collect_list("values").alias("_all")).withColumn("_any", any_band)
    share = places.groupBy(*keys).agg((F.sum(F.size(F.filter("_any", lambda x: x))) / F.sum(F.size("_any"))).alias("valid_fraction"))
    values = slices.select(*keys, F.explode("values").alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    total = values.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("q"),
        F.percentile("v", F.array(F.lit(0.02), F.lit(0.98)), F.col("n")).alias("p"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    both = share.join(total.select(*keys, std.alias("std"), F.col("p")[0].alias("p2"), F.col("p")[1].alias("p98")), keys, "left")
    enough = F.col("valid_fraction") >= min_valid
    rows = both.select(*keys, "valid_fraction", *[F.when(enough, F.col(c)).alias(c) for c in ("std", "p2", "p98")]).withColumn("contrast", F.col("p98") - F.col("p2"))
    return rows.withColumn("passed", F.coalesce((F.col("std") >= min_std) & (F.col("contrast") >= min_contrast), F.lit(False)))


def tile_windows(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Tiles of spatial.tile_grid as windows, cut at the raster's end: raster_id, x0, y0, row0, col0, h, w."""
    sized = tiles.join(rasters.select("raster_id", "width", "height"), "raster_id")
    return sized.select(
        "raster_id", "x0", "y0", F.col("y0").alias("row0"), F.col("x0").alias("col0"),
        F.least(F.col("tile"), F.col("height") - F.col("y0")).alias("h"), F.least(F.col("tile"), F.col("width") - F.col("x0")).alias("w"))


def padded_rows(slices: DataFrame, windows: DataFrame, keys: list[str], bands: list[int]) -> DataFrame:
    """(keys, band, crop_size, r, values): every row of each window, crop_size pixels long, 0 where nothing or no value was read.

    windows: keys, crop_size, top and left: where the read part begins in the window. Each window has its own size.
    """
    size = F.col("crop_size")
    every = windows.select(*keys, "crop_size", "top", "left", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    every = every.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)))
    lines = slices.groupBy(*keys, "band", "r").agg(F.array_sort(F.collect_list(F.struct("c", "values"))).alias("_s"))
    lines = lines.select(*keys, F.col("band").cast("int").alias("band"), F.col("r").cast("long").alias("_r"), F.col("_s")[0]["c"].alias("_c"), F.flatten(F.transform("_s", lambda s: s["values"])).alias("_v"))
    rows = every.withColumn("_r", F.col("r") - F.col("top")).join(lines, [*keys, "band", "_r"], "left")
    before = F.coalesce(F.col("left") + F.col("_c"), F.lit(0)).cast("int")
    read = F.coalesce(F.transform("_v", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), F.array().cast("array<double>"))
    after = (size - before - F.size(read)).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), before), read, F.array_repeat(F.lit(0.0), after))
    return rows.select(*keys, "band", "crop_size", "r", padded.alias("values"))


def resize_nearest(rows: DataFrame, size: int) -> DataFrame:
    """Patches as rows (h, w, r, values, and their keys) to size x size: target (t, u) takes source (floor(t h / size), floor(u w / size)).

    Each patch has its own height and width; nothing is shuffled.
    """
    keys = [c for c in rows.columns if c not in ("h", "w", "r", "values")]
    first, last = F.ceil(F.col("r") * size / F.col("h")), F.ceil((F.col("r") + 1) * size / F.col("h")) - 1
    line = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda u: F.get("values", F.floor(u * F.col("w") / size).cast("int")))
    taken = rows.where(first <= last)
    return taken.select(*keys, F.explode(F.sequence(first, last)).alias("r"), line.alias("values"))


def _tap(t: Column, old: Column, size: int) -> tuple[Column, Column, Column]:
    """The two source places of a target place, clamped, and the weight of the second (half-pixel centres)."""
    at = (t + 0.5) * old / F.lit(float(size)) - 0.5
    low = F.floor(at)
    return F.greatest(low, F.lit(0)).cast("int"), F.least(low + 1, old - 1).cast("int"), at - low


def resize_bilinear(rows: DataFrame, size: int) -> DataFrame:
    """As resize_nearest, with bilinear weights: columns within a row, then rows by the sum of the at most few that a target row takes."""
    keys = [c for c in rows.columns if c not in ("h", "w", "r", "values")]

    def across(u: Column) -> Column:
        a, b, f = _tap(u, F.col("w"), size)
        return F.get("values", a) * (1 - f) + F.get("values", b) * f

    places = F.sequence(F.lit(0), F.lit(size - 1))

    def share(t: Column) -> Column:
        a, b, f = _tap(t, F.col("h"), size)
        return F.when(a == F.col("r"), 1 - f).otherwise(0.0) + F.when(b == F.col("r"), f).otherwise(0.0)

    wide = rows.select(*keys, "h", "r", F.transform(places, across).alias("_line"))
    shares = F.filter(F.transform(places, lambda t: F.struct(t.alias("t"), share(t).alias("f"))), lambda s: s["f"] > 0)
    spread = wide.select(*keys, "_line", F.explode(shares).alias("_s"))
    spread = spread.select(*keys, F.col("_s.t").alias("r"), F.transform("_line", lambda v: v * F.col("_s.f")).alias("_line"))
    zero = F.array_repeat(F.lit(0.0), F.lit(size))
    total = F.aggregate("_lines", zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return spread.groupBy(*keys, "r").agg(F.collect_list("_line").alias("_lines")).select(*keys, "r", total.alias("values"))
