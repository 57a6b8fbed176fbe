"""Statistics and transforms of raster blocks (tile_id, band, idx, v; null v is no data) and of patches of values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tile_stats(blocks: DataFrame) -> DataFrame:
    """Per tile: share of pixels with a value in any band, population deviation, p2 and p98 of all values.

    Percentiles interpolate and come from counts of equal values, so a tile of 8-bit data shuffles at most 256 rows.
    """
    pixel = blocks.groupBy("tile_id", "idx").agg(F.bool_or(F.col("v").isNotNull()).alias("valid"))
    share = pixel.groupBy("tile_id").agg((F.count_if("valid") / F.count("*")).alias("valid_fraction"))
    values = blocks.where("v IS NOT NULL").groupBy("tile_id", "v").agg(F.count("*").alias("n"))
    total = values.groupBy("tile_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("q"),
        F.percentile("v", F.array(F.lit(0.02), F.lit(0.98)), F.col("n")).alias("p"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return share.join(total.select("tile_id", mean.alias("mean"), std.alias("std"), F.col("p")[0].alias("p2"), F.col("p")[1].alias("p98")), "tile_id", "left")


def tile_quality(blocks: DataFrame, min_valid: float = 0.35, min_std: float = 5.0, min_contrast: float = 10.0) -> DataFrame:
    """tile_stats (null where too few pixels are valid) with contrast and the verdict."""
    s = tile_stats(blocks)
    enough = F.col("valid_fraction") >= min_valid
    kept = [F.when(enough, F.col(c)).alias(c) for c in ("std", "p2", "p98")]
    rows = s.select("tile_id", "valid_fraction", *kept).withColumn("contrast", F.col("p98") - F.col("p2"))
    return rows.withColumn("passed", F.coalesce((F.col("std") >= min_std) & (F.col("contrast") >= min_contrast), F.lit(False)))


def contrast_stretch(blocks: DataFrame) -> DataFrame:
    """Adds u in [0, 1] and byte 0 to 255 (truncated): p2 to p98 of each tile and band; 0 for no data or no contrast."""
    p = blocks.where("v IS NOT NULL").groupBy("tile_id", "band").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    rows = blocks.join(p, ["tile_id", "band"], "left")
    lo, hi = F.col("p")[0], F.col("p")[1]
    u = F.when(F.col("v").isNull() | lo.isNull() | (hi <= lo), F.lit(0.0)).otherwise(F.least(F.greatest((F.col("v") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    return rows.select("tile_id", "band", "idx", u.alias("u")).withColumn("byte", F.floor(F.round(F.col("u") * 255, 6)).cast("int"))


def to_rgb(blocks: DataFrame) -> DataFrame:
    """(tile_id, idx, r, g, b): the first three bands; one band is used thrice, two leave the third 0."""
    wide = blocks.groupBy("tile_id", "idx").agg(F.array_sort(F.collect_list(F.struct("band", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("b"))
    n, at = F.size("b"), lambda k: F.get(F.col("b"), F.lit(k))["v"]
    return wide.select("tile_id", "idx", at(0).alias("r"), F.when(n == 1, at(0)).otherwise(at(1)).alias("g"),
                       F.when(n == 1, at(0)).when(n == 2, F.lit(0.0)).otherwise(at(2)).alias("b"))


def normalize_patch(pixels: DataFrame, mode: str, value: str = "logit1", key: str = "sample_id") -> DataFrame:
    """Adds out: z-scores (population deviation, 1 if below 1e-6), min-max (0 if the range is below 1e-6), or the value."""
    patch = Window.partitionBy(key)
    v = F.col(value)
    if mode == "zscore":
        std = F.stddev_pop(v).over(patch)
        out = (v - F.avg(v).over(patch)) / F.when(std < 1e-6, F.lit(1.0)).otherwise(std)
    elif mode == "minmax":
        low, high = F.min(v).over(patch), F.max(v).over(patch)
        out = F.when(high - low < 1e-6, F.lit(0.0)).otherwise((v - low) / (high - low))
    elif mode == "none":
        out = v
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return pixels.withColumn("out", out)


def resize_nearest(mask: DataFrame, old: int, new: int, value: str = "gt") -> DataFrame:
    """Masks of old x old to new x new pixels: target pixel (r, c) takes source (floor(r old / new), floor(c old / new))."""
    grid = mask.sparkSession.range(new).select(F.col("id").alias("t"), F.floor(F.col("id") * old / new).alias("s"))
    r, c = grid.toDF("out_row", "row"), grid.toDF("out_col", "col")
    rows = mask.join(F.broadcast(r), "row").join(F.broadcast(c), "col")
    return rows.select("sample_id", "out_row", "out_col", F.col(value).alias("value"))


def _taps(mask: DataFrame, old: int, new: int) -> DataFrame:
    """(t, s, w): the two source places of each target place with weights, half-pixel centres, clamped at the border."""
    at = (F.col("id") + 0.5) * F.lit(float(old)) / F.lit(float(new)) - 0.5
    low = F.floor(at)
    both = F.array(F.struct(low.alias("s"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("s"), (at - low).alias("w")))
    rows = mask.sparkSession.range(new).select(F.col("id").alias("t"), F.explode(both).alias("x"))
    return rows.select("t", F.least(F.greatest(F.col("x.s"), F.lit(0)), F.lit(old - 1)).alias("s"), F.col("x.w").alias("w"))


def resize_bilinear(mask: DataFrame, old: int, new: int, value: str = "gt") -> DataFrame:
    taps = _taps(mask, old, new)
    r, c = taps.toDF("out_row", "row", "wr"), taps.toDF("out_col", "col", "wc")
    rows = mask.join(F.broadcast(r), "row").join(F.broadcast(c), "col")
    return rows.groupBy("sample_id", "out_row", "out_col").agg(F.sum(F.col(value) * F.col("wr") * F.col("wc")).alias("value"))


def read_window(blocks: DataFrame, windows: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """Pixels of 16 x 16 tiles inside windows (tile_id, row0, col0, h, w), by the window's row numbers and tile."""
    rows = blocks if bands is None else blocks.where(F.col("band").isin(bands))
    rows = rows.withColumn("row", F.floor(F.col("idx") / 16).cast("int")).withColumn("col", (F.col("idx") % 16).cast("int"))
    wanted = windows.withColumn("row", F.explode(F.expr("sequence(row0, row0 + h - 1)")))
    joined = wanted.join(rows, ["tile_id", "row"]).where("col >= col0 AND col < col0 + w")
    return joined.select("tile_id", "band", (F.col("row") - F.col("row0")).alias("r"), (F.col("col") - F.col("col0")).alias("c"), "v")


def pad_patch(patch: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Every (r, c) of a size x size window per key, with 0 where the patch has no pixel or no value."""
    side = patch.sparkSession.range(size)
    full = patch.select(*keys).distinct().crossJoin(F.broadcast(side.toDF("r"))).crossJoin(F.broadcast(side.toDF("c")))
    return full.join(patch, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def empty_rasters(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("tile_id", "band").agg(F.count_if(F.col("v").isNotNull()).alias("n_valid"), F.count("*").alias("n")).withColumn("empty", F.col("n_valid") == 0)


def patch_hook(pixels: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a function of the user's own over Arrow batches of a patch table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield hook(batch)

    return pixels.mapInPandas(run, schema)


