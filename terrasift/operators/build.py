"""Training sets from windows and objects: the steps between a matched object and its mask as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.sources.scratch import cut_lineage

from . import masks, spatial


def segmentation_samples(windows: DataFrame, layer: DataFrame, on: list[str], class_ids: list[int], rule: str = "small") -> DataFrame:
    """One row a window: crop_size, n_objects (all that meet it), pixels of each class and of the background, classes, reason.

    windows: sample_id, on, crop_size, c0, r0, px, x_left, y_top; layer: on, ord, class_id (null: not labelled), area, rings, cx, cy, hw, hh.
    reason is no_polygons, no_labelled_polygon or empty_mask for samples to be left out, else null. segmentation_masks gives the masks themselves.

    Windows that share a pixel grid (px, x_left, y_top) are cut from one canvas, which is painted once; windows in one place are one until the
    end, and so are objects of one shape in one place, of which the last labelled one covers the others. Pairs are only counted.
    """
    pixels, shape = ["px", "x_left", "y_top"], ["area", "rings", "cx", "cy", "hw", "hh"]
    windows = spatial.gathered(windows.select("sample_id", *on, "crop_size", "c0", "r0", *pixels), "sample_id")
    windows = cut_lineage(windows.withColumnRenamed("sample_id", "members").withColumn("sample_id", F.col("members")[0]))
    last = F.when(F.col("class_id").isNotNull(), F.col("ord"))
    layer = cut_lineage(layer.groupBy(*on, *shape).agg(
        F.count("*").alias("n_copies"), F.count("class_id").alias("n_labelled"), F.max_by("class_id", last).alias("class_id"), F.max(last).alias("ord")))

    pairs = spatial.window_pairs(windows.drop("members"), layer.drop("class_id", "ord", "area"), on)
    counts = pairs.groupBy("sample_id").agg(F.sum("n_copies").alias("n"), F.sum("n_labelled").alias("labelled"))

    far = F.greatest(*[F.max(F.col(c) + F.col("crop_size")) - F.min(c) for c in ("c0", "r0")])
    canvases = cut_lineage(windows.groupBy(*on, *pixels).agg(F.min("sample_id").alias("canvas"), F.min("c0").alias("left"), F.min("r0").alias("top"), far.alias("side")))
    whole = canvases.select(F.col("canvas").alias("sample_id"), *on, F.col("side").alias("crop_size"), F.col("left").alias("c0"), F.col("top").alias("r0"), *pixels)
    shapes = spatial.window_pairs(whole, layer.where("n_labelled > 0").drop("n_copies", "n_labelled"), on)
    painted = segmentation_masks(cut_lineage(shapes.select("sample_id", "crop_size", "ord", "class_id", "area", "rings")), rule)
    placed = windows.join(canvases, [*on, *pixels]).select("sample_id", "canvas", (F.col("c0") - F.col("left")).alias("c0"), (F.col("r0") - F.col("top")).alias("r0"), "crop_size")
    found = cut_lineage(masks.window_pixels(painted, placed))

    stats = masks.mask_stats(found.select("sample_id", "class_id", F.lit(0).alias("c0"), F.col("pixels").alias("c1")), windows, class_ids)
    rows = stats.join(windows.select("sample_id", "members"), "sample_id").join(counts, "sample_id", "left")
    rows = rows.withColumn("painted", F.when(F.col("classes") != "", True))
    return rows.select(F.explode("members").alias("sample_id"), *stats.columns[1:], F.coalesce("n", F.lit(0)).alias("n_objects"), masks.reject_reason().alias("reason"))


def segmentation_masks(pairs: DataFrame, rule: str = "small") -> DataFrame:
    """Painted runs (sample_id, row, c0, c1, class_id) of the labelled objects of windows (pairs of spatial.window_pairs, a written table)."""
    return masks.paint(masks.polygon_runs(pairs.where("class_id IS NOT NULL"), "crop_size", spread=True), rule)
