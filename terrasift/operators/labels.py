"""Box label text: parsing, checking, formatting, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_labels(lines: DataFrame, remap: dict[int, int] | None = None) -> DataFrame:
    """(image, cls, xc, yc, w, h) of the lines with exactly five tokens; with remap only its classes, renamed."""
    def read(t: Column) -> Column:
        return F.struct(t[0].try_cast("int").alias("cls"), *[t[k + 1].try_cast("double").alias(c) for k, c in enumerate(("xc", "yc", "w", "h"))])

    # a generator: filters on its columns stay above it, so that a line is split once, not once in every condition
    tokens = F.filter(F.array(F.split(F.trim("line"), " +")), lambda t: F.size(t) == 5)
    rows = lines.select("image", F.inline(F.transform(tokens, read)))
    if remap is not None:
        new = F.element_at(F.create_map(*[F.lit(x) for kv in remap.items() for x in kv]), F.col("cls"))
        rows = rows.withColumn("cls", new).where("cls IS NOT NULL")
    return rows


def valid_box() -> Column:
    inside = F.lit(True)
    for c in ("xc", "yc"):
        inside &= F.col(c).between(0, 1)
    for c in ("w", "h"):
        inside &= (F.col(c) > 0) & (F.col(c) <= 1)
    return F.coalesce(inside, F.lit(False))


def bad_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("image").agg(F.count("*").alias("n_boxes"), F.count_if(~valid_box()).alias("n_bad"))


def format_labels(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(image, text): its boxes as sorted lines with six decimals; the empty text for images without boxes."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "xc", "yc", "w", "h")
    text = boxes.groupBy("image").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return images.select("image").distinct().join(text, "image", "left").select("image", F.coalesce("text", F.lit("")).alias("text"))


def decode_boxes(boxes: DataFrame, size: int = 1024) -> DataFrame:
    """Corners, sides and area in pixels, rounded to one decimal."""
    x, y, w, h = (F.col(c) * size for c in ("xc", "yc", "w", "h"))
    return boxes.select("image", "cls", F.round(x - w / 2, 1).alias("x1"), F.round(y - h / 2, 1).alias("y1"), F.round(x + w / 2, 1).alias("x2"),
                        F.round(y + h / 2, 1).alias("y2"), F.round(w, 1).alias("bw"), F.round(h, 1).alias("bh"), F.round(w * h, 1).alias("area"))


def zoom_extent(decoded: DataFrame, size: int = 1024) -> DataFrame:
    """Per image the hull of its boxes and max(30, 15 percent of its side) around, inside the image."""
    hull = decoded.groupBy("image").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    mx, my = F.greatest(F.lit(30.0), 0.15 * (F.col("c") - F.col("a"))), F.greatest(F.lit(30.0), 0.15 * (F.col("d") - F.col("b")))
    low = lambda v: F.round(F.greatest(F.lit(0.0), v), 3)
    high = lambda v: F.round(F.least(F.lit(float(size)), v), 3)
    return hull.select("image", low(F.col("a") - mx).alias("zx0"), low(F.col("b") - my).alias("zy0"), high(F.col("c") + mx).alias("zx1"), high(F.col("d") + my).alias("zy1"))
