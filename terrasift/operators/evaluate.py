"""Pixel- and object-level evaluation of scores and masks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.sources.scratch import cut_lineage, drop_scratch

from .masks import filled_components, mask_runs
from .sampling import ranked

SMOOTH = 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_argmax(scores: DataFrame, columns: list[str]) -> DataFrame:
    """The class of greatest score, the first of equals, and its softmax probability."""
    all_ = F.array(*columns)
    top = F.array_max(all_)
    prob = 1 / F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return scores.select("sample_id", "idx", (F.array_position(all_, top) - 1).cast("int").alias("pred"), prob.alias("prob"))


def binary_sums(scores: DataFrame, prob: Column, threshold: float) -> DataFrame:
    """Per sample: intersection, predicted and true pixels at prob > threshold."""
    p = prob > threshold
    return scores.groupBy("sample_id").agg(
        F.count_if(p & (F.col("target") == 1)).alias("inter"), F.count_if(p).alias("n_pred"), F.sum("target").alias("n_true"))


def dice(inter: Column, a: Column, b: Column) -> Column:
    return (2 * inter + SMOOTH) / (a + b + SMOOTH)


def iou(inter: Column, a: Column, b: Column) -> Column:
    return (inter + SMOOTH) / (a + b - inter + SMOOTH)


def binary_dice_iou(scores: DataFrame, logit: str = "logit1", threshold: float = 0.5) -> DataFrame:
    s = binary_sums(scores, sigmoid(F.col(logit)), threshold)
    x = (F.col("inter"), F.col("n_pred"), F.col("n_true"))
    return s.agg(F.avg(dice(*x)).alias("dice"), F.avg(iou(*x)).alias("iou"), F.count("*").alias("n"))


def class_sums(mask: DataFrame, class_ids: list[int]) -> DataFrame:
    """(sample_id, class_id, inter, n_pred, n_true) for every sample and class, from one aggregation."""
    made = [F.struct(
        F.lit(k).alias("class_id"), F.count_if((F.col("gt") == k) & (F.col("pred") == k)).alias("inter"),
        F.count_if(F.col("pred") == k).alias("n_pred"), F.count_if(F.col("gt") == k).alias("n_true")).alias(f"_{k}") for k in class_ids]
    per = mask.groupBy("sample_id").agg(*made)
    return per.select("sample_id", F.explode(F.array(*[f"_{k}" for k in class_ids])).alias("s")).select("sample_id", "s.*")


def class_dice_iou(mask: DataFrame, class_ids: list[int]) -> DataFrame:
    """Mean over samples of Dice and IoU per class; a class absent from truth and prediction scores 1."""
    x = (F.col("inter"), F.col("n_pred"), F.col("n_true"))
    return class_sums(mask, class_ids).groupBy("class_id").agg(F.avg(dice(*x)).alias("dice"), F.avg(iou(*x)).alias("iou"))


def fg_iou_per_sample(mask: DataFrame, class_ids: list[int]) -> DataFrame:
    """Mean IoU of the foreground classes that a sample has in truth or prediction; null if none."""
    union = F.nullif(F.col("n_pred") + F.col("n_true") - F.col("inter"), F.lit(0))
    return class_sums(mask, class_ids).groupBy("sample_id").agg(F.avg(F.col("inter") / union).alias("fg_iou"))


def batch_mean_vs_sample_mean(scores: DataFrame, batch: int = 8, logit: str = "logit1") -> DataFrame:
    """The mean of batch means and the mean over samples of Dice; a batch holds so many samples next to each other in order of their ids."""
    s = binary_sums(scores, sigmoid(F.col(logit)), 0.5).withColumn("dice", dice(F.col("inter"), F.col("n_pred"), F.col("n_true")))
    per = ranked(s, ["sample_id"], "_place").groupBy(F.floor(F.col("_place") / batch).alias("b")).agg(F.avg("dice").alias("m"), F.sum("dice").alias("s"), F.count("*").alias("n"))
    return per.agg(F.avg("m").alias("batch_mean"), (F.sum("s") / F.sum("n")).alias("sample_mean"))


def confusion(mask: DataFrame, n_classes: int) -> DataFrame:
    return mask.where(F.col("gt").between(0, n_classes - 1)).groupBy("gt", "pred").agg(F.count("*").alias("n"))


def confusion_normalized(mask: DataFrame, n_classes: int) -> DataFrame:
    row = F.sum("n").over(Window.partitionBy("gt"))
    return confusion(mask, n_classes).withColumn("share", F.col("n") / F.greatest(row, F.lit(1)))


def class_metrics(mask: DataFrame, n_classes: int) -> DataFrame:
    """tp, fp, fn, precision, recall, IoU and Dice per class, from the confusion table."""
    c = confusion(mask, n_classes)
    sides = c.select(F.col("gt").alias("class_id"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("gt") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"))
    other = c.where("gt <> pred").select(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"))
    s = sides.unionByName(other).groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("*", (tp / (tp + fp + SMOOTH)).alias("precision"), (tp / (tp + fn + SMOOTH)).alias("recall"), (tp / (tp + fp + fn + SMOOTH)).alias("iou"), (2 * tp / (2 * tp + fp + fn + SMOOTH)).alias("dice"))


def _steps(scores: DataFrame, prob: Column, thresholds: list[str], extra: list[str]) -> DataFrame:
    """Per sample and threshold: intersection, predicted and true pixels; one scan counts pixels by the last threshold passed."""
    passed = reduce(lambda c, t: c + F.when(prob > F.lit(t).cast("double"), 1).otherwise(0), thresholds, F.lit(0))
    bins = scores.groupBy("sample_id", *extra, passed.alias("bin")).agg(F.count("*").alias("n"), F.sum("target").alias("t"))
    made = []
    for k, t in enumerate(thresholds):
        above = F.col("bin") > k
        made.append(F.struct(F.lit(t).cast("double").alias("threshold"), F.sum(F.when(above, F.col("t")).otherwise(0)).alias("inter"),
                             F.sum(F.when(above, F.col("n")).otherwise(0)).alias("n_pred"), F.sum("t").alias("n_true")).alias(f"_{k}"))
    per = bins.groupBy("sample_id", *extra).agg(*made)
    return per.select("sample_id", *extra, F.explode(F.array(*[f"_{k}" for k in range(len(thresholds))])).alias("s")).select("sample_id", *extra, "s.*")


THRESHOLDS = ["0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7"]


def threshold_sweep(scores: DataFrame, prob: Column, thresholds: list[str] = THRESHOLDS, group: str = "modality") -> DataFrame:
    """Mean Dice and IoU per threshold over all samples (group "all") and per group, with the number of samples."""
    s = _steps(scores, prob, thresholds, [group])
    x = (F.col("inter"), F.col("n_pred"), F.col("n_true"))
    s = s.select("threshold", F.explode(F.array(F.lit("all"), F.col(group))).alias("grp"), dice(*x).alias("d"), iou(*x).alias("i"))
    return s.groupBy("threshold", "grp").agg(F.avg("d").alias("dice"), F.avg("i").alias("iou"), F.count("*").alias("n"))


def ensemble(weights: dict[str, float]) -> Column:
    """Weighted mean of the sigmoids of several logit columns."""
    total = sum(weights.values())
    return reduce(lambda a, b: a + b, [sigmoid(F.col(c)) * F.lit(w / total) for c, w in weights.items()])


def bce_focal_dice(scores: DataFrame, logit: str = "logit1", pos_weight: float = 2.0, alpha: float = 0.75, gamma: float = 2.0, weights: tuple[float, ...] = (0.5, 0.5)) -> DataFrame:
    """Mean binary cross-entropy with logits, focal loss, soft Dice loss (mean over samples), and bce, dice weighted."""
    x, y = F.col(logit), F.col("target").cast("double")
    soft = F.log1p(F.exp(-F.abs(x)))
    minus = soft + F.greatest(-x, F.lit(0.0))  # -log(sigmoid(x))
    plus = soft + F.greatest(x, F.lit(0.0))  # -log(1 - sigmoid(x))
    bce = pos_weight * y * minus + (1 - y) * plus
    p = sigmoid(x)
    pt = y * p + (1 - y) * (1 - p)
    focal = (y * alpha + (1 - y) * (1 - alpha)) * F.pow(1 - pt, F.lit(gamma)) * (y * minus + (1 - y) * plus)
    per = scores.groupBy("sample_id").agg(
        F.sum(bce).alias("bce"), F.sum(focal).alias("focal"), F.count("*").alias("n"), F.sum(p * y).alias("i"), F.sum(p).alias("p"), F.sum(y).alias("t"))
    loss = 1 - (2 * F.col("i") + SMOOTH) / (F.col("p") + F.col("t") + SMOOTH)
    r = per.agg((F.sum("bce") / F.sum("n")).alias("bce"), (F.sum("focal") / F.sum("n")).alias("focal"), F.avg(loss).alias("dice_loss"))
    return r.withColumn("total", weights[0] * F.col("bce") + weights[1] * F.col("dice_loss"))


def weighted_ce(scores: DataFrame, columns: list[str], label: Column, class_weights: list[float]) -> DataFrame:
    """Cross-entropy of softmax over columns, weighted by the weight of the true class."""
    all_ = F.array(*columns)
    top = F.array_max(all_)
    lse = top + F.log(F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    w = F.get(F.array(*[F.lit(float(v)) for v in class_weights]), label)
    return scores.agg((F.sum(w * (lse - F.get(all_, label))) / F.sum(w)).alias("ce"))


def multiclass_dice_loss(scores: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """One minus the mean soft Dice of the classes but the first, over all pixels at once."""
    all_ = F.array(*columns)
    top = F.array_max(all_)
    total = F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    sums = []
    for k in range(1, len(columns)):
        p, y = F.exp(F.col(columns[k]) - top) / total, (label == k).cast("double")
        sums.append(((2 * F.sum(p * y) + SMOOTH) / (F.sum(p) + F.sum(y) + SMOOTH)))
    return scores.agg((1 - reduce(lambda a, b: a + b, sums) / len(sums)).alias("dice_loss"))


def eval_objects(mask: DataFrame, min_area: float = 8.0) -> DataFrame:
    """Objects of truth and prediction with side and confidence 1, as runs: (side, sample_id, class_id, comp, row, c0, c1, pixels, area).

    Holes are filled, and only objects whose contour has min_area count (see masks.filled_components).
    """
    truth, pred = mask_runs(mask, "gt").withColumn("side", F.lit("truth")), mask_runs(mask, "pred").withColumn("side", F.lit("pred"))
    return filled_components(truth.unionByName(pred), min_area, ("side", "class_id")).withColumn("confidence", F.lit(1.0))


def object_iou(objects: DataFrame) -> DataFrame:
    """(sample_id, class_id, p, t, iou, hit, confidence) of predicted and true objects that share a pixel, or whose predicted centroid hits.

    Objects without a column confidence have 1.
    """
    key = ["sample_id", "class_id"]
    if "confidence" not in objects.columns:
        objects = objects.withColumn("confidence", F.lit(1.0))
    t = objects.where("side = 'truth'").select(*key, F.col("comp").alias("t"), "row", F.col("c0").alias("t0"), F.col("c1").alias("t1"), F.col("pixels").alias("nt"))
    p = objects.where("side = 'pred'").select(*key, F.col("comp").alias("p"), "row", "c0", "c1", F.col("pixels").alias("np"), "confidence")
    share = t.join(p, [*key, "row"]).where("t0 < c1 AND c0 < t1")
    share = share.groupBy(*key, "p", "t").agg(
        F.sum(F.least("c1", "t1") - F.greatest("c0", "t0")).alias("inter"), F.first("np").alias("np"), F.first("nt").alias("nt"), F.first("confidence").alias("confidence"))
    n = F.col("c1") - F.col("c0")
    centre = p.groupBy(*key, "p").agg(
        F.floor(F.sum(F.col("row") * n) / F.sum(n) + 0.5).cast("int").alias("row"), F.floor(F.sum((F.col("c0") + F.col("c1") - 1) * n / 2) / F.sum(n) + 0.5).alias("x"),
        F.first("confidence").alias("_c"))
    hits = centre.join(t, [*key, "row"]).where("x >= t0 AND x < t1").select(*key, "p", "t", "_c").distinct().withColumn("hit", F.lit(True))
    both = share.join(hits, [*key, "p", "t"], "full")
    value = F.coalesce(F.col("inter") / (F.col("np") + F.col("nt") - F.col("inter")), F.lit(0.0))
    return both.select(*key, "p", "t", value.alias("iou"), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("confidence", "_c").alias("confidence"))


def _serial(table: pa.Table) -> pa.Table:
    """The serial matching of one sample: predictions of each class by confidence, then number, each with its best free truth."""
    order = np.lexsort((table["t"].to_numpy(), -table["iou"].to_numpy(), table["p"].to_numpy(), -table["confidence"].to_numpy(), table["class_id"].to_numpy()))
    used: set[tuple] = set()
    taken = []
    for at, c, p, t in zip(order.tolist(), *(table[x].take(pa.array(order)).to_pylist() for x in ("class_id", "p", "t"))):
        if (c, "p", p) not in used and (c, "t", t) not in used:
            used |= {(c, "p", p), (c, "t", t)}
            taken.append(at)
    return table.take(pa.array(taken, pa.int64())).select(["sample_id", "class_id", "p", "t", "iou"])


def soft_match(objects: DataFrame, least_iou: float = 0.3, pool: bool = False) -> DataFrame:
    """(sample_id, class_id, p, t, iou): predictions in order take their best free truth with IoU above least_iou or a hit.

    The order is by confidence, the greatest first, then by number; of equal truths the first is taken. Objects match within their
    sample, the work of one group. pool gives all samples one key, as if they lay on one image: there is no bounded group
    then, and the same order is kept by rounds: a pair is final when the truth is the prediction's best free one and no
    earlier free prediction still has that truth as a candidate. Rounds end when nothing is free.
    """
    key = ["sample_id", "class_id"]
    if pool:
        kind = dict(objects.dtypes)["sample_id"]
        objects = objects.withColumn("comp", F.col("sample_id").cast("long") * (1 << 24) + F.col("comp")).withColumn("sample_id", F.lit(0).cast(kind))
    c = object_iou(objects).where((F.col("iou") > least_iou) | F.col("hit")).select(*key, "p", "t", "iou", "confidence")
    if not pool:
        kinds = dict(c.dtypes)
        return c.groupBy("sample_id").applyInArrow(_serial, ", ".join(f"{n} {kinds[n]}" for n in (*key, "p", "t", "iou")))
    turn = F.struct(-F.col("confidence"), F.col("p"))
    left, done = cut_lineage(c.withColumn("turn", turn)), None
    while not left.isEmpty():
        best = F.row_number().over(Window.partitionBy(*key, "p").orderBy(F.desc("iou"), "t")) == 1
        first = F.min("turn").over(Window.partitionBy(*key, "t")) == F.col("turn")
        final = cut_lineage(left.withColumn("_b", best).withColumn("_f", first).where("_b AND _f").select(*key, "p", "t", "iou"))
        done = final if done is None else done.unionByName(final)
        rest = cut_lineage(left.join(final.select(*key, "p"), [*key, "p"], "left_anti").join(final.select(*key, "t"), [*key, "t"], "left_anti").select(left.columns))
        drop_scratch(left)
        left = rest
    return done if done is not None else left.select(*key, "p", "t", "iou")


def match_counts(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """tp, fp and fn per class."""
    n = objects.select("side", "sample_id", "class_id", "comp").distinct().groupBy("class_id").agg(
        F.count_if(F.col("side") == "truth").alias("n_true"), F.count_if(F.col("side") == "pred").alias("n_pred"))
    tp = pairs.groupBy("class_id").agg(F.count("*").alias("tp"))
    rows = n.join(tp, "class_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return rows.select("class_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"))


# Weights of the classes 1 to 5 in the combined F1.
F1_WEIGHTS = {1: 27.8, 2: 22.2, 3: 16.7, 4: 11.1, 5: 5.6}


def class_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", (2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))).alias("f1"))


def weighted_f1(counts: DataFrame, weights: dict[int, float] = F1_WEIGHTS) -> DataFrame:
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("class_id").cast("int"))
    return class_f1(counts).agg((F.sum(F.col("f1") * w) / F.sum(w)).alias("weighted_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def largest_part(parts: DataFrame) -> DataFrame:
    """The part of greatest area per object, the first of equals, with confidence 1 where the text is no number."""
    best = F.max_by(F.struct("part_id", "area"), F.struct("area", -F.col("part_id")))
    rows = parts.groupBy("object_id").agg(best.alias("b"), F.first("confidence").alias("c"))
    return rows.select("object_id", "b.part_id", "b.area", F.coalesce(F.col("c").try_cast("double"), F.lit(1.0)).alias("confidence"))
