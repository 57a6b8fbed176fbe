"""Sampling, splits, numbering and their audits; no result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.names import draw
from terrasift.sources.scratch import cut_lineage


def negative_sampling(df: DataFrame, positive: Column, key: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """All positive rows, and negative ones whose draw is below share."""
    return df.where(positive | (draw(F.col(key), seed) < share))


def region_split(regions: DataFrame, key: str = "region_id", val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Regions with split val (the first max(1, floor(n * val_share)) in order of their draws) or train; one row a region."""
    n_val = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) * F.lit(val_share)))
    rank = F.row_number().over(Window.orderBy(draw(F.col(key), seed), key))
    return regions.withColumn("split", F.when(rank <= n_val, "val").otherwise("train"))


def holdout(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in held, the others)."""
    keys = held.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its place from 0 in the order of keys, without a window over more than one range of them.

    Rows are dealt by ranges of the keys and kept in a table, numbered in their range, and moved by the sizes of the ranges
    before, of which there is one row a partition. Rows equal in all keys are numbered in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    numbered = dealt.withColumn("_own", own).join(F.broadcast(base), "_range")  # base has one row a partition
    return numbered.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_range", "_own", "_base")


def leakage_shares(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """(split, facet, value, n, share): how a split's rows are spread over the values of each column."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    counts = long.groupBy(split, "f.facet", "f.value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split, "facet")))


def leakage_audit(df: DataFrame, group: str = "region", split: str = "split") -> DataFrame:
    """Groups per split, rows, and how many groups are on more than one side."""
    sides = df.groupBy(group).agg(F.countDistinct(split).alias("sides"))
    per = df.groupBy(split).agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"))
    leaks = sides.agg(F.count_if(F.col("sides") > 1).alias("n_leaking"))
    return per.crossJoin(F.broadcast(leaks))  # leaks is one row


def sample_numbering(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """sample_no from 0 over all rows in order of groups, then order, and new_stem split_000123; no task holds a group (see ranked)."""
    numbered = ranked(df, [*groups, *order], "sample_no")
    stem = F.concat_ws("_", F.col(groups[0]), F.when(F.length(F.col("sample_no").cast("string")) < 6, F.lpad(F.col("sample_no").cast("string"), 6, "0")).otherwise(F.col("sample_no").cast("string")))
    return numbered.withColumn("new_stem", stem)


def holdout_search(
    counts: DataFrame, trials: int = 5000, val_share: float = 0.2, min_per_class: int = 3, seed: int = 42,
) -> DataFrame:
    """(trial, score, val_n, regions) of the best of random region orders, from counts (region_id, class_name, modality, n).

    In each trial regions are added in order of their draws while fewer rows are held out than the target, the whole part of
    val_share of all rows. Score: sum of the differences between the held-out and the overall shares of each (class,
    modality) + twice the distance from the target as a share of all rows + half of the classes with fewer than
    min_per_class rows + half of the largest region's share of the held-out rows; the least score, then the first trial,
    wins. Trials are the parallel axis; a trial's rows are one a region.
    """
    spark = counts.sparkSession
    regions = counts.groupBy("region_id").agg(F.sum("n").alias("size"))
    total = counts.agg(F.sum("n").alias("total"))
    strata = counts.groupBy("class_name", "modality").agg(F.sum("n").alias("all_n"))
    rows = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(regions).crossJoin(F.broadcast(total))
    rows = rows.withColumn("d", draw(F.concat_ws(":", "region_id", "trial"), seed)).withColumn("target", F.floor(F.col("total") * F.lit(val_share)))
    run = Window.partitionBy("trial").orderBy("d", "region_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    held = rows.where(F.col("before") < F.col("target"))
    sizes = held.groupBy("trial").agg(
        F.sum("size").alias("val_n"), F.max("size").alias("largest"), F.first("total").alias("total"), F.first("target").alias("target"),
        F.array_join(F.transform(F.array_sort(F.collect_list("region_id")), lambda x: x.cast("string")), ",").alias("regions"))
    per = held.select("trial", "region_id").join(counts, "region_id").groupBy("trial", "class_name", "modality").agg(F.sum("n").alias("n"))
    every = sizes.crossJoin(F.broadcast(strata)).join(per, ["trial", "class_name", "modality"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    classes = every.groupBy("trial", "class_name").agg(
        F.sum(F.round(F.abs(F.col("n") / F.col("val_n") - F.col("all_n") / F.col("total")), 9)).alias("diff"), F.sum("n").alias("n"))
    parts = classes.groupBy("trial").agg(F.sum("diff").alias("diff"), F.count_if(F.col("n") < min_per_class).alias("under"))
    scored = sizes.join(parts, "trial")
    error = F.abs(F.col("val_n") - F.col("target")) / F.col("total")
    score = F.round(F.col("diff") + 2 * error + 0.5 * F.col("under") + 0.5 * F.col("largest") / F.col("val_n"), 6)
    return scored.select("trial", score.alias("score"), "val_n", "regions").orderBy("score", "trial").limit(1)


def inverse_frequency_weights(df: DataFrame, column: str) -> DataFrame:
    """(column, n, weight): the weight of a row is one over the number of rows of its value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("weight", 1 / F.col("n"))


def weighted_resample(df: DataFrame, column: str, key: str, draws: int | None = None, seed: int = 42) -> DataFrame:
    """(draw, key): draws with replacement where each value of column is equally likely and each of its rows, too.

    There are as many draws as df has rows unless draws says otherwise. A draw picks a value, then a place among the value's
    rows; rows are ranked over all values at once (see ranked), so no task holds a value and the join is on one number.
    """
    values = df.groupBy(column).agg(F.count("*").alias("n"))
    before = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("v", F.row_number().over(Window.orderBy(column)) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))
    values = values.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    picks = df.sparkSession.range(df.count() if draws is None else draws).withColumnRenamed("id", "draw")
    picks = picks.withColumn("u", draw(F.col("draw"), seed)).withColumn("w", draw(F.col("draw"), seed + 1))
    picked = picks.join(values, F.floor(F.col("u") * F.col("k")) == F.col("v"))
    picked = picked.select("draw", (F.col("base") + F.floor(F.col("w") * F.col("n"))).alias("place"))
    return picked.join(ranked(df.select(column, key), [column, key], "place"), "place").select("draw", key)
