"""Training histories: best epoch, early stop, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop(history: DataFrame, patience: int = 12) -> DataFrame:
    """(run_id, best_epoch, best_metric, stop_epoch, epochs): the best epoch up to the stop, strictly greater ones only.

    stop_epoch is the first epoch with `patience` epochs since the last improvement, else the last epoch.
    """
    run = Window.partitionBy("run_id").orderBy("epoch")
    past = run.rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.col("metric") > F.max("metric").over(past), F.lit(True))
    marked = history.withColumn("better", better)
    last = F.last(F.when(F.col("better"), F.col("epoch")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("since", F.col("epoch") - last)
    stops = marked.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"), F.count("*").alias("epochs"))
    seen = marked.join(stops, "run_id").where("epoch <= stop_epoch AND better")
    best = seen.groupBy("run_id").agg(F.max("epoch").alias("best_epoch"), F.max_by("metric", "epoch").alias("best_metric"))
    return best.join(stops, "run_id").select("run_id", "best_epoch", "best_metric", "stop_epoch", "epochs")


def run_ledger(history: DataFrame) -> DataFrame:
    """Epochs, first, last and best metric per run, and the rank of the run by its best."""
    per = history.groupBy("run_id").agg(
        F.count("*").alias("epochs"), F.min_by("metric", "epoch").alias("first_metric"), F.max_by("metric", "epoch").alias("last_metric"), F.max("metric").alias("best_metric"))
    return per.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("best_metric"))))


def best_threshold(sweep: DataFrame, metric: str, threshold: str = "threshold") -> DataFrame:
    """The row of the greatest metric, the least threshold of equals."""
    return sweep.orderBy(F.desc(metric), threshold).limit(1)
