"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.sources.scratch import cut_lineage, drop_scratch

__all__ = ["BROADCAST_ROWS", "WORD", "bound_batches", "cut_lineage", "drop_scratch", "lookup_join", "text_hash"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Lookup frames up to this many rows are broadcast; larger ones are joined through a shuffle.
BROADCAST_ROWS = 20_000


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Pass at most so many rows and bytes to Python at once: whole texts make batches of the default 10,000 rows large.

    Every operator that passes whole texts calls it with the same bounds, so none depends on which ran before.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_hash(text: str | Column) -> Column:
    """Tells apart documents that share an id; equal ids with equal texts are one document."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def lookup_join(rows: DataFrame, table: DataFrame, n_rows: int, key: str, salt_by: list[str], how: str = "left", salts: int = 64) -> DataFrame:
    """Join rows to a table that is unique in key (both hold the column key; null keys match).

    A table of at most BROADCAST_ROWS rows (n_rows is its counted size) is broadcast. A larger one is
    repeated once per salt, a hash of salt_by, so that one key with a third of all rows is dealt to many tasks.
    """
    other = table.withColumnRenamed(key, "_lookup_key")
    if n_rows <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_lookup_key")), how)
        return joined.drop("_lookup_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    other = other.withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col(key).eqNullSafe(F.col("_lookup_key")) & (F.col("_salt") == F.col("_lookup_salt"))
    return salted.join(other, on, how).drop("_lookup_key", "_lookup_salt", "_salt")
