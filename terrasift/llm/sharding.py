"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime number of slots; with up to 655 shards no shard's share is off by more than about one percent.
TABLE_SIZE = 65_537


def _two_hashes(name: str) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that owns it.

    Every shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo the prime table size, and the
    shards take turns, each claiming the first slot of its order that is still free. The loop makes about
    table_size * ln(table_size) steps on the driver whatever the data; its result has table_size integers.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if table_size < len(shards) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime not below the number of shards")
    at, skip = [], []
    for name in shards:
        first, second = _two_hashes(name)
        at.append(first % table_size)
        skip.append(second % (table_size - 1) + 1)
    table, free = [-1] * table_size, table_size
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % table_size
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def assign_shards(
    docs: DataFrame, n_shards: int = 64, *, id_col: str = "doc_id", table_size: int = TABLE_SIZE,
    slot_col: str = "slot", shard_col: str = "shard",
) -> DataFrame:
    """Add slot_col and shard_col (replacing columns of those names) to every row.

    The slot is the 64-bit hash of the id modulo the table size; a null id counts as the string "null". Rows that
    share an id share a shard; an empty table gives an empty result. The lookup table has a fixed number of rows,
    so it is broadcast and no row is shuffled. Adding or removing a shard moves few of the ids.
    """
    owners = lookup_table([f"shard-{i:05d}" for i in range(n_shards)], table_size)
    table = docs.sparkSession.createDataFrame(list(enumerate(owners)), f"_slot int, `{shard_col}` int")
    rows = docs.drop(slot_col, shard_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = rows.withColumn(slot_col, F.pmod(F.xxhash64(key), F.lit(table_size)).cast("int"))
    return rows.join(F.broadcast(table), F.col(slot_col) == F.col("_slot"), "left").drop("_slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 64, *, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write the rows as Parquet under path/shard=N, with files_per_shard files in each shard."""
    placed = assign_shards(docs, n_shards, id_col=id_col)
    part = F.pmod(F.xxhash64(F.col("slot")), F.lit(files_per_shard))
    placed.repartition(n_shards * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
