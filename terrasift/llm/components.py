"""Connected components of a large edge list as repeated joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_scratch


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges that is not itself the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each batch by stars; fewer rows, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = spanning_stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v: long), component being its smallest node.

    Each round hangs every node's larger neighbours, then every node's smaller neighbours, on the smallest node
    around it (alternating large and small stars), which ends after about log(nodes) rounds. Rounds are cut by a table in the
    shared folder, of which only the last is kept. Self loops, repeated edges and an empty frame are allowed; null
    ends are ignored.
    """
    def hang(pairs: DataFrame, on: str, smallest_of: DataFrame) -> DataFrame:
        return pairs.join(smallest_of, on)

    current = cut_lineage(_contract(edges.select("u", "v").where("u <> v")).distinct())
    before = None
    while True:
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = hang(both.where("v > u"), "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = hang(down, "u", least).selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
        after = cut_lineage(small.where("u > v").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(current)
        current = after
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
