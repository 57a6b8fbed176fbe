"""Approximate nearest neighbours: stable projections in a kd-tree with a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


@dataclass(frozen=True)
class Settings:
    projected: int = 12  # dimensions of the projected space
    chance: float = 0.97  # a neighbour at the k-th distance is inside the searched radius with this chance
    leaf: int = 64  # vectors in a leaf of a cell's tree
    cell_rows: int = 8192  # vectors in a cell of the whole index, about; also the most, about, that one group holds
    cell_queries: int = 8192  # queries, about, that one group holds
    fit_rows: int = 20_000  # vectors from which the cells are fitted, those whose ids have the least hash
    block: int = 128  # queries that walk through the leaves together
    seed: int = 9


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi-square with k degrees of freedom <= x) = p, by bisection of the lower incomplete gamma series."""
    def cdf(x: float) -> float:
        a, half = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    low, high = 1e-9, 10.0 * k + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """Vectors are lifted onto a sphere, where the largest inner product is the least distance, and projected."""

    matrix: np.ndarray  # (dimension + 1, projected)
    norm: float  # greatest norm of the indexed vectors

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (vectors**2).sum(axis=1)))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors * (self.norm / np.sqrt((vectors**2).sum(axis=1)))[:, None]
        return unit @ self.matrix[:-1]


@dataclass(frozen=True)
class Cells:
    """The upper levels of the kd-tree: node i has children 2i+1 and 2i+2; leaves are the cells."""

    axis: np.ndarray
    split: np.ndarray
    depth: int

    def place(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[at]] > self.split[at]
            at = 2 * at + 1 + right
        return at - (2**self.depth - 1)

    def square_distances(self, points: np.ndarray) -> np.ndarray:
        """From each point to the box of each cell."""
        dims = points.shape[1]
        low, high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)
        for level in range(self.depth):
            first = 2**level - 1
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            for i in range(2**level):
                a, s = self.axis[first + i], self.split[first + i]
                high[2 * i, a] = min(high[2 * i, a], s)
                low[2 * i + 1, a] = max(low[2 * i + 1, a], s)
        return _box_distances(points, low, high)


def _box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(low[None, :, k] - points[:, None, k], points[:, None, k] - high[None, :, k])
        total += np.maximum(gap, 0.0) ** 2
    return total


def fit_cells(points: np.ndarray, depth: int) -> Cells:
    axis, split = np.zeros(max(1, 2**depth - 1), np.int64), np.zeros(max(1, 2**depth - 1))
    groups = [points]
    for level in range(depth):
        halves = []
        for i, group in enumerate(groups):
            node = 2**level - 1 + i
            axis[node] = int(np.argmax(group.var(axis=0))) if len(group) else 0
            split[node] = float(np.median(group[:, axis[node]])) if len(group) else 0.0
            right = group[:, axis[node]] > split[node]
            halves += [group[~right], group[right]]
        groups = halves
    return Cells(axis, split, depth)


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of a balanced kd-tree's leaves."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        values = points[rows]
        order = np.argpartition(values[:, int(np.argmax(values.var(axis=0)))], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def _best(score: np.ndarray, row: np.ndarray, least_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each line, best first; of equal scores those of smaller ids, and places without a row last."""
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(score, top, axis=1).min(axis=1)
    # where more than k are as good as the k-th, ids decide which of the equals stay
    tied = np.flatnonzero((score >= last[:, None]).sum(axis=1) > k)
    if len(tied):
        ids = np.where(row[tied] >= 0, least_ids[row[tied]], np.iinfo(np.int64).max)
        top[tied] = np.lexsort((ids, -score[tied]), axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def search_cell(
    vectors: np.ndarray, least_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, projection: Projection, k: int, settings: Settings,
) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rows) of the k best vectors found in a cell for each query; rows are -1 where fewer were found.

    known: for each query the k-th best score so far (-inf: none). The leaves of the cell's tree are read nearest first
    in the projected space, all their vectors verified, until the next leaf's squared projected distance passes the
    chi-square quantile times the squared distance of the k-th neighbour.
    """
    limit = chi_square_quantile(settings.chance, settings.projected)
    points = projection.rows(vectors)
    leaves = _leaves(points, settings.leaf)
    width = max(map(len, leaves))
    members = np.full((len(leaves), width), -1)
    low, high = np.empty((len(leaves), points.shape[1])), np.empty((len(leaves), points.shape[1]))
    for i, rows in enumerate(leaves):
        members[i, :len(rows)] = rows[np.argsort(least_ids[rows], kind="stable")]
        low[i], high[i] = points[rows].min(axis=0), points[rows].max(axis=0)
    best_score, best_row = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    lengths = np.sqrt((queries**2).sum(axis=1))
    for start in range(0, len(queries), settings.block):
        part = slice(start, start + settings.block)
        q, reached = queries[part], known[part]
        far = _box_distances(projection.queries(q), low, high)
        order = np.argsort(far, axis=1)
        score, row = best_score[part], best_row[part]
        active = np.arange(len(q))
        for step in range(len(leaves)):
            kth = np.maximum(score[active, -1], reached[active])
            nearest = 2 * projection.norm**2 - 2 * projection.norm * kth / lengths[part][active]
            active = active[far[active, order[active, step]] <= limit * np.maximum(nearest, 0.0)]
            if not len(active):
                break
            found = members[order[active, step]]
            scores = np.einsum("qwd,qd->qw", vectors[found], q[active])
            scores[found < 0] = -np.inf
            both, rows = np.hstack([score[active], scores]), np.hstack([row[active], found])
            top = _best(both, rows, least_ids, k)
            score[active], row[active] = np.take_along_axis(both, top, axis=1), np.take_along_axis(rows, top, axis=1)
    return best_score, best_row


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.empty((0, 1))


def _rows(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


_OUT = "query_id long, rank int, vec_id long, score double"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings(), *, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k vectors of largest inner product found, without its own row.

    Both frames hold id_col and vector_col; other columns are not looked at. Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do rows with a null id. Vectors are searched among those of their own
    length, each length by an index of its own, as others have no inner product with them. Of rows that repeat an id each
    is a candidate; each different vector of a query id is a query of its own, whose own row alone is left out, and
    rows repeated as a whole are one query. Equal vectors are one point of the index with the k + 1 smallest ids, which are
    all that a result can name. Ties go to the smaller id. An empty table gives an empty result.

    Each query first searches the cell that its projection lies in, then every cell that the stopping test does not
    rule out at the k-th score reached there. Cells are at most 1,024; a larger cell is dealt in parts, and its queries in
    blocks, so that a group holds about cell_rows vectors and cell_queries queries whatever the sizes of both tables.
    """
    rows = _usable(vectors, id_col, vector_col)
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(size).alias("m")).orderBy("d").collect()
    asked = _usable(queries, id_col, vector_col).distinct()
    found = [
        _nearest(rows.where(F.size("v") == r["d"]), asked.where(F.size("v") == r["d"]), k, settings, r["d"], r["n"], math.sqrt(r["m"]) * (1 + 1e-12))
        for r in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], _OUT)


def _nearest(rows: DataFrame, asked: DataFrame, k: int, settings: Settings, dimension: int, count: int, norm: float) -> DataFrame:
    """nearest for vectors of one length."""
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = rows.withColumn("_r", smallest).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    projection = Projection(np.random.default_rng(settings.seed).standard_normal((dimension + 1, settings.projected)), norm)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(settings.fit_rows).select("v").toPandas()
    depth = max(0, min(10, math.ceil(math.log2(max(1, count / settings.cell_rows))), int(math.log2(max(1, len(sample) / 16)))))
    cells = fit_cells(projection.rows(_matrix(sample["v"])), depth)
    limit = chi_square_quantile(settings.chance, settings.projected)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells.place(projection.rows(_matrix(batch["v"]))))

    index = cut_lineage(points.mapInPandas(place, "v array<double>, ids array<long>, cell long"))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / settings.cell_rows).cast("int").alias("_parts"))
    parts = cut_lineage(parts.withColumnRenamed("cell", "_cell"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells.place(projection.queries(_matrix(batch["v"]))), kth=-np.inf)

    def search(key: tuple, data: pa.Table, wanted: pa.Table) -> pa.Table:
        score, row = np.empty((0, k + 1)), np.empty((0, k + 1), np.int64)
        kth = wanted["kth"].to_numpy()
        if len(data) and len(wanted):
            own, asked_for = _rows(data["v"], dimension), _rows(wanted["v"], dimension)
            ids = data["ids"].combine_chunks()
            least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
            score, row = search_cell(own, least, asked_for, kth, projection, k + 1, settings)
        query, place = np.nonzero((row >= 0) & (score >= kth[:len(row), None]))
        hit = row[query, place]
        same = np.zeros(len(hit), bool)
        for at in range(0, len(hit), 65_536):
            part = slice(at, at + 65_536)
            same[part] = (own[hit[part]] == asked_for[query[part]]).all(axis=1)
        return pa.table({
            "query_id": wanted["id"].combine_chunks().take(pa.array(query)), "q": wanted["q"].combine_chunks().take(pa.array(query)),
            "ids": data["ids"].combine_chunks().take(pa.array(hit)), "own": pa.array(same), "score": pa.array(score[query, place], pa.float64())})

    def run(wanted: DataFrame) -> DataFrame:
        asks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / settings.cell_queries).cast("int").alias("_blocks"))
        # one row a cell, so 1,024 at most
        table = F.broadcast(parts.join(asks, F.col("_cell") == F.col("cell")).select("_cell", "_parts", "_blocks"))
        part, block = F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int"), F.pmod(F.xxhash64("q"), F.col("_blocks")).cast("int")
        data = index.join(table, F.col("cell") == F.col("_cell"))
        data = data.select("v", "ids", "cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
        dealt = wanted.join(table, F.col("cell") == F.col("_cell"))
        dealt = dealt.select("id", "q", "v", "kth", "cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), block.alias("block"))
        group = ("cell", "part", "block")
        return data.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInArrow(search, "query_id long, q long, ids array<long>, own boolean, score double")

    columns = "id long, q long, v array<double>, cell long, kth double"
    at_home = cut_lineage(asked.select("id", F.xxhash64("v", "id").alias("q"), "v").mapInPandas(home, columns))
    first = cut_lineage(run(at_home))
    reached = Window.partitionBy("query_id", "q").orderBy(F.desc("score"))
    kth = first.withColumn("_r", F.row_number().over(reached)).where(F.col("_r") == k + 1).select(F.col("query_id").alias("_id"), F.col("q").alias("_q"), F.col("score").alias("_s"))
    again = at_home.join(kth, (F.col("id") == F.col("_id")) & (F.col("q") == F.col("_q")), "left").select("id", "q", "v", "cell", F.coalesce("_s", F.lit(float("-inf"))).alias("kth"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                q = _matrix(part["v"])
                kth = part["kth"].to_numpy() / np.sqrt((q**2).sum(axis=1))
                nearest = np.maximum(2 * projection.norm**2 - 2 * projection.norm * kth, 0.0)
                far = cells.square_distances(projection.queries(q))
                row, cell = np.nonzero(far <= limit * nearest[:, None])
                keep = cell != part["cell"].to_numpy()[row]
                yield part.iloc[row[keep]].assign(cell=cell[keep])

    more = run(cut_lineage(again.mapInPandas(others, columns)))
    # of the point that equals the query one occurrence of its id is its own row
    at = F.array_position("ids", F.col("query_id")).cast("int")
    rest = F.when(F.col("own") & (at > 0), F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.size("ids")))).otherwise(F.col("ids"))
    every = first.unionByName(more).select("query_id", "q", "score", F.explode(rest).alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
