"""Near duplicates of a stated similarity: SimHash candidates, whole and of samples, verified by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, drop_scratch
from .components import connected_components, spanning_stars
from .simhash import near_duplicate_links, shingle_hashes, simhash, stay

#: A group of candidates with more members or shingles than this is dealt to several tasks, each with one pair of its parts.
PART_MEMBERS, PART_SHINGLES = 8192, 2_000_000


@dataclass(frozen=True)
class Settings:
    """Texts are near duplicates if their sets of word shingles have a Jaccard similarity of `similarity` or more.

    A pair of similarity s becomes a candidate with probability 1 - (1 - s**sample_size)**samples at least: 0.998 at 0.8,
    and more above. What is a candidate is verified exactly, so the samples decide about recall alone.
    """

    similarity: float = 0.8
    shingle: int = 5
    samples: int = 12
    sample_size: int = 4
    most: int = 3  # differing bits of whole fingerprints that are candidates, too


@lru_cache(8)
def _mixers(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 2**63, samples, np.uint64), rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted different shingle hashes of a text; none without words."""
    blocks = [np.unique(b) for b in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def sample_keys(found: np.ndarray, settings: Settings) -> list[int]:
    """A key for each sample: the few shingles that come first in the sample's own order. Equal samples have equal keys."""
    if not len(found):
        return []
    keys = []
    for seed, (add, times) in enumerate(zip(*_mixers(settings.samples))):
        mixed = (found ^ add) * times
        if len(mixed) > settings.sample_size:
            mixed = np.partition(mixed, settings.sample_size - 1)[:settings.sample_size]
        keys.append(xxhash.xxh64_intdigest(np.sort(mixed).tobytes(), seed))
    return keys


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _prints(rows: DataFrame, settings: Settings) -> DataFrame:
    """(k, node, fp, n, keys) from (k, text): node names the set of shingles, n is its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, n, keys = [], [], [], []
            for text in batch.column(1):
                blocks = list(shingle_hashes(text.as_py(), settings.shingle))
                found = np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)
                node.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                fp.append(simhash(blocks))
                n.append(len(found))
                keys.append(_signed(sample_keys(found, settings)))
            columns = [batch.column(0), pa.array(_signed(node)), pa.array(_signed(fp)), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "node", "fp", "n", "keys"])

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, node long, fp long, n long, keys array<long>")


def _candidate_groups(nodes: DataFrame, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """(key, node, parts): groups of two nodes or more that may be similar, each set of members once; and tables it reads."""
    linked = cut_lineage(connected_components(near_duplicate_links(nodes.select("fp").distinct(), settings.most)))
    grid = nodes.select("node", "n", "fp").join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
    grid = grid.select(F.xxhash64(F.lit("whole"), F.coalesce("component", "fp")).alias("key"), "node", "n")
    entries = nodes.select(F.explode("keys").alias("key"), "node", "n").union(grid)
    members = F.struct(F.count("*").alias("size"), F.bit_xor("node").alias("all"), F.min("node").alias("low"), F.max("node").alias("high"))
    groups = entries.groupBy("key").agg(members.alias("who"), F.sum("n").alias("shingles")).where("who.size > 1")
    once = groups.groupBy("who", "shingles").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("who.size") / PART_MEMBERS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    once = cut_lineage(once.select("key", parts.alias("parts")))
    return entries.join(once, "key").select("key", "node", "parts"), [linked, once]


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a group under `similarity`; pairs that are connected already are not compared."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes)]
    label = np.arange(len(sets))
    u, v = [], []
    for c in range(len(sets) - 1):
        # sizes ascend, so only those up to |c| / similarity can be similar
        end = int(np.searchsorted(sizes, sizes[c] / similarity + 1e-9, "right"))
        others = c + 1 + np.flatnonzero(label[c + 1:end] != label[c])
        if not len(others) or not sizes[c]:
            continue
        if len(others) == end - c - 1:
            values = flat[starts[c + 1]:starts[end]]
        else:
            values = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[c], values), sizes[c] - 1)
        shared = np.add.reduceat((sets[c][at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes[others])[:-1]])
        alike = others[shared >= similarity * (sizes[c] + sizes[others] - shared) - 1e-9]
        if len(alike):
            u.append(np.full(len(alike), nodes[c]))
            v.append(nodes[alike])
            label[np.isin(label, label[alike])] = label[c]
    if not u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(u), np.concatenate(v)


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) from rows (key, node, found) that are sorted by key within their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = similar_links(np.array(nodes, np.int64), sets, similarity)
                if len(a):
                    a, b = spanning_stars(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        for batch in batches:
            lists = batch.column(2)
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, (key, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != current:
                    yield from links()
                    current, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(values[offsets[i]:offsets[i + 1]])
        yield from links()

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, "u long, v long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, found) from (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_shingles(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    return texts.mapInArrow(run, "node long, found array<long>")


def _labels(rows: DataFrame, settings: Settings) -> DataFrame:
    """(k, component) of rows (k: struct<_dedup_id, _dedup_hash>, text) in a table; component is a node."""
    spark = rows.sparkSession
    prints = cut_lineage(_prints(rows, settings))
    # equal sets have equal keys, their fingerprints may differ by repeated shingles
    nodes = cut_lineage(prints.groupBy("node").agg(
        F.min("k").alias("k"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    groups, read = _candidate_groups(nodes, settings)
    members = cut_lineage(groups)
    needed = members.select("node").distinct().join(nodes.select("node", "k"), "node")
    needed = needed.select(F.col("node"), F.col("k._dedup_id").alias("_id"), F.col("k._dedup_hash").alias("_hash"))
    own = rows.select(F.col("k._dedup_id").alias("_own_id"), F.col("k._dedup_hash").alias("_own_hash"), "text")
    on = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    texts = own.join(needed, on).select("node", "text").dropDuplicates(["node"])
    found = members.join(_sets(texts, settings.shingle), "node").select("key", "node", "parts", "found")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(part, other) * F.col("parts") + F.greatest(part, other))
    found = found.withColumn("pair", F.explode(pairs)).select(F.xxhash64("key", "pair").alias("key"), "node", "found")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = cut_lineage(_verified(found.repartition(n, "key").sortWithinPartitions("key"), settings.similarity))
    parts = connected_components(links)
    out = prints.select("k", "node").join(parts, "node", "left").select("k", F.coalesce("component", "node").alias("component"))
    out = cut_lineage(out)
    for table in (prints, nodes, members, links, *read):
        drop_scratch(table)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select("*", F.col(id_col).cast("long").alias("_dedup_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_dedup_hash"))


def _narrow(own: DataFrame, text_col: str) -> DataFrame:
    return own.select(F.struct("_dedup_id", "_dedup_hash").alias("k"), F.col(text_col).cast("string").alias("text"))


def _first() -> Column:
    return F.min(F.struct(F.col("k._dedup_id").isNull().alias("a"), F.col("k").alias("k")))


def similar_documents(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, component_id) per row of docs; component_id is the smallest id that is reached over similar texts.

    Candidates are texts whose whole SimHashes are joined by the segment-popcount grid, or which share a sample of
    shingles; each is verified by the exact Jaccard similarity of the sets of lower-cased (A-Z) word shingles. Texts of
    equal sets are one node, so copies cost one row in the join; a group of candidates is compared block by block over
    several tasks and yields fewer links than members. A text of fewer words than a shingle is one shingle; null texts and
    texts without a word are alike. Null ids pass through and never are the smallest; an empty table gives an empty result.
    """
    labels = _labels(_narrow(_keyed(docs, id_col, text_col), text_col), settings)
    least = labels.groupBy("component").agg(F.min("k._dedup_id").alias("component_id"))
    return labels.join(least, "component").select(F.col("k._dedup_id").alias("doc_id"), "component_id")


def deduplicate(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of similar_documents the row of the smallest id.

    Of rows that share an id but not a text the one with the smallest text hash stays, of rows equal in both the one of
    the least hash of its other columns. A group without any id keeps the row of the smallest text hash.
    """
    own = _keyed(docs, id_col, text_col)
    labels = _labels(_narrow(own, text_col), settings)
    firsts = labels.groupBy("component").agg(_first().alias("f")).select(F.col("f.k._dedup_id").alias("_first_id"), F.col("f.k._dedup_hash").alias("_first_hash"))
    return stay(own, cut_lineage(firsts.distinct()), docs.columns, text_col)
