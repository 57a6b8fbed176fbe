"""Near-duplicate documents by SimHash with a segment-popcount grid join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage
from .components import connected_components, spanning_stars

#: Segments are 2 bits wide: 32 bit counts, 16 for each half of the fingerprint.
_LOW = np.uint32(0x55555555)
_ONE, _TWO = np.uint32(1), np.uint32(2)
#: Members of a cell that are compared in one go; a larger cell is compared block by block.
BLOCK = 2048
#: A cell with more members than this is dealt to several tasks, each with one pair of its parts.
CELL_PART = 8192
_HASHED_TOGETHER = 65_536


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """The hashes of all word shingles of a text in blocks, repeats included; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    last = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASHED_TOGETHER):
        end = min(n, at + _HASHED_TOGETHER)
        yield np.array([digest(joined[i:j - 1], seed) for i, j in zip(starts[at:end], starts[at + last:end + last])], np.uint64)


def simhash(blocks: Iterable[np.ndarray]) -> int:
    """64 bits, each set if it is set in over half the hashes; 0 without hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        n += len(hashes)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    return simhash(shingle_hashes(text, shingle, seed))


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, out_col: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long in out_col."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text_col)], np.uint64).view(np.int64)
            at = table.schema.get_field_index(out_col)
            table = table.remove_column(at) if at >= 0 else table
            yield from table.append_column(out_col, pa.array(prints, pa.int64())).to_batches()

    bound_batches(docs.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != out_col)
    return docs.mapInArrow(run, f"{schema}, `{out_col}` long")


def _half_cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every grid cell each fingerprint enters.

    A half's sixteen 2-bit segments have bit counts 0 to 2; they fit in the 32 bits that they count. Fingerprints at most
    3 bits apart have count vectors at Manhattan distance 3 at most, so in one of the halves at distance 1 at most: the
    same cell, or two cells of different parity. Every fingerprint enters its own cell of each half; one with an even
    count there also enters the cells at distance 1.
    """
    cells, rows = [], []
    for half in (0, 1):
        bits = (prints.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
        counts = (bits & _LOW) + ((bits >> _ONE) & _LOW)
        tag = np.int64(half) << np.int64(32)
        cells.append(counts.astype(np.int64) | tag)
        rows.append(np.arange(len(prints)))
        even = np.flatnonzero(np.bitwise_count(bits) % 2 == 0)
        for segment in range(16):
            step = np.uint32(1 << (2 * segment))
            value = (counts[even] >> np.uint32(2 * segment)) & np.uint32(3)
            for there, moved in ((even[value < 2], step), (even[value > 0], np.uint32(2**32 - int(step)))):
                cells.append((counts[there] + moved).astype(np.int64) | tag)
                rows.append(there)
    return np.concatenate(cells), np.concatenate(rows)


def _enter_cells(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 20_000):
                part = values[at:at + 20_000]
                cell, row = _half_cells(part)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[row])], ["cell", "fp"])

    return prints.mapInArrow(run, "cell long, fp long")


def _cell_edges(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the members of one cell, in memory of BLOCK x BLOCK."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    bits = prints.view(np.uint64)
    for i in range(0, len(prints), BLOCK):
        for j in range(i, len(prints), BLOCK):
            a, b = np.nonzero(np.bitwise_count(bits[i:i + BLOCK, None] ^ bits[None, j:j + BLOCK]) <= most)
            keep = a + i < b + j
            if keep.any():
                u, v = spanning_stars(np.concatenate([u, prints[a[keep] + i]]), np.concatenate([v, prints[b[keep] + j]]))
    return u, v


def _linked(rows: DataFrame, most: int) -> DataFrame:
    """Links (u, v) from rows (cell, part, fp) that are sorted by cell and part within their partition."""
    def edges(cell: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        us, vs = [], []
        bits = prints.view(np.uint64)
        small = np.repeat(sizes <= 64, sizes)
        for step in range(1, min(64, len(cell))):
            hit = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:])
            if not len(hit):
                break
            hit = hit[np.bitwise_count(bits[hit] ^ bits[hit + step]) <= most]
            us.append(prints[hit])
            vs.append(prints[hit + step])
        for k in np.flatnonzero(sizes > 64):
            u, v = _cell_edges(prints[starts[k]:starts[k] + sizes[k]], most)
            us.append(u)
            vs.append(v)
        if us:
            u, v = spanning_stars(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            cell, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(cell):
                continue
            held.append((cell, prints))
            if cell[0] == cell[-1] == held[0][0][0]:
                continue
            cell, prints = (np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(cell, cell[-1])) if (cell[1:] >= cell[:-1]).all() else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            yield from edges(cell[:end], prints[:end])
            held = [(cell[end:], prints[end:])]
        if held:
            yield from edges(*(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(run, "u long, v long")


def near_duplicate_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(u, v) links that span every component of the distinct fingerprints in column fp at most `most` (<= 3) bits apart.

    Candidates share a cell of the segment-popcount grid, whose Manhattan distance bounds the Hamming distance from below;
    every candidate pair is verified exactly where its cell is read. A cell is compared block by block and yields fewer
    links than members. A cell of more than CELL_PART members is cut into parts that meet in pairs, in several tasks.
    """
    if not 0 <= most <= 3:
        raise ValueError("the grid covers distances up to 3")
    cells = _enter_cells(prints.select("fp"))
    spark = prints.sparkSession
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > CELL_PART).select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / CELL_PART).cast("int").alias("_parts")))
    n_large = large.count()
    if n_large:
        own = cells.join(large, F.col("cell") == F.col("_cell"), "left")
        part = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda other: F.least(part, other) * F.col("_parts") + F.greatest(part, other))
        own = own.withColumn("part", F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(pairs)))
        # the cells of one part pair stay together as one run of equal keys
        cells = own.select(F.when(F.col("_parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "part")).alias("cell"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell")
    return _linked(dealt.select("cell", "fp"), most)


def near_duplicates(docs: DataFrame, most: int = 3, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of docs.

    fp is the signed 64-bit SimHash of the lower-cased (A-Z) word shingles; fingerprints at most `most` bits apart are
    linked, and component_id is the smallest id that is reached. Texts that are null or have no word have fingerprint
    0, which links like any other. Null ids are passed through and never are the smallest; rows that share an id are
    separate rows; an empty table gives an empty result. Copies meet as one fingerprint, so a group of equal texts costs
    one row in the join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut_lineage(with_fingerprint(rows, shingle=shingle).select("doc_id", "fp"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_duplicate_links(nodes, most))
    linked = parts.join(nodes, parts["node"] == nodes["fp"]).select("node", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("reached"))
    found = linked.select("node", "component").join(smallest, "component").select(F.col("node").alias("_fp"), "reached")
    labels = nodes.join(found, nodes["fp"] == found["_fp"], "left").select(F.col("fp").alias("_fp"), F.coalesce("reached", "least").alias("component_id"))
    labels = cut_lineage(labels)  # a table, so that the join may split the copies of one text among tasks
    return prints.join(labels, prints["fp"] == labels["_fp"]).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, most: int = 3, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the rows with the smallest id, and of rows equal in id and text one.

    Of rows that share an id but not a text the one with the smallest text hash stays. A component without any id keeps
    the row with the smallest text hash.
    """
    own = docs.select("*", F.col(id_col).cast("long").alias("_dedup_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_dedup_hash"))
    narrow = own.select("_dedup_id", "_dedup_hash", F.col(text_col).alias("text")).select(F.struct("_dedup_id", "_dedup_hash").alias("k"), "text")
    prints = cut_lineage(with_fingerprint(narrow, shingle=shingle).select("k", "fp"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct(F.col("k._dedup_id").isNull().alias("a"), F.col("k").alias("k"))).alias("least")))
    parts = connected_components(near_duplicate_links(nodes, most))
    linked = nodes.join(parts, nodes["fp"] == parts["node"], "left")
    firsts = linked.groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("least").alias("_k"))
    firsts = firsts.select(F.col("_k.k._dedup_id").alias("_first_id"), F.col("_k.k._dedup_hash").alias("_first_hash")).distinct()
    return stay(own, firsts, docs.columns, text_col)


def stay(own: DataFrame, firsts: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The rows of own whose (_dedup_id, _dedup_hash) is in firsts (_first_id, _first_hash), one for each such pair.

    Of rows equal in id and text that of the least hash of its other columns stays, so reruns agree.
    """
    on = F.col("_dedup_id").eqNullSafe(F.col("_first_id")) & (F.col("_dedup_hash") == F.col("_first_hash"))
    others = [c for c in columns if c != text_col]
    rank = F.xxhash64(F.to_json(F.struct(*others), {"ignoreNullFields": "false"})) if others else F.lit(0)
    once = own.join(firsts, on, "left_semi").select(F.struct(*columns).alias("_row"), "_dedup_id", "_dedup_hash", rank.alias("_rank"))
    kept = once.groupBy("_dedup_id", "_dedup_hash").agg(F.min_by("_row", "_rank").alias("_row"))
    return kept.select("_row.*")
