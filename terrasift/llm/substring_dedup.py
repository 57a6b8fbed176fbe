"""Exact removal of long byte strings that repeat anywhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, drop_scratch, text_hash

#: Bytes of the strings among which the anchor of a window is chosen.
GRAM = 64
#: Bytes that are hashed together.
CHUNK = 1 << 19
#: Windows whose anchors lie in the same step of so many offsets are compared together.
OFFSETS = 64
#: Rows of a unit that one task compares; the units of a gram with more runs are dealt in blocks of about so many rows.
UNIT_ROWS = 4096
#: Kinds of ranges.
WINDOWS, PASSAGE = 0, 1
#: Stands before the windows of a row.
MARK = bytes(8)
#: Bits of the map of documents that have work to do.
MARK_BITS = 1 << 24
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes:
    """Hashes of substrings from sums of bytes times powers of two odd numbers, modulo 2**64."""

    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray):
        if not self.powers or len(self.powers[0][0]) < len(data):
            size = max(len(data), CHUNK + 4096)
            type(self).powers = []
            for base in _BASES:
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                both = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, inverse)]
                self.powers.append((both[0], both[1]))
        values = data.astype(np.uint64) + np.uint64(1)
        self.sums = [np.r_[np.uint64(0), np.cumsum(values * up[:len(data)])] for up, _ in self.powers]

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[0][end] - self.sums[0][start]) * self.powers[0][1][start] * _MIX
        return x ^ (x >> np.uint64(32))

    def both(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.first(start, end)
        y = (self.sums[1][end] - self.sums[1][start]) * self.powers[1][1][start]
        y = (y ^ (y >> np.uint64(29))) * _MIX
        return (x * np.uint64(5) + y) ^ (y >> np.uint64(32))


def _chunks(batch: pa.RecordBatch, least: int, ahead: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """(bytes, parts) of a batch whose third column is the text: parts are (row, first start in the text, place, bytes, starts).

    A text of at least `least` bytes is cut every CHUNK starts, and each part goes on for up to `ahead` bytes behind its last start.
    """
    pieces, parts, size = [], [], 0
    for row, text in enumerate(batch.column(2)):
        data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, max(0, len(data) - least + 1), CHUNK):
            piece = data[at:at + CHUNK + ahead - 1]
            if size + len(piece) > CHUNK and size:
                yield np.concatenate(pieces), parts
                pieces, parts, size = [], [], 0
            pieces.append(piece)
            parts.append((row, at, size, len(piece), CHUNK))
            size += len(piece)
    if size:
        yield np.concatenate(pieces), parts


def window_anchors(data: np.ndarray, hashes: _Hashes, length: int) -> np.ndarray:
    """For each start of a string of `length` bytes the place of its GRAM bytes of least hash, the first of equals."""
    grams = len(data) - GRAM + 1
    at = np.arange(grams)
    place_bits = np.uint64((1 << 23) - 1)
    value = (hashes.first(at, at + GRAM) & ~place_bits) | at.astype(np.uint64)
    width = length - GRAM + 1
    rows = -(-grams // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[:grams] = value
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    starts = grams - width + 1
    return (np.minimum(ahead[:starts], behind[width - 1:width - 1 + starts]) & place_bits).astype(np.int64)


_SPANS = "id long, hash long, start long, size int, fits int, lead int, gram long, content long"


def spans(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """Runs of neighbouring strings of `passage` bytes with one anchor: (id, hash, start, size, fits, lead, gram, content).

    start: first string of the run; size: strings; fits: so many of them, the first, start a window of `length` bytes, too;
    lead: bytes from the start to the anchor; gram: hash at the anchor; content: hash of all bytes of these strings and
    windows. An anchor depends on the bytes of its string alone, so equal strings have anchors of equal gram at the same
    offset, and equal windows start with equal strings.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1).to_numpy()
            for data, parts in _chunks(batch, passage, length):
                hashes = _Hashes(data)
                anchor = window_anchors(data, hashes, passage)
                owner = np.full(len(data), -1)
                for k, (_, _, place, n, own) in enumerate(parts):
                    owner[place:place + min(own, n - passage + 1)] = k
                owner = owner[:len(anchor)]
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
                end = np.r_[first[1:], len(anchor)]
                own = owner[first] >= 0
                first, end = first[own], end[own]
                rows, starts, places, sizes = (np.array([p[k] for p in parts]) for k in range(4))
                part = owner[first]
                row, stop = rows[part], (places + sizes)[part]
                a = anchor[first]
                fits = np.clip(stop - length + 1 - first, 0, end - first)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row)), pa.array(marks[row]), pa.array(first + (starts - places)[part]), pa.array((end - first).astype(np.int32)),
                    pa.array(fits.astype(np.int32)), pa.array((a - first).astype(np.int32)), pa.array(hashes.first(a, a + GRAM).view(np.int64)),
                    pa.array(hashes.both(first, np.minimum(end - 1 + length, stop)).view(np.int64)),
                ], ["id", "hash", "start", "size", "fits", "lead", "gram", "content"])

    return docs.select("id", "hash", "text").mapInArrow(run, _SPANS)


def _window_hashes(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """(unit, id, hash, start, core, settled, blocks, windows) from rows (id, hash, text, spans): the windows' hashes of each span.

    A span is cut where the offset of its anchor enters another step of OFFSETS. The strings of a unit share the core, the
    passage - OFFSETS + 1 bytes around the anchor that all strings of such a step share; its 64-bit hash is the unit's key.
    windows: MARK, which occurs more than once in a unit if the core is in more than one place, then the 64-bit hashes of
    the windows that start in the span. Windows are equal if their unit and all 64 bits of their own hash are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, mark, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                wanted.sort(key=lambda s: s["start"])
                at = 0
                while at < len(wanted):
                    low = wanted[at]["start"]
                    last = at
                    while last < len(wanted) and wanted[last]["start"] + wanted[last]["size"] - low <= CHUNK:
                        last += 1
                    part = wanted[at:max(last, at + 1)]
                    at = max(last, at + 1)
                    hashes = _Hashes(data[low:part[-1]["start"] + part[-1]["size"] - 1 + length])
                    for s in part:
                        start, left, fits, lead = s["start"] - low, s["size"], s["fits"], s["lead"]
                        while left:
                            step = lead // OFFSETS
                            n = min(left, lead - step * OFFSETS + 1)
                            core = start + lead - step * OFFSETS
                            key = hashes.both(np.array([core]), np.array([core - OFFSETS + 1 + passage]))
                            places = np.arange(start, start + min(n, fits))
                            own = MARK + hashes.both(places, places + length).tobytes()
                            values = (int(key.view(np.int64)[0]) ^ step, doc, mark, start + low, core + low, s["settled"], s["blocks"], own)
                            for column, value in zip(out, values):
                                column.append(value)
                            start, left, fits, lead = start + n, left - n, max(0, fits - n), lead - n
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], _UNIT_COLUMNS)

    return rows.mapInArrow(run, "unit long, id long, hash long, start long, core long, settled boolean, blocks int, windows binary")


_UNIT_COLUMNS = ["unit", "id", "hash", "start", "core", "settled", "blocks", "windows"]


def _again(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur more than once under their number; numbers are ascending."""
    order = np.argsort(values, kind="stable")  # equal values stay in order of their numbers
    values, number = values[order], number[order]
    same = (values[1:] == values[:-1]) & (number[1:] == number[:-1])
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class _Ranges:
    """Rows (id, hash, kind, first, last) found in rows of units: WINDOWS, starts of repeated windows, and PASSAGE, bytes of cores."""

    def __init__(self, core_bytes: int):
        self.core_bytes, self.columns = core_bytes, [[] for _ in range(5)]

    def add(self, doc: int | None, mark: int, start: int, core: int, again: np.ndarray) -> None:
        """again: for MARK, then for each window of the row, whether it is in another place, too."""
        found = [(PASSAGE, core, core + self.core_bytes - 1)] if again[0] else []
        found += [(WINDOWS, start + a, start + b - 1) for a, b in np.flatnonzero(np.diff(np.r_[False, again[1:], False].astype(np.int8))).reshape(-1, 2).tolist()]
        for kind, first, last in found:
            for column, value in zip(self.columns, (doc, mark, kind, first, last)):
                column.append(value)

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types)], ["id", "hash", "kind", "first", "last"])


_FOUND = "id long, hash long, kind int, first long, last long"


def _repeated_windows(units: DataFrame, core_bytes: int) -> DataFrame:
    """Ranges of windows and cores that occur in more than one place, of rows sorted by unit that are not settled."""
    def found(columns: list) -> pa.RecordBatch:
        number, ids, marks, starts, cores, settled, windows = columns
        sizes = np.array([len(w) // 8 for w in windows])
        again = _again(np.repeat(np.array(number), sizes), np.frombuffer(b"".join(windows), np.uint64))
        out, at = _Ranges(core_bytes), 0
        for doc, mark, start, core, done, n in zip(ids, marks, starts, cores, settled, sizes.tolist()):
            own = again[at:at + n]
            at += n
            if not done and own.any():
                out.add(doc, mark, start, core, own)
        return out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[] for _ in range(7)]
        unit, size, number = None, 0, -1
        for batch in batches:
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if key != unit:
                    if size > 4_000_000:
                        yield found(held)
                        held, size, number = [[] for _ in range(7)], 0, -1
                    unit, number = key, number + 1
                size += len(values[5])
                for column, value in zip(held, (number, *values)):
                    column.append(value)
        if held[0]:
            yield found(held)

    return units.mapInArrow(run, _FOUND)


def _repeated_in_blocks(units: DataFrame, core_bytes: int) -> DataFrame:
    """What _repeated_windows finds, for units of any number of rows: no task holds more than a block of a unit.

    A row's block follows from its place. Each block sorts its different windows and deals them by their hash in as many
    slices as the unit has blocks; a slice of all blocks of a unit, about as large as a block, counts its windows and tells
    each block which of them are repeated. So a unit costs a row for each block and slice, not one for each window.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.withColumn("block", F.pmod(F.xxhash64("id", "hash", "start"), F.col("blocks")).cast("int"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Rows of neighbouring equal (first, second) columns; the others as they are."""
        key, held = None, []
        for batch in batches:
            for first, second, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if (first, second) != key:
                    if held:
                        yield key, held
                    key, held = (first, second), []
                held.append(values)
        if held:
            yield key, held

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (unit, block), held in grouped(batches):
            values, times = np.unique(np.frombuffer(b"".join(w for _, w in held), np.uint64), return_counts=True)
            slices = (values % np.uint64(held[0][0])).astype(np.int64)
            order = np.argsort(slices, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
                yield pa.RecordBatch.from_pydict({
                    "unit": pa.array([unit], pa.int64()), "slice": pa.array([int(slices[part[0]])], pa.int32()), "block": pa.array([block], pa.int32()),
                    "windows": pa.array([values[part].tobytes()], pa.binary()), "again": pa.array([(times[part] > 1).tobytes()], pa.binary())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (unit, _), held in grouped(batches):
            arrays = [np.frombuffer(w, np.uint64) for _, w, _ in held]
            values, place, times = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            often = times > 1
            often[place[np.frombuffer(b"".join(a for *_, a in held), bool)]] = True
            for (block, _, _), own in zip(held, arrays):
                known = own[often[np.searchsorted(values, own)]]
                if len(known):
                    yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64()), "block": pa.array([block], pa.int32()), "known": pa.array([known.tobytes()], pa.binary())})

    blocks = rows.select("unit", "block", "blocks", "windows").repartition(n, "unit", "block").sortWithinPartitions("unit", "block")
    names = blocks.mapInArrow(named, "unit long, slice int, block int, windows binary, again binary")
    dealt = names.select("unit", "slice", "block", "windows", "again").repartition(n, "unit", "slice").sortWithinPartitions("unit", "slice")
    known = dealt.mapInArrow(counted, "unit long, block int, known binary")
    columns = ["unit", "block", "id", "hash", "start", "core", "windows", "known"]
    nothing = {"id": "long", "hash": "long", "start": "long", "core": "long", "windows": "binary"}
    known = known.select("unit", "block", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "known")
    own = rows.where(~F.col("settled")).withColumn("known", F.lit(None).cast("binary"))
    both = own.select(*columns).unionByName(known.select(*columns)).repartition(n, "unit", "block")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told, again = None, [], None
        for batch in batches:
            out = _Ranges(core_bytes)
            for unit, block, doc, mark, start, core, windows, known in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, block) != key:
                    key, told, again = (unit, block), [], None
                if windows is None:
                    told.append(known)
                elif told:
                    again = np.sort(np.frombuffer(b"".join(told), np.uint64)) if again is None else again
                    values = np.frombuffer(windows, np.uint64)
                    out.add(doc, mark, start, core, again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values)
            yield out.batch()

    # what a block is told comes before its rows
    ordered = both.sortWithinPartitions("unit", "block", F.col("windows").isNotNull())
    return ordered.mapInArrow(located, _FOUND)


def _marked(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that keys (id, hash) may hold, the others for certain), split without a shuffle of their texts.

    A bitmap of MARK_BITS bits, whatever the data, holds the hashes of all keys. At sizes that fill it, fewer documents are spared
    the join that follows; the result is the same.
    """
    place = F.pmod(F.xxhash64("id", "hash"), F.lit(MARK_BITS))
    bits = keys.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    table = np.zeros((MARK_BITS // 32_768 + 2, 4096), np.uint8)
    for r in bits.collect():
        table[r["b"]] = np.frombuffer(r["m"], np.uint8)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.column(batch.num_columns - 1).to_numpy()
                # bucket 1 holds the numbers 1 to 32,768, the least bit of each byte first
                own = table[1 + places // 32_768, places % 32_768 // 8] >> (places % 8).astype(np.uint8) & 1
                yield batch.filter(pa.array((own == 1) == wanted)).select(batch.schema.names[:-1])

        schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
        return docs.withColumn("_place", place).mapInArrow(run, schema)

    return part(True), part(False)


def repeated_ranges(docs: DataFrame, length: int = 400, passage: int = 300) -> DataFrame:
    """(id, hash, kind, first, last) from (id, hash, text): WINDOWS, starts of the strings of `length` bytes that start in another
    place too, and PASSAGE, bytes of strings of passage - OFFSETS + 1 or more bytes that are in another place too; of
    every such string of `passage` bytes so many at least are among them.

    Runs of strings whose anchor's gram occurs once are new. Of the others, runs that are equal as a whole settle each
    other, so copies cost a row for each run; the windows of runs that differ are compared one by one with one
    copy of every other run of that gram. Groups of equal windows are counted, never listed pair by pair, and
    the runs of a gram with more than UNIT_ROWS are compared in blocks.
    """
    bound_batches(docs.sparkSession)
    every = cut_lineage(spans(docs, length, passage))
    kind = F.xxhash64("size", "lead", "content")
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("n > 1")
    blocks = F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("blocks")
    # a table, so that the join may split a gram of many runs among tasks
    grams = cut_lineage(grams.select("gram", (F.col("lo") != F.col("hi")).alias("mixed"), blocks))
    again = cut_lineage(every.join(grams, "gram"))
    drop_scratch(every)
    drop_scratch(grams)
    same = ["gram", "size", "lead", "content"]
    kinds = again.groupBy(*same).agg(F.count("*").alias("times"), F.first("mixed").alias("mixed"), F.first("blocks").alias("blocks"), F.min(F.struct("id", "hash", "start")).alias("one"), F.first("fits").alias("fits"))
    kinds = cut_lineage(kinds)
    settled = again.join(kinds.where("times > 1").select(*same), same)
    windows = settled.where("fits > 0").select("id", "hash", F.lit(WINDOWS).alias("kind"), F.col("start").alias("first"), (F.col("start") + F.col("fits") - 1).alias("last"))
    passages = settled.select("id", "hash", F.lit(PASSAGE).alias("kind"), F.col("start").alias("first"), (F.col("start") + F.col("size") + (passage - 2)).alias("last"))
    open_ = kinds.where("mixed").select("one.*", "size", "fits", "lead", (F.col("times") > 1).alias("settled"), "blocks")
    core_bytes = passage - OFFSETS + 1
    few = _repeated_windows(_units(docs, open_.where("blocks = 1"), length, passage).drop("blocks"), core_bytes)
    found = windows.unionByName(passages).unionByName(few)
    many = open_.where("blocks > 1")
    if many.isEmpty():
        return found
    return found.unionByName(_repeated_in_blocks(cut_lineage(_units(docs, many, length, passage, dealt=False)), core_bytes))


def _units(docs: DataFrame, open_: DataFrame, length: int, passage: int, dealt: bool = True) -> DataFrame:
    """The rows of _window_hashes of the runs in open_, sorted by unit within partitions if dealt."""
    by_doc = open_.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "size", "fits", "lead", "settled", "blocks")).alias("spans"))
    by_doc = cut_lineage(by_doc)
    wanted = by_doc.withColumnsRenamed({"id": "_id", "hash": "_hash"})
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    texts = _marked(docs, by_doc.select("id", "hash"))[0].join(wanted, on).dropDuplicates(["id", "hash"]).select("id", "hash", "text", "spans")
    rows = _window_hashes(texts, length, passage)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "unit").sortWithinPartitions("unit") if dealt else rows


def _covered(ranges: list[tuple[int, int]]) -> int:
    """Number of places in the union of ranges (first, last)."""
    total, end = 0, -1
    for first, last in sorted(ranges):
        total += max(0, last - max(first, end + 1) + 1)
        end = max(end, last)
    return total


def _cut(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left without the bytes of the windows that start in the ranges, bytes removed, and removed runs."""
    left, removed, runs, at = [], 0, 0, -1
    end = 0
    for first, last in sorted(ranges):
        stop = last + length
        if first > end or at < 0:
            left.append(data[end:first])
            runs += 1
            removed += stop - first
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
        at = 1
    left.append(data[end:])
    return b"".join(left), removed, runs


def remove_repeats(
    docs: DataFrame, length: int = 400, passage: int = 300, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """docs without every byte covered by a string of `length` bytes that also starts anywhere else.

    Strings lie within one document each, are compared as UTF-8 bytes of the input, and may overlap. The result has the
    columns of docs, text_col cut (bytes that no longer form a character become U+FFFD), and n_bytes, n_removed, n_spans
    (maximal removed runs) and n_passage, replacing such columns; with digest it has doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and n_passage instead. n_passage tells of repeats that are too short to go, too: the bytes in strings that
    are anywhere else and long enough (see repeated_ranges). It is above 0 if a string of `passage` bytes, about 50
    words, is anywhere else, and 0 if none of passage - OFFSETS + 1 bytes is.

    A null text counts as empty. Rows equal in id and text are one document repeated, so that each of their windows
    starts elsewhere too. Ids may be null; an empty table gives an empty result.
    """
    if not OFFSETS + GRAM <= passage <= length:
        raise ValueError("passage must be between OFFSETS + GRAM and length")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_hash(text_col), F.lit(0)).alias("hash"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(rows, length, passage)
    ranges = cut_lineage(ranges.groupBy("id", "hash").agg(F.collect_list(F.struct("kind", "first", "last")).alias("_ranges")))
    made = ["n_bytes", "n_removed", "n_spans", "n_passage"]
    own = docs.select(*[c for c in docs.columns if c not in made])
    if digest:
        own = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        id_col, text_col = "doc_id", "text"
    columns = own.columns
    own = own.select(F.struct(*columns).alias("_row"), F.col(id_col).cast("long").alias("id"), F.coalesce(text_hash(text_col), F.lit(0)).alias("hash"))
    some, none = _marked(own, ranges.select("id", "hash"))
    some = some.join(ranges.withColumnsRenamed({"id": "_id", "hash": "_hash"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    none = none.withColumn("_ranges", F.lit(None).cast("array<struct<kind:int,first:bigint,last:bigint>>"))
    joined = some.select("_row.*", "_ranges").unionByName(none.select("_row.*", "_ranges"))
    kept = [c for c in joined.columns if c != "_ranges"]
    types = dict(joined.dtypes)
    last = "kept_sha256" if digest else text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(text_col), batch.column("_ranges").to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                by_kind = {k: [(r["first"], r["last"]) for r in found or () if r["kind"] == k] for k in (WINDOWS, PASSAGE)}
                left, removed, runs = _cut(data, by_kind[WINDOWS], length)
                shown = hashlib.sha256(left).hexdigest() if digest else text.as_py() if not removed else left.decode("utf-8", "replace")
                for column, value in zip(out, (len(data), removed, runs, _covered(by_kind[PASSAGE]), shown)):
                    column.append(value)
            table = pa.Table.from_batches([batch])
            others = table.select([c for c in kept if c != text_col])
            for name, values in zip(made[:3], out):
                others = others.append_column(name, pa.array(values, pa.int64()))
            others = others.append_column(last, pa.array(out[4], pa.string()))
            yield from others.append_column(made[3], pa.array(out[3], pa.int64())).to_batches()

    schema = [f"`{c}` {types[c]}" for c in kept if c != text_col] + [f"{m} long" for m in made[:3]] + [f"`{last}` string", f"{made[3]} long"]
    result = joined.mapInArrow(run, ", ".join(schema))
    return result if digest else result.select(*kept, *made)
