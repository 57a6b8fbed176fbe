"""Alignment of two tokenizers: spans of both cut a text into groups, overlapping tokens are linked and links counted corpus-wide."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage
from .token_models import UNIT, ByteModel, PieceModel, load

#: Units whose alignment a Python worker remembers, twice: those met since the memory was last full, and those met before it.
UNITS_KEPT = 250_000
#: Longer units are aligned again each time they are met.
UNIT_CHARS = 64
#: Units that may be encoded as one text: they begin with the white space of a cut and end with other characters that decode alike.
_JOINS = re.compile(r"[ \n][^\u2581]*[^\s\u2581\u180e\u200b\ufeff]")
#: Units of a text that are put together at once.
TOGETHER = 50_000
#: Characters of texts whose new units are encoded together.
LEARNED_TOGETHER = 300_000
#: Pair counts up to this many rows are broadcast (24 bytes each); more are joined through a shuffle.
BROADCAST_PAIRS = 500_000
#: Pairs are one number: the first vocabulary's id times this, plus the second's.
SIDE = 1 << 32


def byte_ends(ids: list[int], spans: list[tuple[int, int]], token_bytes: list[bytes]) -> list[int]:
    """Byte offset at which each token ends.

    The library's spans are coarse cuts: a span that ends where the next one begins is taken as it is. Tokens that share a
    character (split multibyte characters, byte fallback) have one span together, or empty ones before it; their ends
    follow from their decoded bytes.
    """
    ends, at, first = [], 0, 0
    n = len(ids)
    for i in range(n):
        cut = spans[i][1]
        if cut <= at or (i + 1 < n and spans[i + 1][0] < cut):
            continue
        # tokens first..i cover the bytes at..cut
        if first < i:
            inside = at
            for j in range(first, i):
                inside += len(token_bytes[ids[j]])
                ends.append(inside)
        ends.append(cut)
        at, first = cut, i + 1
    for j in range(first, n):
        at += len(token_bytes[ids[j]])
        ends.append(at)
    return ends


def _align(data: bytes, a: tuple, b: tuple, a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple | None:
    """(groups text, pair numbers as bytes, tokens of a, tokens of b, groups) of one unit; None if a side doesn't decode to it."""
    a_ids, b_ids = a[0], b[0]
    if b"".join([a_bytes[i] for i in a_ids]) != data or b"".join([b_bytes[i] for i in b_ids]) != data:
        return None
    a_ends, b_ends = byte_ends(*a, a_bytes), byte_ends(*b, b_bytes)
    i = j = i0 = j0 = groups = 0
    pairs, text = [], []
    while i < len(a_ends):
        # every stretch between neighbouring cuts of either side is one overlapping pair
        pairs.append(a_ids[i] * SIDE + b_ids[j])
        ea, eb = a_ends[i], b_ends[j]
        i += ea <= eb
        j += eb <= ea
        if ea == eb:
            text.append(",".join(map(str, a_ids[i0:i])) + "|" + ",".join(map(str, b_ids[j0:j])))
            i0, j0, groups = i, j, groups + 1
    return ";".join(text), array("q", pairs).tobytes(), len(a_ids), len(b_ids), groups


class _Vocabulary:
    """Token bytes, their lengths, and ids as text before a comma or before the sign that closes their side of a group."""

    def __init__(self, token_bytes: list[bytes], sign: str):
        self.token_bytes = token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.open = np.array([f"{i}," for i in range(len(token_bytes))], object)
        self.closed = np.array([f"{i}{sign}" for i in range(len(token_bytes))], object)


class _Side:
    """The tokens of one tokenizer in many units that were encoded as one text: ids, the byte where each ends, tokens a unit."""

    def __init__(self, encoded: tuple, vocabulary: _Vocabulary, stops: np.ndarray):
        ids, spans = encoded
        self.ids = np.array(ids, np.int64)
        self.data = b"".join([vocabulary.token_bytes[i] for i in ids])
        spans = np.array(list(chain.from_iterable(spans)), np.int64).reshape(-1, 2)
        # the library's spans are taken where tokens share no character with the next or the one before
        alone = spans[:, 1] > spans[:, 0]
        alone[:-1] &= spans[1:, 0] >= spans[:-1, 1]
        alone[1:] &= spans[1:, 0] >= spans[:-1, 1]
        self.ends = np.where(alone, spans[:, 1], np.cumsum(vocabulary.lengths[self.ids]))
        upto = np.searchsorted(self.ends, stops, "right")
        self.sizes = np.diff(upto, prepend=0)
        #: every unit ends with a token
        self.whole = bool((upto > 0).all()) and bool((self.ends[upto - 1] == stops).all())


def _align_many(units: list[str], model_a: _Vocabulary, model_b: _Vocabulary, encode_a: Callable, encode_b: Callable) -> list[tuple | None]:
    """_align of each unit, computed together: units that may follow each other are encoded as one text, others one by one."""
    datas = [u.encode() for u in units]
    stops = np.cumsum([len(d) for d in datas])
    joined = "".join(units)
    side_a, side_b = (_Side(encode([joined])[0], model, stops) for encode, model in ((encode_a, model_a), (encode_b, model_b)))
    if not (side_a.whole and side_b.whole and side_a.data == side_b.data == joined.encode()):
        return [_align(d, x, y, model_a.token_bytes, model_b.token_bytes) for d, x, y in zip(datas, encode_a(units), encode_b(units))]
    cuts = np.union1d(side_a.ends, side_b.ends)
    pairs = side_a.ids[np.searchsorted(side_a.ends, cuts)] * SIDE + side_b.ids[np.searchsorted(side_b.ends, cuts)]
    common = np.intersect1d(side_a.ends, side_b.ends, assume_unique=True)
    # tokens in the order of the text: of every group the first side's, then the second's
    a_upto, b_upto = (np.searchsorted(x.ends, common) + 1 for x in (side_a, side_b))
    a_group, b_group = (np.searchsorted(common, x.ends) for x in (side_a, side_b))
    words = np.empty(len(side_a.ids) + len(side_b.ids), object)
    words[np.arange(len(side_a.ids)) + np.concatenate(([0], b_upto))[a_group]] = np.where(
        side_a.ends == common[a_group], model_a.closed[side_a.ids], model_a.open[side_a.ids])
    words[np.arange(len(side_b.ids)) + a_upto[b_group]] = np.where(
        side_b.ends == common[b_group], model_b.closed[side_b.ids], model_b.open[side_b.ids])
    words = words.tolist()
    to_word = np.cumsum(side_a.sizes + side_b.sizes).tolist()
    to_pair = (8 * np.searchsorted(cuts, stops, "right")).tolist()
    n_groups = np.diff(np.searchsorted(common, stops, "right"), prepend=0).tolist()
    data, out, w, p = pairs.tobytes(), [], 0, 0
    for w2, p2, n_a, n_b, n in zip(to_word, to_pair, side_a.sizes.tolist(), side_b.sizes.tolist(), n_groups):
        out.append(("".join(words[w:w2])[:-1], data[p:p2], n_a, n_b, n))
        w, p = w2, p2
    return out


class _Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a: ByteModel = load(a_path)
        self.b: PieceModel = load(b_path, prefix=False)
        self.words_a, self.words_b = _Vocabulary(self.a.token_bytes, "|"), _Vocabulary(self.b.token_bytes, ";")
        self.cuts = self.a.cuts_at_space and self.b.cuts_at_space
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """The text in parts at which both encodings have a boundary and which neither encodes otherwise alone."""
        return UNIT.findall(text) if self.cuts else [text]

    def align(self, units: list[str]) -> list[tuple | None]:
        together = [bool(_JOINS.fullmatch(u)) for u in units] if self.cuts else [False] * len(units)
        joined = iter(())
        if any(together):
            joined = iter(_align_many([u for u, t in zip(units, together) if t], self.words_a, self.words_b, self.a.encode, self.b.encode))
        return [next(joined) if t else self.align_one(u) for u, t in zip(units, together)]

    def align_one(self, unit: str) -> tuple | None:
        return _align(unit.encode(), self.a.encode([unit])[0], self.b.encode([unit])[0], self.a.token_bytes, self.b.token_bytes)

    def learn(self, units: set[str]) -> None:
        if len(self.known) > UNITS_KEPT:
            self.known, self.before = {}, self.known
        known = self.known
        before, short = self.before, []
        for unit in units.difference(known):
            if unit in before:
                known[unit] = before[unit]
            elif len(unit) <= UNIT_CHARS:
                short.append(unit)
        for at in range(0, len(short), 5000):
            part = short[at:at + 5000]
            known.update(zip(part, self.align(part)))

    def lookup(self, units: list[str]) -> list[tuple | None]:
        known = self.known
        return [known[u] if len(u) <= UNIT_CHARS else self.align_one(u) for u in units]


_aligners: dict[tuple[str, str], _Aligner] = {}


def _aligner(a_path: str, b_path: str) -> _Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = _Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _document(aligner: _Aligner, text: str, with_groups: bool) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pair numbers, their counts[, groups]) of one text."""
    nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)) + (("",) if with_groups else ())
    if not text:
        return nothing
    units = aligner.units(" " + text)
    n_a = n_b = n_groups = n_links = 0
    digest, pairs, counts, kept = hashlib.sha256(), np.empty(0, np.int64), np.empty(0, np.int64), []
    for at in range(0, len(units), TOGETHER):
        part = units[at:at + TOGETHER]
        aligner.learn(set(part))
        found = aligner.lookup(part)
        if None in found:
            return nothing
        n_a += sum(map(itemgetter(2), found))
        n_b += sum(map(itemgetter(3), found))
        n_groups += sum(map(itemgetter(4), found))
        groups = ";".join(map(itemgetter(0), found))
        digest.update((";" + groups if at else groups).encode())
        if with_groups:
            kept.append(groups)
        codes = np.frombuffer(b"".join(map(itemgetter(1), found)), "<i8")
        n_links += len(codes)
        more, times = np.unique(codes, return_counts=True)
        if at:
            both, place = np.unique(np.concatenate((pairs, more)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, times))).astype(np.int64)
            pairs = both
        else:
            pairs, counts = more, times
    return (n_a, n_b, n_groups, n_links, digest.hexdigest(), pairs, counts) + ((";".join(kept),) if with_groups else ())


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= LEARNED_TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Both tokenizers' tokens of a space plus each text, cut into groups where tokens of both end at the same byte.

    a_path is a byte-level vocabulary of the tokenizers library, b_path a sentencepiece one (which adds the space itself).
    One row per input row: doc_id, n_a, n_b, n_groups, n_links (overlapping token pairs), groups_sha256, pairs (distinct id
    pairs, first id * 2**32 + second id, ascending) and counts (their links in this text), row (a number of the row); with
    with_groups also groups, the text `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts that one side doesn't
    decode to (a literal U+2581, say), have no tokens: zeros and empty strings. Texts are read whole; very long ones are put
    together from units of white space and word, between which both encodings always have a boundary. A unit's
    alignment is remembered, so a word is encoded once in a while, not at every place. Repeated rows are
    rows of their own; other columns don't matter; an empty table gives an empty one. Vocabulary files are read by each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for group in _groups(texts):
                # new units of many texts are encoded together
                aligner.learn({u for t in group if t and len(t) <= LEARNED_TOGETHER for u in aligner.units(" " + t)})
                found += [_document(aligner, t, with_groups) for t in group]
            columns = list(zip(*found))
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
            for lists in columns[5:7]:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int64())))
            arrays.append(pa.array(range(row, row + len(texts)), pa.int64()))
            row += len(texts)
            if with_groups:
                arrays.append(pa.array(columns[7], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts", "row"] + (["groups"] if with_groups else [])
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>, row long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, is_best): links of each id pair over all rows; is_best if no pair of that b_id has more.

    Counts are summed within tasks before the shuffle; the highest count of a b_id is found among the distinct pairs.
    """
    links = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("_p")).select(F.col("_p.pairs").alias("pair"), F.col("_p.counts").alias("n"))
    total = links.groupBy("pair").agg(F.sum("n").alias("n"))
    total = total.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(SIDE - 1).alias("b_id"), "n")
    return total.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def score_links(aligned: DataFrame) -> DataFrame:
    """aligned (a written frame of align_documents) with n_best and count_sum, sums over the row's links.

    n_best counts links whose pair has the highest count of its b_id, ties included; count_sum adds up the pairs' counts.
    Rows without tokens have zeros. The pair counts are broadcast while they are few; otherwise rows meet them by
    a shuffle on the pair, which holds a pair once for each document.
    """
    counted = cut_lineage(pair_counts(aligned).select("pair", F.col("n").alias("_n"), "is_best"))
    few = counted.count() <= BROADCAST_PAIRS
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("_p")).select("row", F.col("_p.pairs").alias("pair"), F.col("_p.counts").alias("_times"))
    met = links.join(F.broadcast(counted) if few else counted, "pair")
    sums = met.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("is_best"), F.col("_times")).otherwise(0)).alias("n_best"), F.sum(F.col("_times") * F.col("_n")).alias("count_sum"))
    joined = aligned.drop("pairs", "counts").join(sums, F.col("row") == F.col("_row"), "left").drop("_row")
    return joined.fillna(0, ["n_best", "count_sum"])


def align_and_score(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """align_documents, written to the shared folder, with score_links."""
    return score_links(cut_lineage(align_documents(docs, a_path, b_path, **options))).drop("row")
