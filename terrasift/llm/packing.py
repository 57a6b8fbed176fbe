"""Packing token sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage

#: Words whose ids a Python worker remembers, twice: those met since the memory was last full, and those met before it.
WORDS_KEPT = 60_000
#: Characters of text that are tokenized together.
TOGETHER = 500_000
#: Pieces of one length that are numbered together.
NUMBERED_TOGETHER = 8192

_MARKS = re.compile(rb"(?<=[a-z0-9])[!-&(-/:-@\[-`{}~]+(?=[ \n])")


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a visible Latin-1 byte as itself and the n-th other one as character 256 + n."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(other)}


_BYTE_CHARACTERS = _byte_characters()


def _latin_unit(word: bytes) -> str | None:
    """A word of composed Latin letters as the model reads it, else None."""
    if word.isalpha():
        return word.decode()
    text = word.decode()
    if text.isalpha() and max(text) < "İ" and unicodedata.is_normalized("NFC", text):
        return text.lower().encode().decode("latin-1").translate(_BYTE_CHARACTERS)
    return None


_encoders: dict[str, "_WordEncoder"] = {}


class _WordEncoder:
    """Token ids of words as bytes, remembered.

    The vocabulary's tokenizer lowers case, drops white space and joins nothing across it, so a text's ids are those of its
    lower-cased words; ASCII marks other than ' and | after an ASCII letter or digit and before white space are a word of
    their own. A new word of Latin letters is one unit of the model, written with one character for each byte; others are
    encoded many at a time with a special token between them that marks where each ends.
    """

    def __init__(self, path: str, mark: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: set[bytes]) -> None:
        plain, model = [], self.tokenizer.model
        for word in words:
            unit = _latin_unit(word)
            if unit is not None:
                self.known[word] = array("I", [t.id for t in model.tokenize(unit)]).tobytes()
            elif b"<|" in word or self.mark_id is None:
                self.known[word] = self._encode(word.decode()).tobytes()
            else:
                plain.append(word)
        for at in range(0, len(plain), 1000):
            part = plain[at:at + 1000]
            ids = self._encode(self.mark.join(w.decode() for w in part))
            data, start = ids.tobytes(), 0
            for word, end in zip(part, [*(4 * np.flatnonzero(ids == self.mark_id)).tolist(), len(data)]):
                self.known[word] = data[start:end]
                start = end + 4

    def ids(self, texts: list[str]) -> list[bytes]:
        words = [_MARKS.sub(rb" \g<0>", text.encode().lower()).split() for text in texts]
        every = set().union(*words)
        if len(self.known) > WORDS_KEPT:
            self.known, self.before = {}, self.known
        for word in (new := every.difference(self.known)).intersection(self.before):
            self.known[word] = self.before[word]
        self._learn(new.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def _encoder(path: str) -> _WordEncoder:
    if path not in _encoders:
        _encoders[path] = _WordEncoder(path)
    return _encoders[path]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about TOGETHER characters at a time."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        docs.append(doc)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, *,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document: its ids (those of the text, then end_id) cut every max_tokens ids.

    Columns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and doc_tokens; with
    with_ids also ids, those bytes. A null or empty text is the end id alone. The tokenizer must be one that drops
    white space and never joins what white space parts; its file is read on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        step = 4 * max_tokens
        for docs, texts in (group for batch in batches for group in _grouped(batch)):
            out: list[list] = [[] for _ in range(6)]
            for doc, data in zip(docs, encoder.ids(texts)):
                data += last
                for at in range(0, len(data), step):
                    piece = data[at:at + step]
                    for column, value in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, piece)):
                        column.append(value)
            arrays = [pa.array(column, pa.int64()) for column in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    bound_batches(docs.sparkSession)
    schema = _PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], max_tokens: int = 2048) -> list[tuple[int, list[int]]]:
    """(number of packs, their lengths in placing order) for pieces counted by length.

    Lengths are placed longest first. All packs of one kind are handled together: the kind whose packs are shortest
    takes the next pieces, one for each of its packs; if none has room, new packs are opened. The number of kinds is
    bounded by the histogram, not by the pieces.
    """
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = max((r for r, kinds in room.items() if kinds and r >= length), default=None)
            if free is None:
                # as many new packs as the pieces fill when laid side by side
                per_pack = max_tokens // length
                full, rest = divmod(left, per_pack)
                if full:
                    room[max_tokens - per_pack * length].append((full, ((length, per_pack), None)))
                if rest:
                    room[max_tokens - rest * length].append((1, ((length, rest), None)))
                break
            packs, content = room[free].pop()
            if packs > left:
                room[free].append((packs - left, content))
                packs = left
            room[free - length].append((packs, ((length, 1), content)))
            left -= packs
    out = []
    for kinds in room.values():
        for packs, content in kinds:
            lengths: list[int] = []
            while content:
                (length, times), content = content
                lengths[:0] = [length] * times
            out.append((packs, lengths))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank) of each slot with its first sequence and its offset."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, next_rank[length], sequence, offset))
            next_rank[length] += packs
            offset += length
        sequence += packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...), each of 1 to max_tokens tokens.

    The histogram of lengths has max_tokens rows at most and is packed on the driver; pieces are numbered within their
    length and find their place by that rank. Many pieces of one length are numbered in groups of NUMBERED_TOGETHER,
    so no task sorts all of them. Ties and repeated rows are numbered in any fixed order; nulls in doc_id or start are
    ordinary values; an empty frame gives an empty one. Frames are written to the shared folder first.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= max_tokens for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    lengths, first, sequence, offset = _slots(pack_histogram(counts, max_tokens))
    groups = spark.createDataFrame([(n, -(-c // NUMBERED_TOGETHER)) for n, c in counts.items()] or [(0, 1)], "_length long, _groups long")
    dealt = pieces.join(F.broadcast(groups), F.col("length") == F.col("_length")).drop("_length")
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length"), F.col("_groups"))).drop("_groups")
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("_length"), F.col("_group").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("_length")) & (F.col("_group") == F.col("_of")))
    columns = pieces.columns
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    shift = int(max(counts.values(), default=1)) + 1
    keys = lengths * shift + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rank = table["_rank"].to_numpy()
            slot = np.searchsorted(keys, table["length"].to_numpy() * shift + rank, side="right") - 1
            table = table.drop_columns(["_rank"])
            table = table.append_column("sequence_id", pa.array(sequence[slot] + rank - first[slot], pa.int64()))
            yield from table.append_column("offset", pa.array(offset[slot], pa.int64())).to_batches()

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, **options) -> DataFrame:
    """Tokenize, cut and pack documents; see tokenize_pieces and pack."""
    return pack(tokenize_pieces(docs, tokenizer_path, max_tokens, **options), max_tokens)


def sequences(packed: DataFrame, max_tokens: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<long>) from packed pieces that carry their ids, padded unless a power of two long."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64).tolist()
                rows.append(ids if len(ids) & (len(ids) - 1) == 0 else ids + [pad_id] * (max_tokens - len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return joined.mapInArrow(run, "sequence_id long, ids array<long>")
