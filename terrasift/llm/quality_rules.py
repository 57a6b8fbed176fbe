"""Quality rules: divergence of a document's histograms from its language's reference."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, lookup_join

#: References that a Python worker remembers.
LANGUAGES_HELD = 1000
#: Character classes: white space, upper case, other ASCII letter, other letter, digit, punctuation, anything else.
N_CLASSES = 7
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
#: Punctuation that is taken off before common words are counted.
_TO_SPACE = bytes(32 if chr(i) in ".,;:!?\"()" else i for i in range(256))


_ASCII_SYMBOLS = bytes(i for i in range(128) if not chr(i).isalnum())


@dataclass(frozen=True)
class Limits:
    """Verdict of the rules; distances are Jensen-Shannon distances with logarithms of base 2, so from 0 to 1."""

    class_distance: float = 0.30  # reject beyond it
    word_distance: float = 0.43  # reject beyond it
    min_chars: int = 200  # shorter texts are not judged by character classes
    min_words: int = 50  # texts of fewer words are not judged by common words
    common_words: int = 50  # words in a language's reference
    max_word_chars: int = 8  # longer words are not common words
    min_docs: int = 20  # other documents that a language needs to be judged by its own reference
    main_share: float = 0.01  # share of the documents that makes a language a main one; so there are at most 100
    prior_docs: float = 5.0  # documents of all languages that a language's character classes are mixed with


@lru_cache(1)
def _class_of() -> np.ndarray:
    """Class of each code point below 65536; the others count as anything else."""
    out = np.full(65_536, 6, np.uint8)
    for i in range(65_536):
        c = chr(i)
        if c.isspace():
            out[i] = 0
        elif c.isupper():
            out[i] = 1
        elif c.isalpha():
            out[i] = 2 if i < 128 else 3
        elif c.isdigit():
            out[i] = 4
        elif c in ".,;:'\"!?-()":
            out[i] = 5
    return out


def class_counts(text: str) -> np.ndarray:
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65_535)
    return np.bincount(_class_of()[points], minlength=N_CLASSES)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without the punctuation around them."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one of them is empty."""
    if not a.sum() or not b.sum():
        return 1.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    total = 0.0
    for x in (p, q):
        some = x > 0
        total += float((x[some] * np.log2(x[some] / m[some])).sum()) / 2
    return math.sqrt(max(0.0, total))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup_lines = 0
    lines = text.split("\n")
    if len(lines) > 1:
        for line in lines:
            if line.strip(_SPACES):
                dup_lines += line in seen
                seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), -1
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    word_chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), word_chars, sum(map(text.count, _SYMBOLS)), dup_lines, repeated


Reference = tuple[dict[bytes, int], np.ndarray, np.ndarray]
NOTHING: Reference = ({}, np.zeros(2), np.zeros(N_CLASSES))


def _key(lang_col: str) -> Column:
    """Key of a language; documents without one are a language of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("null"))


def _is_symbol(word: bytes) -> bool:
    return not word.translate(None, _ASCII_SYMBOLS)


def word_histogram(text: str, places: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words at their places, then of all other words and of words without a letter or digit."""
    return histogram(plain_words(text), places)


def histogram(found: list[bytes], places: dict[bytes, int]) -> np.ndarray:
    counts = Counter(found)
    out = np.zeros(len(places) + 2)
    for w, k in places.items():
        out[k] = counts.get(w, 0)
    out[-1] = sum(n for w, n in counts.items() if _is_symbol(w))
    out[-2] = len(found) - out.sum()
    return out


def word_counts(docs: DataFrame, limits: Limits, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n): how often each short word occurs in all documents of a language key.

    Each task adds up its documents before anything is shuffled and empties its counter when that holds 200,000 words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def emit() -> pa.RecordBatch:
            rows = []
            for lang, counts in words.items():
                for w, n in counts.items():
                    if len(w) <= 4 * limits.max_word_chars and len(s := w.decode()) <= limits.max_word_chars and s.isalpha():
                        rows.append((lang, s, n))
            columns = list(zip(*rows)) or [[], [], []]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words.setdefault(lang, Counter()).update(plain_words(text.as_py() or ""))
            if sum(map(len, words.values())) > 200_000:
                yield emit()
        yield emit()

    rows = docs.select(_key(lang_col), F.col(text_col)).mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, limits: Limits, **columns) -> DataFrame:
    """(lang, words): the most frequent short words of each language key, ties by the word; at most one row a language."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = word_counts(docs, limits, **columns).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limits.common_words)
    return top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_r", "word"))).alias("w")).select("lang", F.col("w.word").alias("words"))


def _with_row_of(docs: DataFrame, table: DataFrame, lang_col: str, id_col: str | None) -> DataFrame:
    """docs with the columns of the table's row of their language: broadcast if that has few rows, else by a salted join."""
    salt = [id_col] if id_col else [lang_col]
    return lookup_join(docs.withColumn("_lang", _key(lang_col)), table.withColumnRenamed("lang", "_lang"), table.count(), "_lang", salt)


def references(docs: DataFrame, limits: Limits = Limits(), *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n, words, by_words, by_classes) for every language key that has a word: the sums of its documents' histograms.

    n is the number of the documents in the sums.
    Every document with a word counts alike. Only texts of the same words in the same order (see plain_words) count
    once, or one text with thousands of copies would pull its language towards itself; near copies that differ in a word
    count each. To the classes of a language those of limits.prior_docs average documents of all languages are added, so
    that they matter less the more documents it has. Languages are a joined table: their number has no bound.
    """
    lists = cut_lineage(common_words(docs, limits, text_col=text_col, lang_col=lang_col))
    texts = docs.select(F.col(lang_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_salt_by"))
    texts = _with_row_of(texts, lists, lang_col, "_salt_by").select("_lang", "words", "text")

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            rows = []
            for at, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                found = plain_words(text := text.as_py() or "")
                if not found:
                    continue
                if lang not in places:
                    places[lang] = {w.encode(): k for k, w in enumerate(batch.column(1)[at].as_py() or ())}
                own = zlib.crc32(text.encode("utf-8", "replace"))
                sign = int.from_bytes(hashlib.blake2b(b" ".join(found), digest_size=8).digest(), "big", signed=True)
                words, classes = histogram(found, places[lang]), class_counts(text)
                rows.append((lang, sign, own, [*(classes / classes.sum()), *(words / words.sum())]))
            columns = list(zip(*rows)) or [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "sign", "own", "h"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            rows = [(lang, k, v) for lang, h in total.items() for k, v in enumerate(h.tolist())]
            total.clear()
            columns = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()))], ["lang", "k", "v"])

        for batch in batches:
            for lang, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[lang] = total.get(lang, 0) + h.values.to_numpy().astype(float)
            if len(total) > 10_000:
                yield emit()
        yield emit()

    rows = texts.mapInArrow(histograms, "lang string, sign long, own long, h array<float>")
    one = rows.groupBy("lang", "sign").agg(F.min_by("h", "own").alias("h")).select("lang", "h")
    total = cut_lineage(one.mapInArrow(sums, "lang string, k long, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")))
    every = np.zeros(N_CLASSES)
    for r in total.where(F.col("k") < N_CLASSES).groupBy("k").agg(F.sum("v").alias("v")).collect():
        every[r["k"]] = r["v"]
    prior = F.array(*[F.lit(float(x)) for x in limits.prior_docs * every / max(1.0, every.sum())])
    arrays = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("h")).select("lang", F.col("h.v").alias("h"))
    classes = F.zip_with(F.slice("h", 1, N_CLASSES), prior, lambda a, b: a + b)
    n = F.round(F.aggregate(F.slice("h", 1, N_CLASSES), F.lit(0.0), lambda a, x: a + x)).cast("long")
    arrays = arrays.select("lang", n.alias("n"), F.slice("h", N_CLASSES + 1, limits.common_words + 2).alias("by_words"), classes.alias("by_classes"))
    return arrays.join(lists.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), "left").select("lang", "n", "words", "by_words", "by_classes")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A reference without a document's own share, which was added up as 32-bit floats."""
    return np.maximum(total - (own / own.sum()).astype(np.float32), 0.0)


def distances(text: str, reference: Reference, leave_out: bool = False) -> tuple[float, float]:
    """(word distance, class distance); with leave_out the text is part of the reference and is taken out of it first."""
    places, by_words, by_classes = reference
    words, classes = word_histogram(text, places), class_counts(text)
    if leave_out and words.sum():
        by_words, by_classes = _without(by_words, words), _without(by_classes, classes)
    return distance(words, by_words), distance(classes, by_classes) if text else 1.0


def judge(text: str | None, by: list[Reference], limits: Limits, leave_out: bool = False) -> tuple:
    """The five base counts, base_failed, kept, class_distance and word_distance of a text, by the reference nearest in words."""
    text = text or ""
    n_words, word_chars, n_symbols, dup_lines, repeated = base_counts(text)
    base_failed = n_words < 50 or 100 * repeated > 50 * n_words
    by_word, by_class = min(distances(text, r, leave_out) for r in by)
    bad = (len(text) >= limits.min_chars and by_class > limits.class_distance) or (n_words >= limits.min_words and by_word > limits.word_distance)
    return n_words, word_chars, n_symbols, dup_lines, repeated, base_failed, not base_failed and not bad, by_class, by_word


def _reference(row: dict) -> Reference:
    if row["by_words"] is None:
        return NOTHING
    return {w.encode(): k for k, w in enumerate(row["words"] or ())}, np.array(row["by_words"]), np.array(row["by_classes"])


def main_references(known: DataFrame, limits: Limits) -> list[Reference]:
    """The references of more than limits.min_docs documents that hold limits.main_share of all at least, by language."""
    total = known.agg(F.sum("n")).first()[0] or 0
    rows = known.where((F.col("n") > limits.min_docs) & (F.col("n") >= limits.main_share * total)).orderBy("lang").collect()
    return [_reference(r.asDict()) for r in rows]


def apply_rules(
    docs: DataFrame, limits: Limits = Limits(), *, text_col: str = "text", lang_col: str = "lang", reference: DataFrame | None = None,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and word_distance.

    Columns of these names are replaced. The references are taken from docs itself unless given (columns as of references).
    A document is judged by its language's reference without the document itself, so that none vouches for itself (of texts
    of the same words, which count once, each is taken out). A language of fewer than limits.min_docs other documents has
    no reference of its own: its documents are judged by the nearest of the main languages, so a text under a wrong or
    unheard-of language is judged as what it is, and texts of a truly different, rare language go. Where a table has no
    main language either, each is judged by its own, itself included. Documents without a language are one. A null text counts as empty: all counts 0,
    base_failed, distances 1. Ties, repeated rows and ids play no part; an empty table gives an empty result. Whole
    texts are read, one at a time.
    """
    bound_batches(docs.sparkSession)
    made = [*MEASURES, "base_failed", "kept", "class_distance", "word_distance"]
    known = cut_lineage(references(docs, limits, text_col=text_col, lang_col=lang_col)) if reference is None else reference
    own_docs, main = reference is None, main_references(known, limits)
    columns = [c for c in docs.columns if c not in made or c in (text_col, lang_col)]
    packed = docs.select(F.struct(*columns).alias("_row"), F.col(lang_col).alias("_language"), F.xxhash64(text_col).alias("_salt_by"))
    own = _with_row_of(packed, known, "_language", "_salt_by").select("_row.*", F.col("_lang").alias("_key"), F.struct("n", "words", "by_words", "by_classes").alias("_ref"))
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[Reference], bool]] = {}

        def reference_of(key: str, row: pa.StructScalar) -> tuple[list[Reference], bool]:
            """References of a language, and whether its documents are taken out of them."""
            if key not in held:
                if len(held) >= LANGUAGES_HELD:
                    held.clear()
                r = row.as_py()
                own = (r["n"] or 0) > limits.min_docs
                held[key] = ([_reference(r)] if own or not main else main, own and own_docs)
            return held[key]

        for batch in batches:
            table = pa.Table.from_batches([batch]).select(columns)
            refs = batch.column(batch.num_columns - 1)
            keys = batch.column(batch.num_columns - 2).to_pylist()
            rows = []
            for at, (text, key) in enumerate(zip(batch.column(text_col), keys)):
                by, leave_out = reference_of(key, refs[at])
                rows.append(judge(text.as_py(), by, limits, leave_out))
            for name, kind, values in zip(made, types, zip(*rows) if rows else [[]] * len(made)):
                table = table.append_column(name, pa.array(values, kind))
            yield from table.to_batches()

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in columns)
    added = ", ".join([*(f"{m} long" for m in MEASURES), "base_failed boolean, kept boolean, class_distance double, word_distance double"])
    return own.mapInArrow(run, f"{schema}, {added}")


def keep_good(docs: DataFrame, limits: Limits = Limits(), **options) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return apply_rules(docs, limits, **options).where("kept").select(*docs.columns)
