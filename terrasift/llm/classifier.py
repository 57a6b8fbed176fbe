"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: A token is a run of letters and digits (any non-ASCII character counts as a letter) or of other visible characters.
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # features are hashed to 2**bits weights
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2
    epochs: int = 3
    train_docs: int = 20_000  # labelled documents to learn from, those with least hash; all if there are fewer
    shards: int = 8  # learners whose weights are averaged


def features(text: str | None, bits: int) -> np.ndarray:
    """Hashed places of all tokens and pairs of neighbouring tokens of a text, repeats included.

    A window of three tokens that occurred before in the text adds the one n-gram that stands for any repetition.
    """
    tokens = _TOKEN.findall((text or "").encode("utf-8", "replace"))
    one = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)).astype(np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0x27D4EB2F) + one[2:]
    again = np.full(len(three) - len(np.unique(three)), 1 << 20, np.uint64)
    mixed = np.concatenate([one * np.uint64(0xC2B2AE3D), two, again])
    return ((mixed >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def score_text(text: str | None, weights: np.ndarray, bias: float, bits: int) -> float:
    """Probability of label 1: sparse dot product of the weights with the counts over the root of their sum."""
    at = features(text, bits)
    z = bias + (float(weights[at].sum()) / np.sqrt(len(at)) if len(at) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


def example(text: str | None, bits: int) -> np.ndarray:
    """(place, value) of a text's different features, the values their counts over the root of the sum: at most 2**bits of either."""
    at = features(text, bits)
    places, counts = np.unique(at, return_counts=True)
    return np.rec.fromarrays([places.astype(np.int32), (counts / np.sqrt(max(1, len(at)))).astype(np.float32)], dtype=_EXAMPLE)


_EXAMPLE = np.dtype([("place", "<i4"), ("value", "<f4")])


def fit_shard(examples: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after settings.epochs passes over the examples (see example, and the label), one update for each."""
    size = (1 << settings.bits) + 1  # the last place is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(z[at]) > settings.l1, w, 0.0)

    for _ in range(settings.epochs):
        for features_of, label in examples:
            # the last place is the bias
            at, x = np.append(features_of["place"], size - 1), np.append(features_of["value"].astype(np.float64), 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """Weights and bias learned from the labelled documents; the text is the only input.

    Label rows with a null id or label are ignored, repeated ones averaged. At most settings.train_docs labels are
    used, those whose ids have the least hash, so that the choice does not depend on partitions; their documents are
    split among settings.shards learners by hash, and the learners' weights are averaged. A learner holds its examples as
    the counts of their different features, at most 2**bits for a text of any length.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = known.withColumn("_hash", F.xxhash64("_id")).orderBy("_hash", "_id").limit(settings.train_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.select(F.pmod(F.col("_hash"), F.lit(settings.shards)).cast("int").alias("shard"), F.xxhash64("_hash", "_text").alias("at"), "_text", "_label")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [example(t.as_py(), settings.bits).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), batch.column(3)], ["shard", "at", "f", "label"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending")])
        examples = [(np.frombuffer(f.as_py(), _EXAMPLE), y) for f, y in zip(table["f"], table["label"].to_pylist())]
        weights, bias = fit_shard(examples, settings)
        return pa.table({"n": pa.array([len(examples)], pa.int64()), "bias": [bias], "w": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})

    made = rows.mapInArrow(hashed, "shard int, at long, f binary, label int")
    shards = made.groupBy("shard").applyInArrow(fit, "n long, bias double, w binary").collect()
    total = sum(r["n"] for r in shards)
    weights, bias = np.zeros(1 << settings.bits), 0.0
    for r in shards:
        weights += np.frombuffer(r["w"], np.float32) * (r["n"] / total)
        bias += r["bias"] * r["n"] / total
    return weights.astype(np.float32), bias


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", bits: int = 18, threshold: float = 0.3,
    score_col: str = "score", predicted_col: str = "predicted",
) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold), replacing such columns.

    Whole texts are scored. A null or empty text gets the score of the bias alone; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    weights, bias = model
    own = docs.drop(*[c for c in (score_col, predicted_col) if c != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([score_text(t.as_py(), weights, bias, bits) for t in batch.column(text_col)], np.float64)
            table = pa.Table.from_batches([batch]).append_column(score_col, pa.array(scores, pa.float64()))
            yield from table.append_column(predicted_col, pa.array((scores >= threshold).astype(np.int32), pa.int32())).to_batches()

    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes)
    return own.mapInArrow(run, f"{schema}, `{score_col}` double, `{predicted_col}` int")


def held_out(id_col: str, fold: int = 5) -> Column:
    """True for ids whose text has crc32 divisible by fold; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % fold == 0
