"""Token counts of texts of any length: huge ones in overlapping chunks that are spliced where no merge can cross."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage
from .token_models import PieceModel, load

#: Characters of a chunk; texts of more are cut.
CHUNK = 65_536
#: Characters by which a chunk first reaches into the next one, and at most.
OVERLAP, MOST_OVERLAP = 256, 16_384


def seam(model: PieceModel, text: str, most: int = MOST_OVERLAP, first: int = OVERLAP) -> list[int]:
    """Places of a text, which begins at a cut, where no encoding has a token across; the overlap widens until there is one."""
    width = first
    while True:
        found = [p for p in range(1, min(width, len(text))) if model.stable(text[p - 1], text[p])]
        if found or width >= min(most, len(text)):
            return found
        width *= 4


def chunk_marks(model: PieceModel, text: str, core: int, most: int = MOST_OVERLAP) -> tuple[list, list, int]:
    """Marks of one chunk: (place, tokens before it) in its head, the same in its tail, and all its tokens.

    The chunk's own characters are text[:core], the rest is overlap. Places of the tail count from core. A mark is a stable place
    at which this encoding does have a token boundary. The tail is encoded as far as the overlap has to reach.
    """
    ahead = text[core:]
    tail = seam(model, ahead, most) if ahead else []
    width = min(len(ahead), 2 * max(tail, default=len(ahead)))
    begins = model.begins(text[:core + width])
    starts = set(begins.tolist())

    def marks(places: list[int], base: int) -> list[tuple[int, int]]:
        return [(p, int(np.searchsorted(begins, p + base))) for p in places if p + base in starts]

    return marks(seam(model, text[:most], most), 0), marks(tail, core), len(begins)


_MARKS = "array<struct<place:int,before:long>>"


def count_tokens(docs: DataFrame, model_path: str, most_tokens: int = 4096, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = MOST_OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > most_tokens) of every row, as the whole text is encoded.

    model_path is a sentencepiece BPE vocabulary; no begin, end or added tokens, no truncation; strings of special tokens are
    ordinary text. A text of more than chunk characters becomes chunks that tasks encode apart, each reaching into the
    next one. Neighbours are spliced at the first place where both have a token boundary and where the vocabulary proves it
    stable: no piece holds the two characters there one after the other, so merges on either side don't see the other side.
    The overlap widens until there is such a place; chunks that find none within `overlap` characters become one chunk and are encoded
    again. Null and empty texts are 0 bytes and 0 tokens; repeated rows stay rows of their own; other columns don't matter; an
    empty table gives an empty one. A vocabulary that isn't plain BPE proves no place, so its texts are encoded whole.
    """
    bound_batches(docs.sparkSession)
    names = ["doc_id", "row", "n_bytes", "n_tokens", "part", "text", "core"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = load(model_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            small = [t for t in texts if len(t) <= chunk or not model.proven]
            counts, rows = iter(model.count(small)), []
            for doc, text in zip(ids, texts):
                row += 1
                if len(text) <= chunk or not model.proven:
                    rows.append((doc, row, len(text.encode()), next(counts), None, None, None))
                    continue
                rows.append((doc, row, len(text.encode()), None, None, None, None))
                for part, at in enumerate(range(0, len(text), chunk)):
                    rows.append((None, row, None, None, part, text[at:at + chunk + overlap], min(chunk, len(text) - at)))
                    if len(rows) >= 16:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                        rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("core", pa.int32())])
    split_rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(split, "doc_id long, row long, n_bytes long, n_tokens long, part int, text string, core int")
    known = cut_lineage(split_rows)
    whole = known.where("part IS NULL").select("doc_id", "row", "n_bytes", "n_tokens")
    counted = splice(known.where("part IS NOT NULL").select("row", "part", "text", "core"), model_path, overlap)
    joined = whole.join(counted.select(F.col("row").alias("_row"), "spliced"), F.col("row") == F.col("_row"), "left")
    tokens = F.coalesce("n_tokens", "spliced").cast("long")
    return joined.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > most_tokens).alias("over_limit"))


def splice(chunks: DataFrame, model_path: str, overlap: int = MOST_OVERLAP) -> DataFrame:
    """(row, spliced): tokens of each text from its chunks (row, part, text with overlap, core), encoded apart.

    Runs of chunks whose seams have no common stable boundary are joined and encoded once more; a chunk of the rest keeps its marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            out = []
            for row, part, last, text, core in zip(*(batch.column(i).to_pylist() for i in range(5))):
                head, tail, n = chunk_marks(model, text, core, overlap)
                out.append((row, part, last, *([dict(place=p, before=b) for p, b in marks] for marks in (head, tail)), n))
            marks = pa.list_(pa.struct([("place", pa.int32()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), marks, marks, pa.int64()))] if out
                else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), marks, marks, pa.int64())],
                ["row", "part", "last", "head", "tail", "n"])

    def encode(parts: DataFrame) -> DataFrame:
        # chunks of one text are dealt to many tasks
        dealt = parts.repartition("row", "part").select("row", "part", "last", "text", "core")
        return cut_lineage(dealt.mapInArrow(run, f"row long, part int, last int, head {_MARKS}, tail {_MARKS}, n long"))

    order = Window.partitionBy("row").orderBy("part")

    def seams(marked: DataFrame) -> DataFrame:
        """Marked chunks with the splice behind each: the first place that its tail and the next head share."""
        ahead = marked.withColumn("_next", F.lead("head").over(order))
        shared = F.filter("tail", lambda t: F.exists("_next", lambda h: h["place"] == t["place"]))
        return ahead.withColumn("_at", F.when(F.size(shared) > 0, shared[0])).withColumn("_behind", F.when(F.col("_at").isNotNull(), F.filter("_next", lambda h: h["place"] == F.col("_at.place"))[0]["before"]))

    marked = encode(chunks.withColumn("last", F.col("part")))
    found = seams(marked)
    # a chunk belongs to the run that its nearest seam before it opened
    ends = F.max("part").over(Window.partitionBy("row"))
    broken = found.withColumn("_end", ends).where("_at IS NULL AND part < _end").select("row", "part")
    if not broken.isEmpty():
        open_seam = found.select("row", "part", F.coalesce(F.lag(F.col("_at").isNotNull()).over(order), F.lit(True)).alias("_opens"))
        runs = open_seam.withColumn("_run", F.max(F.when(F.col("_opens"), F.col("part"))).over(order)).drop("_opens")
        long_runs = runs.groupBy("row", F.col("_run")).agg(F.max("part").alias("_last")).where("_run < _last")
        members = chunks.join(runs, ["row", "part"]).join(long_runs, ["row", "_run"])
        own = F.expr("CASE WHEN part = _last THEN text ELSE left(text, core) END")
        joined = members.groupBy("row", F.col("_run").alias("part")).agg(
            F.max("_last").alias("last"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", own.alias("t")))), lambda x: x["t"]), "").alias("text"), F.sum("core").cast("int").alias("core"))
        kept = marked.join(runs.join(long_runs, ["row", "_run"]).select("row", "part"), ["row", "part"], "left_anti").select(marked.columns)
        found = seams(kept.unionByName(encode(joined)))
    behind = F.coalesce(F.lag("_behind").over(order), F.lit(0))
    return found.withColumn("_own", F.coalesce("_at.before", "n") - behind).groupBy("row").agg(F.sum("_own").alias("spliced"))
