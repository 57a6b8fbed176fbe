"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, lookup_join, text_hash

#: Ranks are first counted by this many equal steps of the ranking value, then by as many steps in the step of the cut.
STEPS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The targets share `share` times all sizes by weight; one that would pass max_copies times its source's size
    stops there and the rest is shared again. In order of capacity over weight the stopped sources come first, so
    one pass of running sums finds the common level. The frame has one row per source, and one task orders
    these rows (some 40 bytes each): the order of all sources decides on their weights.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("_rank") % len(weights) == k, F.lit(float(w))).otherwise(weight)
    ordered = ordered.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    ordered = ordered.withColumn("_full", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = Window.orderBy("_full", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    leveled = ordered.withColumn("_level", rest / left)
    level = F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_rank", "_level"))).over(every)["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return leveled.select("source", "source_size", target.alias("target"))


def preference(size: Column) -> Column:
    """Weight of a document inside its source: the binary digits of its size, so longer documents are likelier to be taken."""
    return F.length(F.bin(size)).cast("long")


def inclusion_levels(sizes: DataFrame, sources: DataFrame, n_sources: int, max_copies: int) -> DataFrame:
    """sources with _level and _want: a document's expected copies are the lesser of max_copies and _level times its weight.

    The level is such that the expected words of a source are its target. Documents of one weight are handled together:
    at most 64 rows a source. In falling order of weight those that reach max_copies come first, so one pass of
    running sums finds the level; null if all reach it. _want: words still wanted after the whole copies.
    """
    kinds = sizes.groupBy("source", preference(F.col("size")).alias("_w")).agg(F.sum("size").alias("_words"))
    kinds = lookup_join(kinds, sources, n_sources, "source", ["_w"])
    own = Window.partitionBy("source")
    before = own.orderBy(F.desc("_w")).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("target") - F.lit(max_copies) * F.coalesce(F.sum("_words").over(before), F.lit(0))
    weight = F.sum(F.col("_words") * F.col("_w")).over(own) - F.coalesce(F.sum(F.col("_words") * F.col("_w")).over(before), F.lit(0))
    leveled = kinds.withColumn("_at", F.when(weight > 0, rest / weight))
    level = F.max(F.when(F.col("_at") * F.col("_w") <= max_copies, F.struct("_w", "_at"))).over(own)["_at"]
    leveled = leveled.withColumn("_level", level)
    whole = F.floor(_copies(F.col("_level"), F.col("_w"), max_copies))
    return leveled.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_level").alias("_level"),
        (F.first("target") - F.sum(whole * F.col("_words"))).alias("_want"))


def _copies(level: Column, weight: Column, max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.coalesce(level * weight, F.lit(float(max_copies))))


def _ranked(rows: DataFrame, sources: DataFrame, n_sources: int, seed: int, max_copies: int) -> DataFrame:
    """Rows with their whole copies, inclusion probability and ranking value _x in (0, 1), small values first.

    _x is q / (1 + q) for q = odds of a uniform number / odds of inclusion, so it orders rows as q does.
    """
    joined = lookup_join(rows, sources, n_sources, "source", ["id", "hash"])
    copies = F.when(F.col("source_size") > 0, _copies(F.col("_level"), preference(F.col("size")), max_copies)).otherwise(F.lit(0.0))
    joined = joined.withColumn("_copies", copies).withColumn("_whole", F.floor("_copies"))
    joined = joined.withColumn("_p", F.col("_copies") - F.col("_whole"))
    u = _uniform(F.col("id"), seed)
    q = (u / (F.lit(1.0) - u)) / (F.col("_p") / (F.lit(1.0) - F.col("_p")))
    joined = joined.withColumn("_q", F.when(F.col("_p") > 0, q))
    return joined.withColumn("_x", F.col("_q") / (F.lit(1.0) + F.col("_q"))).drop("_copies", "_q")


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source, _cut_step, _cut): a row is taken if its step is below _cut_step, or equal and its order <= _cut.

    The words still wanted of a source after whole copies are filled in ranking order, up to the document whose end
    lies nearest. Sizes are first summed by step of _x (at most STEPS rows per source), then by step within the one
    step that holds the cut, and only the rows of one of those finer steps are put in order, so that no task ever
    sorts a source.
    """
    rows = ranked.where(F.col("_x").isNotNull())
    fine = F.least(F.floor(F.col("_x") * (STEPS * STEPS)), F.lit(STEPS * STEPS - 1)).cast("long")
    rows = rows.select("source", "_want", "id", "size", "hash", "_x", fine.alias("_fine"))
    rows = rows.withColumn("_coarse", F.floor(F.col("_fine") / STEPS))

    def crossing(frame: DataFrame, step: str) -> DataFrame:
        sums = frame.groupBy("source", step).agg(F.sum("size").alias("_s"), F.max("_want").alias("_want"))
        run = Window.partitionBy("source").orderBy(step)
        sums = sums.withColumn("_end", F.sum("_s").over(run))
        past = sums.where(F.col("_end") >= F.col("_want")).groupBy("source").agg(
            F.min(F.struct(step, (F.col("_want") - (F.col("_end") - F.col("_s"))).alias("_want"))).alias("_m"))
        return past.select(F.col("source").alias("_source"), F.col(f"_m.{step}").alias("_at"), F.col("_m._want").alias("_rest"))

    def inside(frame: DataFrame, at: DataFrame, step: str) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col("_source")) & (F.col(step) == F.col("_at"))
        return frame.join(at, on).select("source", F.col("_rest").alias("_want"), "id", "size", "hash", "_x", "_fine")

    coarse = cut_lineage(inside(rows, crossing(rows, "_coarse"), "_coarse"))
    last = inside(coarse, crossing(coarse, "_fine"), "_fine")
    run = Window.partitionBy("source").orderBy("_x", F.col("id").asc_nulls_first(), "size", "hash").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_end", F.sum("size").over(run)).withColumn("_order", F.struct("_x", "id", "size", "hash"))
    taken = (F.col("_end") <= F.col("_want")) | (
        (F.col("_end") - F.col("size") < F.col("_want")) & (F.col("_end") - F.col("_want") <= F.col("_want") - F.col("_end") + F.col("size")))
    return last.groupBy("source").agg(F.max("_fine").alias("_cut_step"), F.max(F.when(taken, F.col("_order"))).alias("_cut"))


def allocate(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_copies: int = 2, *,
    seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = True,
) -> DataFrame:
    """The mix: every row of docs with its size, source_size, target and number of copies.

    Size: words of the text. Sources in code point order (null last) take the weights in turn, see source_targets.
    A document's expected copies grow with its weight (see preference) up to max_copies and sum up to the target (see
    inclusion_levels). It gets their whole part for certain; one more copy goes to a Pareto sample of the documents: ranked by
    the odds of a uniform number over the odds of the fraction that is left, and taken in that order until the source's
    words are nearest to its target, so the sample's size is fixed and misses it by half a document at most. A null text has size 0; a null source is a source of its own; rows that share an id share the random number
    and are ordered by size and text; rows equal in all three get the same copies. An empty table gives an empty one.

    With keep, the rows keep their own columns (apart from clashing ones); else the result has the columns
    id, size, source_size, target, copies and nothing of the text is shuffled.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.coalesce(text_hash(text_col), F.lit(0)).alias("hash"))
    rows = cut_lineage(narrow)
    sources = cut_lineage(source_targets(rows, weights, share, max_copies))
    n_sources = sources.count()
    sources = cut_lineage(inclusion_levels(rows, sources, n_sources, max_copies))
    cuts = _cuts(_ranked(rows, sources, n_sources, seed, max_copies))
    table = sources.join(cuts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    table = cut_lineage(table)
    if keep:
        made = ["size", "source_size", "target", "copies"]
        own = [c for c in docs.columns if c not in made]
        rows = docs.select(
            F.struct(*own).alias("_row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"), F.coalesce(text_hash(text_col), F.lit(0)).alias("hash"))
    ranked = _ranked(rows, table, n_sources, seed, max_copies)
    step = F.least(F.floor(F.col("_x") * (STEPS * STEPS)), F.lit(STEPS * STEPS - 1)).cast("long")
    order = F.struct("_x", "id", "size", "hash")
    # no cut although words are wanted: every document of the source gets its further copy
    more = F.when(F.col("_x").isNull(), F.lit(False)).when(F.col("_cut_step").isNull(), F.lit(True)).otherwise(
        (step < F.col("_cut_step")) | ((step == F.col("_cut_step")) & F.coalesce(order <= F.col("_cut"), F.lit(False))))
    ranked = ranked.withColumn("copies", F.col("_whole") + more.cast("int"))
    out = ["size", "source_size", "target", "copies"]
    return ranked.select("_row.*", *out) if keep else ranked.select("id", *out)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as many times as allocate says, with the columns of docs."""
    copies = allocate(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(options.get("id_col", "doc_id")).alias("_id"),
                                  F.col(options.get("text_col", "text")).alias("_text"), F.col(options.get("source_col", "source")).alias("_source")),
                      **{**options, "id_col": "_id", "text_col": "_text", "source_col": "_source"})
    times = copies.where(F.col("copies") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select("_doc.*")
