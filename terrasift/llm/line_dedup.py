"""Line dedup: exact repeats and near copies of lines by a segment-partition edit join, all in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_scratch, text_hash

#: Short hashes of the lines whose texts are fetched; they are broadcast, so their number is bounded.
PLACES = 1 << 18


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, runs of white space as one space, trimmed; \\n parts lines."""
    uneven = text.contains("  ")
    for space in "\t\x0b\x0c\r":
        uneven |= text.contains(space)
    even = F.when(uneven, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return F.transform(F.split(F.lower(even), "\n", -1), lambda line: F.trim(line))


def segment_keys(lines: DataFrame, most: int, own_only: bool = False) -> DataFrame:
    """(h1, key) from rows (h1, line, n): hashes of the substrings under which a line is found or looks for others.

    A line is found under its own most + 1 nearly equal segments, hashed with its length and the segment's number
    (own_only). It looks under these and, for each length from n - most to n and each segment of such lines, under those of
    its substrings that can equal that segment if the lines are at most `most` edits apart: at most i edits before
    the segment and at most most - i after it. Characters are cut from a form of four bytes each, so that no cut walks
    through the line; the substrings of a line are rows of a loop over a constant array.
    """
    parts, tries = most + 1, []
    for less in range(most + 1):
        for i in range(parts):
            low, high = max(-i, less - (most - i)), min(i, less + (most - i))
            tries += [(less, i, shift) for shift in range(low, high + 1) if not own_only or not (less or shift)]
    tried = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for a, i, s in tries])
    wide = lines.select("h1", "n", F.encode("line", "UTF-32").alias("letters"))  # once a line, below the loop
    cut = wide.select("h1", "n", "letters", F.explode(tried).alias("t"))
    other = F.col("n") - F.col("t.less")
    short = F.floor(other / parts).cast("int")
    longer = other - short * parts  # so many last segments have one character more
    length = short + F.when(F.col("t.i") >= F.lit(parts) - longer, 1).otherwise(0)
    start = short * F.col("t.i") + F.greatest(F.lit(0), longer - (F.lit(parts) - F.col("t.i"))) + F.col("t.shift")
    cut = cut.select("h1", "n", "letters", other.alias("other"), F.col("t.i").alias("i"), start.alias("start"), length.alias("length"))
    cut = cut.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    piece = F.substring(F.col("letters"), F.col("start") * 4 + 1, F.col("length") * 4)
    return cut.select("h1", F.xxhash64("other", "i", piece).alias("key"))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as the variable of a lambda function."""
    return F.transform(F.array(value), use)[0]


def _parities(values: Column) -> Column:
    """64 bits, each the parity of how many of the strings hash to it."""
    hashed = F.transform(values, lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(p), F.lit(64)).cast("int")))
    return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def signatures(line: Column) -> Column:
    """struct<one, two>: parities of a line's characters and of its pairs of neighbouring characters.

    An inserted or deleted character flips at most 1 and 3 of these bits, a replaced one 2 and 4.
    """
    def both(x: Column) -> Column:
        pairs = F.transform(x, lambda c, i: F.concat(c, F.coalesce(F.get(x, i + 1), F.lit(""))))
        return F.struct(_parities(x).alias("one"), _parities(pairs).alias("two"))

    return _bind(F.split(line, ""), both)


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, up to 16,383."""
    steps = F.array(*[F.lit(1 << k) for k in range(13, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(a.substr(F.lit(1), at + k) == b.substr(F.lit(1), at + k), at + k).otherwise(at))


def trimmed(a: Column, b: Column, most: int) -> Column:
    """struct<a, b>: the strings without what they have in common at both ends, but for most + 1 characters each."""
    def tail(s: Column) -> Column:
        x, y = F.reverse(s["a"]), F.reverse(s["b"])
        cut = F.greatest(F.lit(0), _common_prefix(x, y) - (most + 1))
        return F.struct(
            F.reverse(x.substr(cut + 1, F.length(x))).alias("a"), F.reverse(y.substr(cut + 1, F.length(y))).alias("b"))

    def head(s: Column) -> Column:
        cut = F.greatest(F.lit(0), _common_prefix(s["a"], s["b"]) - (most + 1))
        return F.struct(s["a"].substr(cut + 1, F.length(s["a"])).alias("a"), s["b"].substr(cut + 1, F.length(s["b"])).alias("b"))

    return _bind(_bind(F.struct(a.alias("a"), b.alias("b")), head), tail)


def within_edits(a: Column, b: Column, most: int) -> Column:
    """True if the strings are at most `most` edits apart; both must be longer than `most`.

    Banded bit-parallel distance: the 2 most + 1 cells around the diagonal of a column of the distance matrix are held as
    two bit vectors of vertical steps. While the band's lower edge goes down, its value grows where the diagonal step is
    not free; once it meets the last row, the value follows the horizontal steps of that row.
    """
    band, mask = 2 * most + 1, (1 << (2 * most + 1)) - 1
    full = F.lit(mask).cast("long")

    def bit(value: Column, place: Column) -> Column:
        return F.call_function("shiftright", value, place.cast("int")).bitwiseAND(F.lit(1).cast("long"))

    def step(first: Column, state: Column, column: Column) -> Column:
        at, letter = column["at"], column["letter"]
        match = F.lit(0).cast("long")
        for k in range(band):
            match = match + F.when(F.get(first, at - most + k) == letter, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        return F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["far"].alias("far"), match.alias("m"), at.alias("at"))

    def diagonal(s: Column) -> Column:
        zero = ((s["m"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["m"]).bitwiseOR(s["vn"]).bitwiseAND(full)
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["far"].alias("far"), s["at"].alias("at"), zero.alias("zero"))

    def horizontal(s: Column) -> Column:
        up = s["vn"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["vp"])).bitwiseAND(full))
        down = s["zero"].bitwiseAND(s["vp"])
        return F.struct(s["far"].alias("far"), s["at"].alias("at"), s["zero"].alias("zero"), up.alias("up"), down.alias("down"))

    def vertical(n_a: Column, s: Column) -> Column:
        turned = F.call_function("shiftright", s["zero"], F.lit(1))
        vp = s["down"].bitwiseOR(F.bitwise_not(turned.bitwiseOR(s["up"])).bitwiseAND(full))
        vn = turned.bitwiseAND(s["up"])
        edge = F.greatest(F.lit(0), F.lit(2 * most - 1) - (s["at"] - (n_a - most)))
        moved = F.when(s["at"] < n_a - most, F.lit(1) - bit(s["zero"], F.lit(2 * most))).otherwise(bit(s["up"], edge) - bit(s["down"], edge))
        return F.struct(vp.alias("vp"), vn.alias("vn"), (s["far"] + moved).cast("long").alias("far"))

    start = F.struct(F.lit(mask & ~((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).cast("long").alias("far"))

    def distance(first: Column) -> Column:
        def column(state: Column, c: Column) -> Column:
            out = _bind(_bind(step(first, state, c), diagonal), horizontal)
            return _bind(out, lambda s: vertical(F.size(first), s))

        columns = F.transform(F.split(b, ""), lambda c, i: F.struct(i.alias("at"), c.alias("letter")))
        return F.aggregate(columns, start, column)["far"]

    return (F.abs(F.length(a) - F.length(b)) <= most) & (_bind(F.split(a, ""), distance) <= most)


def near_links(lines: DataFrame, most: int = 2) -> DataFrame:
    """(a1, a2, b1, b2): every pair of different lines at most `most` edits apart, once, from rows (h1, h2, line, n).

    Only narrow rows (line hash, key) meet in the search; texts are fetched for the lines that share a key that another owns.
    The fetch is narrowed by a broadcast of at most PLACES short hashes, whatever the data.
    """
    keyed = segment_keys(lines, most)
    owned = segment_keys(lines, most, own_only=True).toDF("o1", "o_key")
    meets = (F.col("key") == F.col("o_key")) & (F.col("h1") != F.col("o1"))
    asks = cut_lineage(keyed.join(owned, meets, "left_semi"))
    owns = cut_lineage(owned.join(asks, meets, "left_semi").toDF("h1", "key"))
    ids = cut_lineage(asks.select("h1").union(owns.select("h1")).distinct())
    place = F.pmod(F.col("h1"), F.lit(PLACES))
    some = lines.withColumn("_place", place).join(F.broadcast(ids.select(place.alias("_place")).distinct()), "_place", "left_semi")
    signs = some.join(ids, "h1", "left_semi").select("h1", "h2", "line", "n", signatures(F.col("line")).alias("s"))
    signs = cut_lineage(signs.select("h1", "h2", "line", "n", F.col("s.one").alias("one"), F.col("s.two").alias("two")))
    columns = ("h1", "h2", "n", "key", "one", "two")
    a = asks.join(signs.drop("line"), "h1").select(*[F.col(c).alias(f"a_{c}") for c in columns])
    b = owns.join(signs.drop("line"), "h1").select(*[F.col(c).alias(f"b_{c}") for c in columns])
    less = F.col("a_n") - F.col("b_n")  # so many edits at least delete a character
    close = (less >= 0) & (F.bit_count(F.col("a_one").bitwiseXOR(F.col("b_one"))) <= 2 * most - less)
    close &= F.bit_count(F.col("a_two").bitwiseXOR(F.col("b_two"))) <= 4 * most - less
    once = (less > 0) | (F.col("a_h1") < F.col("b_h1")) | ((F.col("a_h1") == F.col("b_h1")) & (F.col("a_h2") < F.col("b_h2")))
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & close & once).select("a_h1", "a_h2", "b_h1", "b_h2").distinct().toDF("a1", "a2", "b1", "b2")
    texts = signs.select("h1", "h2", "line")
    pairs = pairs.join(texts.toDF("a1", "a2", "a"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "b"), ["b1", "b2"])
    ends = pairs.select("a1", "a2", "b1", "b2", trimmed(F.col("a"), F.col("b"), most).alias("_t"))
    links = cut_lineage(ends.where(within_edits(F.col("_t.a"), F.col("_t.b"), most)).select("a1", "a2", "b1", "b2"))
    for table in (asks, owns, ids, signs):
        drop_scratch(table)
    return links


def line_decisions(docs: DataFrame, most: int = 2, min_chars: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, n_lines, repeats, nears, n_links, kept_hash) for every document.

    repeats: places (from 0) of lines equal, once normalised, to an earlier line; nears: of other lines at most `most` edits
    from a different line that comes first at an earlier place, both of min_chars characters at least (2 edits in 10
    characters are a similarity of 0.8). Places are ordered by document id (null first), text hash and line number.
    n_links: links of the document's different lines. kept_hash: exclusive or of the hashes of the lines that stay. A line
    that goes always has an earlier line that it repeats or nearly repeats. Blank lines play no part; a null or blank
    text has no line and counts of 0. Documents equal in id and text are one row; an empty table gives an empty result.
    """
    if min_chars <= 3 * (most + 1):
        raise ValueError("lines must be long enough for their segments")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_hash(text_col), F.lit(0)).alias("hash"), normal_lines(F.col(text_col)).alias("lines"))
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(3), x).alias("h2"), F.length(x).alias("n")))
    narrow = cut_lineage(texts.select("id", "hash", F.coalesce(hashed, F.array()).alias("lines")))
    own = F.transform("lines", lambda x, i: F.when(x["n"] > 0, F.xxhash64(i, x["h1"], x["h2"])).otherwise(0))
    every = narrow.select(
        "id", "hash", F.size(F.filter("lines", lambda x: x["n"] > 0)).cast("long").alias("n_lines"),
        F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("all_hash")).distinct()
    long = texts.select(F.explode("lines").alias("line")).where(F.length("line") >= min_chars).distinct()
    different = cut_lineage(long.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2"), "line", F.length("line").alias("n")))
    links = near_links(different, most)
    drop_scratch(different)
    places = narrow.select("id", "hash", F.posexplode("lines").alias("pos", "l")).where("l.n > 0").select("id", "hash", "pos", "l.h1", "l.h2")
    firsts = places.groupBy("h1", "h2").agg(F.min(F.struct("id", "hash", "pos")).alias("first"), F.count("*").alias("times"))
    both = links.union(links.select("b1", "b2", "a1", "a2")).toDF("h1", "h2", "o1", "o2")
    where_first = firsts.select("h1", "h2", "first")
    linked = both.join(where_first.toDF("o1", "o2", "other"), ["o1", "o2"]).groupBy("h1", "h2").agg(F.min("other").alias("other"), F.count("*").alias("links"))
    known = firsts.join(linked, ["h1", "h2"], "left").where("times > 1 OR links IS NOT NULL")
    known = known.select("h1", "h2", "first", F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"))
    known = cut_lineage(known)  # a table, so that the join may split the places of one line among tasks
    found = places.join(known, ["h1", "h2"])
    repeat = ~F.struct("id", "hash", "pos").eqNullSafe(F.col("first"))
    found = found.select("id", "hash", "pos", repeat.alias("repeat"), (~repeat & F.col("near")).alias("gone_near"), "links", F.xxhash64("pos", "h1", "h2").alias("own"))
    # one shuffle for both: repeated documents count once, then each document's lines
    found = found.repartition("id", "hash").distinct().groupBy("id", "hash").agg(
        F.collect_list(F.when(F.col("repeat"), F.col("pos"))).alias("repeats"),
        F.collect_list(F.when(F.col("gone_near"), F.col("pos"))).alias("nears"),
        F.sum(F.when(~F.col("repeat"), F.col("links")).otherwise(0)).alias("n_links"),
        F.bit_xor(F.when(F.col("repeat") | F.col("gone_near"), F.col("own")).otherwise(0)).alias("gone_hash"),
    ).withColumnsRenamed({"id": "_id", "hash": "_hash"})
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    none = F.array().cast("array<int>")
    return every.join(found, on, "left").select(
        "id", "hash", "n_lines", F.coalesce("repeats", none).alias("repeats"), F.coalesce("nears", none).alias("nears"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("all_hash").bitwiseXOR(F.coalesce("gone_hash", F.lit(0))).alias("kept_hash"))


def dedup_lines(docs: DataFrame, most: int = 2, min_chars: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines taken out of text_col that repeat or nearly repeat an earlier line; see line_decisions.

    Blank lines stay; texts that are null or blank stay as they are; a document that loses its last line that is not
    blank goes. Columns and repeated rows stay; an empty table gives an empty result. Every line of whole texts is
    compared with those of all documents; nothing runs outside the JVM.
    """
    gone = line_decisions(docs, most, min_chars, id_col=id_col, text_col=text_col)
    gone = gone.select(F.col("id").alias("_line_id"), F.col("hash").alias("_line_hash"), "n_lines", F.concat("repeats", "nears").alias("_gone")).where(F.size("_gone") > 0)
    gone = gone.select("_line_id", "_line_hash", "_gone", (F.size("_gone") == F.col("n_lines")).alias("_all"))
    rows = docs.withColumn("_own_hash", F.coalesce(text_hash(text_col), F.lit(0)))
    on = F.col(id_col).eqNullSafe(F.col("_line_id")) & (F.col("_own_hash") == F.col("_line_hash"))
    rows = rows.join(gone, on, "left").where(~F.coalesce("_all", F.lit(False)))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    return rows.select(*[text if c == text_col else F.col(c) for c in docs.columns])
