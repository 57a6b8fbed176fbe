"""Validity of rings, and their parts by the even-odd rule."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geometry import area, edges, perimeter, polygon_box
from terrasift.sources.scratch import cut_lineage

from .grid import box_pairs

#: Rings of up to so many points compare their edges within the row; those of longer rings meet on a grid. Both give the same.
SHORT = 64
#: Pairs of edges of short rings that a task compares at once.
PAIRS = 500_000

EDGE = ("j", "i", "n", "x", "y", "u", "v")  # number of the ring and of the edge in it, edges of the ring, both ends

RINGS = "array<array<struct<x:double,y:double>>>"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _clean(r: Column) -> Column:
    """A ring of doubles without points equal to the one after, so that no edge is a point."""
    moves = F.filter(edges(r), lambda e: (e["x"] != e["u"]) | (e["y"] != e["v"]))
    return F.transform(moves, lambda e: F.struct(e["x"].cast("double").alias("x"), e["y"].cast("double").alias("y")))


def _numbered(rings: Column) -> Column:
    """Edges of all rings: array<struct<j, i, n, x, y, u, v>> with the ring's number and number of edges."""
    def of_ring(r: Column, j: Column) -> Column:
        return F.transform(edges(r), lambda e, i: F.struct(
            j.alias("j"), i.alias("i"), F.size(r).alias("n"), e["x"].alias("x"), e["y"].alias("y"), e["u"].alias("u"), e["v"].alias("v")))

    return F.flatten(F.transform(rings, of_ring))


def _side(a: Column, x: Column, y: Column) -> Column:
    """Sign of the turn from edge a to the point (x, y)."""
    return F.signum((a["u"] - a["x"]) * (y - a["y"]) - (a["v"] - a["y"]) * (x - a["x"]))


def _cross(a: Column, b: Column) -> Column:
    """Whether the edges cross inside both."""
    return (_side(a, b["x"], b["y"]) * _side(a, b["u"], b["v"]) < 0) & (_side(b, a["x"], a["y"]) * _side(b, a["u"], a["v"]) < 0)


def _inside(a: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on edge a, but at none of its ends."""
    boxed = x.between(F.least(a["x"], a["u"]), F.greatest(a["x"], a["u"])) & y.between(F.least(a["y"], a["v"]), F.greatest(a["y"], a["v"]))
    end = ((x == a["x"]) & (y == a["y"])) | ((x == a["u"]) & (y == a["v"]))
    return boxed & ~end & (_side(a, x, y) == 0)


def _touch(a: Column, b: Column) -> Column:
    """Whether the edges share a point other than a crossing and the one that neighbours share by order."""
    def same(p: Column, x: str, y: str, q: Column, u: str, v: str) -> Column:
        return (p[x] == q[u]) & (p[y] == q[v])

    on = _inside(a, b["x"], b["y"]) | _inside(a, b["u"], b["v"]) | _inside(b, a["x"], a["y"]) | _inside(b, a["u"], a["v"])
    ends = [same(a, *p, b, *q) for p in (("x", "y"), ("u", "v")) for q in (("x", "y"), ("u", "v"))]
    apart = F.abs(a["i"] - b["i"])
    neighbours = (a["j"] == b["j"]) & ((apart == 1) | (apart == a["n"] - 1))
    twice = (ends[0] & ends[3]) | (ends[1] & ends[2])
    return on | twice | (~neighbours & (ends[0] | ends[1] | ends[2] | ends[3]))


def _before(a: Column, b: Column) -> Column:
    return (a["j"] < b["j"]) | ((a["j"] == b["j"]) & (a["i"] < b["i"]))


def edge_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): pairs of edges of one row of (keys, rings) whose boxes meet, each pair once; keys are unique.

    Edges meet on the hierarchical grid, in a unit that makes a ring's mean edge as long as its finest cell, so that rings of
    any size and system spread over many cells.
    """
    unit = 32 * F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)) / F.aggregate("rings", F.lit(0.0), lambda s, r: s + perimeter(r))
    each = rows.select(*keys, unit.alias("_unit"), F.inline(_numbered(F.col("rings"))))
    box = [f(p, q) * F.col("_unit") for f in (F.least, F.greatest) for p, q in (("x", "u"), ("y", "v"))]
    sides = [each.select(*keys, *[F.col(c).alias(f"_{side}_{c}") for c in EDGE], *[v.alias(f"_{side}{k}") for k, v in enumerate(box)]) for side in "ab"]
    pairs = box_pairs(sides[0], tuple(F.col(f"_a{k}") for k in range(4)), sides[1], tuple(F.col(f"_b{k}") for k in range(4)), keys)
    pairs = pairs.select(*keys, *[F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in EDGE]).alias(side) for side in "ab"])
    return pairs.where(_before(F.col("a"), F.col("b")))


def _flags(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, rings, ...) with self_crossing and self_touching."""
    long = _is_long()

    def some(test) -> Column:
        return F.exists("_e", lambda a: F.exists("_e", lambda b: _before(a, b) & test(a, b)))

    rest = cut_lineage(rows.where(long))
    short = rows.where(~long).withColumn("_e", _numbered(F.col("rings")))
    short = short.withColumn("self_crossing", some(_cross)).withColumn("self_touching", some(_touch)).drop("_e")
    a, b = F.col("a"), F.col("b")
    found = edge_pairs(rest.select(*keys, "rings"), keys).groupBy(*keys).agg(F.bool_or(_cross(a, b)).alias("self_crossing"), F.bool_or(_touch(a, b)).alias("self_touching"))
    return short.unionByName(rest.join(found, keys, "left").fillna(False, ["self_crossing", "self_touching"]))


def validity(rows: DataFrame, key: str | list[str] = "object_id") -> DataFrame:
    """Adds enough_points, has_area, self_crossing, self_touching and valid to rows (key, ring, ...); key is unique and not null.

    A ring touches itself where an end of an edge lies on another edge than its neighbours, and where it goes back along an
    edge (a spike). Points that repeat the one before and a last point equal to the first count once. Of a null ring all flags are null.
    """
    keys = _keys(key)
    rows = rows.withColumnRenamed("rings", "_own_rings")  # a column of the caller
    whole = rows.where("ring IS NOT NULL").withColumn("rings", F.array(_clean(F.col("ring"))))
    flagged = _flags(whole, keys)
    ring = F.col("rings")[0]
    flagged = flagged.withColumn("enough_points", F.size(ring) >= 3).withColumn("has_area", area(ring) > 0)
    flagged = flagged.withColumn("valid", F.col("enough_points") & F.col("has_area") & ~F.col("self_crossing") & ~F.col("self_touching")).drop("rings")
    return flagged.unionByName(rows.where("ring IS NULL"), allowMissingColumns=True).withColumnRenamed("_own_rings", "rings")


Point = tuple[float, float]


def _signed(r: list[Point]) -> float:
    (a, b) = r[0]
    return sum((r[k - 1][0] - a) * (y - b) - (x - a) * (r[k - 1][1] - b) for k, (x, y) in enumerate(r)) / 2


def _odd_left(p: Point, q: Point, lines: list[tuple[Point, Point]]) -> bool:
    """Whether the place just left of the middle of p -> q is inside, by the lines above it (beside it, for an upright line)."""
    t = 0 if abs(q[0] - p[0]) >= abs(q[1] - p[1]) else 1
    m, h = (p[t] + q[t]) / 2, (p[1 - t] + q[1 - t]) / 2
    above = 0
    for a, b in lines:
        if (a[t] <= m) != (b[t] <= m) and {a, b} != {p, q}:
            above += a[1 - t] + (m - a[t]) / (b[t] - a[t]) * (b[1 - t] - a[1 - t]) > h
    on_that_side = (q[t] > p[t]) == (t == 0)  # left of a line to the right is above it, left of a line upwards is beside it, to the left
    return above % 2 == (1 if on_that_side else 0)


def even_odd_parts(lines: list[tuple[Point, Point]]) -> list[tuple[list[Point], list[list[Point]]]]:
    """(outline, holes) of every region inside closed lines that meet at their ends only, by the even-odd rule.

    Outlines turn left. Going round a region always by the next line clockwise keeps to it, so regions that touch in a
    point are apart. Time grows with the lines, and with the lines times the groups of them that hang together.
    """
    around: dict[Point, list[Point]] = defaultdict(list)
    for p, q in lines:
        around[p].append(q)
        around[q].append(p)
    after: dict[tuple[Point, Point], Point] = {}
    for p, ends in around.items():
        ends.sort(key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0]))
        after.update({(q, p): ends[k - 1] for k, q in enumerate(ends)})
    walk_of: dict[tuple[Point, Point], int] = {}
    walks: list[list[Point]] = []
    for start in after:
        if start not in walk_of:
            walk, step = [], start
            while step not in walk_of:
                walk_of[step] = len(walks)
                walk.append(step[0])
                step = (step[1], after[step])
            walks.append(walk)
    odd: dict[int, bool] = {}
    for seed in range(len(walks)):
        if seed in odd:
            continue
        odd[seed], todo = _odd_left(walks[seed][0], walks[seed][1], lines), [seed]
        while todo:
            at = todo.pop()
            for k, q in enumerate(walks[at]):
                other = walk_of[q, walks[at][k - 1]]
                if other not in odd:
                    odd[other] = not odd[at]
                    todo.append(other)
    loops: list[list[Point]] = []
    for at, walk in enumerate(walks):
        if not odd[at]:
            continue
        stack: list[Point] = []
        seen: set[Point] = set()
        for p in walk:  # a walk that comes back to a point holds a loop of its own: a hole that touches its outline
            if p in seen:
                loop = [p]
                while stack[-1] != p:
                    seen.discard(stack[-1])
                    loop.append(stack.pop())
                loops.append(loop[:1] + loop[:0:-1])
            else:
                stack.append(p)
                seen.add(p)
        loops.append(stack)
    loops = [s for s in map(_straight, loops) if len(s) > 2]
    outlines = sorted((r for r in loops if _signed(r) > 0), key=min)
    parts: list[tuple[list[Point], list[list[Point]]]] = [(r, []) for r in outlines]
    for hole in (r for r in loops if _signed(r) < 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        holders = [(_signed(r), k) for k, (r, _) in enumerate(parts) if _holds(r, middle)]
        if holders:
            parts[min(holders)[1]][1].append(hole)
    return parts


def _straight(r: list[Point]) -> list[Point]:
    """The ring without points that lie straight between their neighbours."""
    return [p for k, p in enumerate(r) if (p[0] - r[k - 1][0]) * (r[(k + 1) % len(r)][1] - p[1]) != (p[1] - r[k - 1][1]) * (r[(k + 1) % len(r)][0] - p[0])]


def _holds(r: list[Point], p: Point) -> bool:
    return sum((r[k - 1][1] > p[1]) != (y > p[1]) and p[0] < (r[k - 1][0] - x) * (p[1] - y) / (r[k - 1][1] - y) + x for k, (x, y) in enumerate(r)) % 2 == 1


Edges = tuple[np.ndarray, ...]


def _ends_cut(a: Edges, b: Edges) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """_cross(a, b), _inside for both ends of b on a and of a on b, and equality of their ends, for arrays of edges (x, y, u, v)."""
    def side(e: Edges, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sign((e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]))

    def inside(e: Edges, x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> np.ndarray:
        boxed = (x >= np.minimum(e[0], e[2])) & (x <= np.maximum(e[0], e[2])) & (y >= np.minimum(e[1], e[3])) & (y <= np.maximum(e[1], e[3]))
        return boxed & (turn == 0) & ~(((x == e[0]) & (y == e[1])) | ((x == e[2]) & (y == e[3])))

    turns = [side(a, b[0], b[1]), side(a, b[2], b[3]), side(b, a[0], a[1]), side(b, a[2], a[3])]
    crossed = (turns[0] * turns[1] < 0) & (turns[2] * turns[3] < 0)
    within = [inside(e, o[k], o[k + 1], turns[t]) for t, (e, o, k) in enumerate(((a, b, 0), (a, b, 2), (b, a, 0), (b, a, 2)))]
    return crossed, within, [(a[k] == b[m]) & (a[k + 1] == b[m + 1]) for k in (0, 2) for m in (0, 2)]


def _short_parts(rings: pa.ListArray, keep_valid: bool) -> Iterator[tuple[int, list[tuple[list[Point], list[list[Point]]]]]]:
    """(row, parts) of rows of clean short rings, by the same rules as the tables of split_even_odd; keep_valid: a single valid ring is its part."""
    n_rings, inner = rings.value_lengths().to_numpy(), rings.flatten()
    n, points = inner.value_lengths().to_numpy(), inner.flatten()
    x, y = points.field("x").to_numpy(), points.field("y").to_numpy()
    start = np.cumsum(n) - n
    ring = np.repeat(np.arange(len(n)), n)
    after = np.arange(len(x)) + 1
    after[(start + n - 1)[n > 0]] = start[n > 0]
    edge = (x, y, x[after], y[after])
    row = np.repeat(np.arange(len(n_rings)), n_rings)[ring]
    i = np.arange(len(x)) - start[ring]
    stop = np.searchsorted(row, row, side="right")
    more = stop - np.arange(len(x)) - 1  # edges of the row behind this one
    first = np.searchsorted(row, np.arange(len(n_rings) + 1))
    total = np.r_[0, np.cumsum(more)][first]
    extent = np.zeros(len(n))
    if len(x):
        extent[n > 0] = np.maximum(*[np.maximum.reduceat(c, start[n > 0]) - np.minimum.reduceat(c, start[n > 0]) for c in (x, y)])
    r = 0
    while r < len(n_rings):
        until = max(int(np.searchsorted(total, total[r] + PAIRS, side="right")) - 1, r + 1)
        own = slice(first[r], first[until])
        a = np.repeat(np.arange(own.start, own.stop), more[own])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more[own]) - more[own], more[own])
        ea, eb = (tuple(c[k] for c in edge) for k in (a, b))
        crossed, within, same = _ends_cut(ea, eb)
        apart = np.abs(i[a] - i[b])
        neighbours = (ring[a] == ring[b]) & ((apart == 1) | (apart == n[ring[a]] - 1))
        touched = np.logical_or.reduce(within) | (same[0] & same[3]) | (same[1] & same[2]) | (~neighbours & np.logical_or.reduce(same))
        tangled = np.zeros(until - r, bool)
        tangled[row[a[crossed | touched]] - r] = True
        # cuts: crossings are rounded, ends of other edges are not
        (ax, ay, au, av), (bx, by, bu, bv) = (tuple(c[crossed] for c in e) for e in (ea, eb))
        s = ((bx - ax) * (bv - by) - (by - ay) * (bu - bx)) / ((au - ax) * (bv - by) - (av - ay) * (bu - bx))
        outer = np.minimum((np.cumsum(n_rings) - n_rings)[row[a[crossed]]], len(n) - 1)
        grain = extent[outer] * 2.0**-30

        def rounded(v: np.ndarray) -> np.ndarray:
            return np.sign(v) * np.floor(np.abs(v / grain) + 0.5) * grain

        px, py = rounded(ax + s * (au - ax)), rounded(ay + s * (av - ay))
        cuts = [(a[crossed], px, py), (b[crossed], px, py)]
        cuts += [(e[hit], o[k][hit], o[k + 1][hit]) for hit, (e, o, k) in zip(within, ((a, eb, 0), (a, eb, 2), (b, ea, 0), (b, ea, 2)))]
        at, px, py = (np.concatenate(c) for c in zip(*cuts))
        t = (px - x[at]) * (edge[2][at] - x[at]) + (py - y[at]) * (edge[3][at] - y[at])
        all_own = np.arange(own.start, own.stop)
        of = np.concatenate((all_own, at, all_own))
        t = np.concatenate((np.full(len(all_own), -np.inf), t, np.full(len(all_own), np.inf)))
        px, py = np.concatenate((x[own], px, edge[2][own])), np.concatenate((y[own], py, edge[3][own]))
        order = np.lexsort((py, px, t, of))
        of, px, py = of[order], px[order], py[order]
        piece = np.flatnonzero((of[1:] == of[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1])))
        flip = (px[piece] > px[piece + 1]) | ((px[piece] == px[piece + 1]) & (py[piece] > py[piece + 1]))
        low, high = np.where(flip, piece + 1, piece), np.where(flip, piece, piece + 1)
        lines = np.stack((row[of[piece]].astype(float), px[low], py[low], px[high], py[high]))
        lines = lines[:, np.lexsort(lines[::-1])]
        head = np.flatnonzero(np.r_[True, (lines[:, 1:] != lines[:, :-1]).any(0)]) if lines.shape[1] else np.zeros(0, int)
        lines = lines[:, head[np.diff(np.r_[head, lines.shape[1]]) % 2 == 1]]
        bounds = np.searchsorted(lines[0], np.arange(r, until + 1))
        flat = lines[1:].T.tolist()
        for k in range(r, until):
            p, q = first[k], first[k + 1]
            if keep_valid and not tangled[k - r] and q - p >= 3:
                own_ring = list(zip(x[p:q].tolist(), y[p:q].tolist()))
                if _signed(own_ring):
                    yield k, [(own_ring, [])]
            elif bounds[k - r] < bounds[k - r + 1] and (not keep_valid or q - p >= 3):
                yield k, even_odd_parts([((e[0], e[1]), (e[2], e[3])) for e in flat[bounds[k - r]:bounds[k - r + 1]]])
        r = until


def _ring_arrays(rings: list[list[Point]]) -> pa.ListArray:
    flat = np.array([p for r in rings for p in r], float).reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), points)


def _part_columns(found: list[tuple[int, list[tuple[list[Point], list[list[Point]]]]]], own: list[pa.Array], keys: list[str]) -> pa.RecordBatch:
    """A batch (keys, part_id, ring, holes) of rows and their parts."""
    at = pa.array([k for k, parts in found for _ in parts], pa.int64())
    number = pa.array([m for _, parts in found for m in range(len(parts))], pa.int32())
    outlines = _ring_arrays([r for _, parts in found for r, _ in parts])
    ends = pa.array(np.cumsum([0, *[len(h) for _, parts in found for _, h in parts]]), pa.int32())
    holes = pa.ListArray.from_arrays(ends, _ring_arrays([h for _, parts in found for _, holes in parts for h in holes]))
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in own], number, outlines, holes], [*keys, "part_id", "ring", "holes"])


def _parts_schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", part_id int, ring array<struct<x:double,y:double>>, holes {RINGS}"


def _split_short(rows: DataFrame, keys: list[str], keep_valid: bool = False) -> DataFrame:
    """(keys, part_id, ring, holes) of rows (keys, rings) of clean rings of at most SHORT points together, without a shuffle."""
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _part_columns(list(_short_parts(batch.column(len(keys)), keep_valid)), batch.columns[:len(keys)], keys)

    return rows.select(*keys, "rings").mapInArrow(trace, _parts_schema(rows, keys))


def _is_long() -> Column:
    return F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)) > SHORT


def split_even_odd(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part_id, ring, holes): the regions of rows (keys, rings) by the even-odd rule over all rings; keys are unique.

    Rows of at most SHORT points are cut and traced where they lie. Of the others edges are cut where they meet (pairs from edge_pairs), pieces that lie on each other an even number of times go, as both of
    their sides are alike, and what is left of one row bounds its regions. A row's pieces are one value, as its rings were.
    Crossings are rounded to 2**-30 of the rings' extent, so that lines through one point meet in one.
    """
    rows = cut_lineage(rows.select(*keys, F.transform("rings", _clean).alias("rings")))
    return _split_short(rows.where(~_is_long()), keys).unionByName(_split_long(rows.where(_is_long()), keys))


def _split_long(rows: DataFrame, keys: list[str]) -> DataFrame:
    """split_even_odd of clean rings through tables of edges, for rings of any length."""
    a, b = F.col("a"), F.col("b")
    x0, y0, x1, y1 = polygon_box(F.col("rings"))
    grain = F.greatest(x1 - x0, y1 - y0) * 2.0**-30
    each = rows.select(*keys, grain.alias("_grain"), F.inline(_numbered(F.col("rings"))))
    turn = (a["u"] - a["x"]) * (b["v"] - b["y"]) - (a["v"] - a["y"]) * (b["u"] - b["x"])
    s = ((b["x"] - a["x"]) * (b["v"] - b["y"]) - (b["y"] - a["y"]) * (b["u"] - b["x"])) / turn

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def cut(edge: Column, at: Column, exact: bool) -> Column:
        return F.struct(edge["j"].alias("j"), edge["i"].alias("i"), at.alias("p"), F.lit(exact).alias("exact"))

    crossing = point(a["x"] + s * (a["u"] - a["x"]), a["y"] + s * (a["v"] - a["y"]))
    cuts = F.array(
        *[F.when(_cross(a, b), cut(e, crossing, False)) for e in (a, b)],
        *[F.when(_inside(e, o[x], o[y]), cut(e, point(o[x], o[y]), True)) for e, o in ((a, b), (b, a)) for x, y in (("x", "y"), ("u", "v"))])
    found = edge_pairs(rows.select(*keys, "rings"), keys).select(*keys, F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c"))
    found = found.groupBy(*keys, F.col("c.j").alias("j"), F.col("c.i").alias("i")).agg(F.collect_list(F.struct("c.p", "c.exact")).alias("cuts"))
    cut_edges = each.join(found, [*keys, "j", "i"], "left")

    def rounded(v: Column) -> Column:
        return F.round(v / F.col("_grain")) * F.col("_grain")

    none = F.array().cast("array<struct<p:struct<x:double,y:double>,exact:boolean>>")
    x, y, u, v = (F.col(c) for c in "xyuv")
    places = F.transform(F.coalesce("cuts", none), lambda c: F.when(c["exact"], c["p"]).otherwise(point(rounded(c["p"]["x"]), rounded(c["p"]["y"]))))
    along = F.transform(places, lambda p: F.struct(((p["x"] - x) * (u - x) + (p["y"] - y) * (v - y)).alias("t"), p.alias("p")))
    path = F.concat(F.array(point(x, y)), F.transform(F.array_sort(along), lambda c: c["p"]), F.array(point(u, v)))
    lines = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))
    pieces = cut_edges.select(*keys, path.alias("path")).select(*keys, F.explode(lines).alias("l")).where("l.p <> l.q")
    odd = pieces.groupBy(*keys, "l").agg(F.count("*").alias("n")).where("n % 2 = 1")
    bounds = odd.groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("lines"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, lines in enumerate(batch.column(len(keys))):
                found.append((at, even_odd_parts([((e["p"]["x"], e["p"]["y"]), (e["q"]["x"], e["q"]["y"])) for e in lines.as_py()])))
            yield _part_columns(found, batch.columns[:len(keys)], keys)

    return bounds.mapInArrow(trace, _parts_schema(rows, keys))


def repair(rows: DataFrame, key: str | list[str] = "object_id") -> DataFrame:
    """(key, part_id, ring, holes): the parts of each ring of rows (key, ring) by the even-odd rule.

    A valid ring is its only part, one without area has none, nor has a null ring. Places that a ring winds round twice are
    outside; parts touch each other in points at most; spikes go. key is unique and not null.
    """
    keys = _keys(key)
    clean = cut_lineage(rows.where("ring IS NOT NULL").select(*keys, F.array(_clean(F.col("ring"))).alias("rings")))
    short = _split_short(clean.where(~_is_long()), keys, keep_valid=True)
    flagged = cut_lineage(validity(clean.where(_is_long()).select(*keys, F.col("rings")[0].alias("ring")), keys))
    whole = flagged.where("valid").select(*keys, F.lit(0).alias("part_id"), "ring", F.array().cast(RINGS).alias("holes"))
    tangled = flagged.where("enough_points AND NOT valid").select(*keys, F.array("ring").alias("rings"))
    return short.unionByName(whole).unionByName(split_even_odd(tangled, keys))
