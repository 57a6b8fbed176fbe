"""Spatial joins keyed by tiles and grid cells: objects, rasters, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.sources.scratch import cut_lineage

from .grid import box_pairs, levels_of
from .validity import split_even_odd

Box = tuple[Column, Column, Column, Column]
#: Members that one row of gathered lists, about.
MEMBERS = 1000


def utm_box() -> Box:
    """Centre and half sides (cx, cy, hw, hh) of an object's box in its raster's system, from columns epsg and raster_epsg.

    The corners are reprojected and bounded again; null if a system is not known.
    """
    corners = G.ring(*[(F.col("cx") + a * F.col("hw"), F.col("cy") + b * F.col("hh")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])

    def bounded(r: Column) -> Column:
        x0, y0, x1, y1 = G.box(r)
        return F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), ((x1 - x0) / 2).alias("hw"), ((y1 - y0) / 2).alias("hh"))

    moved = F.transform(F.array(G.reproject_ring(corners, F.col("epsg"), F.col("raster_epsg"))), bounded)[0]
    return moved["cx"], moved["cy"], moved["hw"], moved["hh"]


def _own_box() -> Box:
    return F.col("cx"), F.col("cy"), F.col("hw"), F.col("hh")


def _used_box(fallback: Callable[[], Box]) -> Box:
    """The reprojected box of matches that used the fallback, else the object's own."""
    return tuple(F.when(F.col("used_crs_fallback"), new).otherwise(old) for new, old in zip(fallback(), _own_box()))


def _bounds() -> tuple[Column, Column, Column, Column]:
    """A raster's bounds."""
    return F.col("x_left"), F.col("y_top") - F.col("height") * F.col("px"), F.col("x_left") + F.col("width") * F.col("px"), F.col("y_top")


def _pairs(objects: DataFrame, rasters: DataFrame, box: Callable[[], Box], exact: Column | None) -> DataFrame:
    """Objects and rasters of one layer that meet: by their boxes on a grid, then, given exact rings, by those.

    Where the box follows from the raster's own system (raster_epsg), objects first take each of their layer's systems.
    """
    r = rasters.select("region_id", "modality", "raster_id", "file_ord", "px", "width", "height", "x_left", "y_top", *[c for c in ("raster_epsg",) if c in rasters.columns])
    on = ["region_id", "modality"]
    if "raster_epsg" in r.columns:
        objects = objects.join(r.select(*on, "raster_epsg").distinct(), on)
        objects, r, on = objects.withColumn("_epsg", F.coalesce("raster_epsg", F.lit(-1))), r.withColumn("_epsg", F.coalesce("raster_epsg", F.lit(-1))).drop("raster_epsg"), [*on, "_epsg"]
    cx, cy, hw, hh = box()
    pairs = box_pairs(objects, (cx - hw, cy - hh, cx + hw, cy + hh), r, _bounds(), on, levels_of(r, _bounds()))
    return pairs if exact is None else pairs.where(G.meets_rectangle(exact, *_bounds()))


def _exact(objects: DataFrame, fallback: bool) -> Column | None:
    if "ring" not in objects.columns:
        return None
    return G.reproject_ring(F.col("ring"), F.col("epsg"), F.col("raster_epsg")) if fallback else F.col("ring")


def match_rasters(objects: DataFrame, rasters: DataFrame, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """(object_id, raster_id, used_crs_fallback): the first raster that an object meets; only if none, the first after reprojection.

    fallback gives the box in the raster's system; the default reprojects from epsg to raster_epsg. Objects with a column
    ring are held exactly against the raster's bounds after their boxes. Boxes meet bounds on a grid within region and modality, so a
    layer may have any number of rasters; of those met the first in file order is kept by an aggregate.
    """
    def first(pairs: DataFrame, used: bool) -> DataFrame:
        best = pairs.groupBy("object_id").agg(F.min_by("raster_id", "file_ord").alias("raster_id"))
        return best.withColumn("used_crs_fallback", F.lit(used))

    own = first(_pairs(objects, rasters, _own_box, _exact(objects, False)), False)
    rest = objects.join(own.select("object_id"), "object_id", "left_anti")
    return own.unionByName(first(_pairs(rest, rasters, fallback, _exact(objects, True)), True))


def match_layer(objects: DataFrame, rasters: DataFrame, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """(object_id, raster_id, used_crs_fallback) pairs; a layer (region, modality) is reprojected only if none of its objects meets a raster."""
    columns = ["object_id", "raster_id"]
    own = _pairs(objects, rasters, _own_box, _exact(objects, False)).select("region_id", "modality", *columns)
    layers = own.select("region_id", "modality").distinct()
    rest = objects.join(layers, ["region_id", "modality"], "left_anti")
    other = _pairs(rest, rasters, fallback, _exact(objects, True))
    return own.select(*columns, F.lit(False).alias("used_crs_fallback")).unionByName(other.select(*columns, F.lit(True).alias("used_crs_fallback")))


def reproject(objects: DataFrame, target_epsg: int) -> DataFrame:
    """Objects with rings (ring, epsg) in another system, and status ok or failed; no change if the system is null or the same.

    Geographic WGS 84 and its UTM zones are known; a ring of another system is null and its status failed.
    """
    ring = G.reproject_ring(F.col("ring"), F.col("epsg"), F.lit(target_epsg))
    fine = F.coalesce(F.col("epsg") == target_epsg, F.lit(True)) | (G.known_crs(F.col("epsg")) & G.known_crs(F.lit(target_epsg)))
    return objects.withColumn("ring", F.when(fine, ring)).withColumn("status", F.when(fine, "ok").otherwise("failed"))


def alignment_report(objects: DataFrame, rasters: DataFrame, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """Per region and modality: objects, objects that meet a raster, whether the fallback was used, both bounds and status."""
    pairs = match_layer(objects, rasters, fallback)
    met = pairs.groupBy("object_id").agg(F.bool_or("used_crs_fallback").alias("fb"))
    rows = objects.join(met, "object_id", "left")
    report = rows.groupBy("region_id", "modality").agg(
        F.count("*").alias("n_objects"), F.count("fb").alias("n_intersecting"), F.coalesce(F.bool_or("fb"), F.lit(False)).alias("used_fallback"),
        F.min(F.col("cx") - F.col("hw")).alias("minx"), F.max(F.col("cx") + F.col("hw")).alias("maxx"),
        F.min(F.col("cy") - F.col("hh")).alias("miny"), F.max(F.col("cy") + F.col("hh")).alias("maxy"))
    bounds = rasters.groupBy("region_id", "modality").agg(
        F.min("x_left").alias("raster_minx"), F.max(F.col("x_left") + F.col("width") * F.col("px")).alias("raster_maxx"),
        F.min(F.col("y_top") - F.col("height") * F.col("px")).alias("raster_miny"), F.max("y_top").alias("raster_maxy"))
    return report.join(bounds, ["region_id", "modality"], "left").withColumn("status", F.when(F.col("n_intersecting") == 0, "no_overlap").when(F.col("used_fallback"), "fallback").otherwise("ok"))


def choose_tile_size(rasters: DataFrame, candidates: tuple[int, ...] = (1024, 1536, 2048, 3072, 4096)) -> DataFrame:
    """Rasters with the tile size nearest to the modality's context in pixels, the smaller of equals."""
    context = F.when(F.col("modality") == "Li", 250).when(F.col("modality") == "Ae", 600).when(F.col("modality") == "SpOr", 1200).when(F.col("modality") == "Or", 250).otherwise(300)
    want = context / F.col("px")
    options = F.array(*[F.struct(F.abs(F.lit(c) - want).alias("d"), F.lit(c).alias("c")) for c in candidates])
    return rasters.withColumn("tile", F.array_min(options)["c"])


def tile_starts(size: Column, tile: Column, stride: Column) -> Column:
    """0, stride, ... while a tile fits, and the start of the tile that ends at the border."""
    steps = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), stride)
    return F.array_distinct(F.concat(steps, F.array(F.greatest(size - tile, F.lit(0)))))


def with_stride(rasters: DataFrame, overlap: float = 0.25) -> DataFrame:
    return rasters.withColumn("stride", F.col("tile") - F.floor(F.col("tile") * F.lit(overlap)).cast("int"))


def tile_grid(rasters: DataFrame, overlap: float = 0.25) -> DataFrame:
    """One row per tile of rasters with a tile size: (raster_id, tx, ty, x0, y0, tile, edge)."""
    sized = with_stride(rasters, overlap)
    xs, ys = (tile_starts(F.col(c), F.col("tile"), F.col("stride")) for c in ("width", "height"))
    rows = sized.select("*", F.posexplode(xs).alias("tx", "x0")).select("*", F.posexplode(ys).alias("ty", "y0"))
    edge = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x0") + F.col("tile") >= F.col("width")) | (F.col("y0") + F.col("tile") >= F.col("height"))
    return rows.select("raster_id", "tx", "ty", "x0", "y0", "tile", edge.alias("edge"))


def pixel_box(matched: DataFrame, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """Adds the box of an object in pixels of its raster (floored): c0, r0, c1, r1."""
    cx, cy, hw, hh = _used_box(fallback)

    def column(x: Column) -> Column:
        return F.floor((x - F.col("x_left")) / F.col("px")).cast("long")

    def row(y: Column) -> Column:
        return F.floor((F.col("y_top") - y) / F.col("px")).cast("long")

    return matched.select(
        "*", column(cx - hw).alias("c0"), row(cy + hh).alias("r0"), column(cx + hw).alias("c1"), row(cy - hh).alias("r1"))


def _places(low: Column, high: Column, size: Column) -> Column:
    """Numbers of the tiles along an axis that the span [low, high] touches, from the tile rule alone.

    Starts are the multiples of the stride while a tile fits, and last the clamped start if it is not one of them.
    """
    tile, stride = F.col("tile"), F.col("stride")
    last_start = F.greatest(size - tile, F.lit(0))
    regular = F.floor(last_start / stride)  # number of the last regular start
    first = F.greatest(F.lit(0), F.ceil((low - tile + 1) / stride))
    last = F.least(regular, F.floor(high / stride))
    inside = F.when((first <= last) & (high >= 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    clamped = (last_start % stride != 0) & (high >= last_start) & (low <= last_start + tile - 1)
    return F.when(clamped, F.concat(inside, F.array(regular + 1))).otherwise(inside)


def tile_objects(matched: DataFrame, tiles: DataFrame) -> DataFrame:
    """Matched objects (with pixel boxes, tile and stride) joined to the tiles that they touch, on raster and tile numbers."""
    spread = matched.withColumn("tx", F.explode(_places(F.col("c0"), F.col("c1"), F.col("width"))))
    spread = spread.withColumn("ty", F.explode(_places(F.col("r0"), F.col("r1"), F.col("height"))))
    grid = tiles.select("raster_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "x0", "y0")
    return spread.join(grid, ["raster_id", "tx", "ty"])


def box_labels(hits: DataFrame, min_area: int = 80) -> DataFrame:
    """Boxes clipped to their tile, in pixels from its corner, with edge flag and normalised centre and size; slivers go."""
    last = F.col("tile") - 1

    def inside(v: Column, start: Column) -> Column:
        return F.least(F.greatest(v - start, F.lit(0)), last)

    rows = hits.select(
        "object_id", "raster_id", "modality", "class_name", "x0", "y0", "tile",
        inside(F.col("c0"), F.col("x0")).alias("x1"), inside(F.col("r0"), F.col("y0")).alias("y1"),
        inside(F.col("c1"), F.col("x0")).alias("x2"), inside(F.col("r1"), F.col("y0")).alias("y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = rows.where((w > 1) & (h > 1) & (w * h >= min_area))
    edge = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x2") >= last) | (F.col("y2") >= last)
    tile = F.col("tile")
    return rows.select(
        "*", edge.alias("edge"), ((F.col("x1") + F.col("x2")) / 2 / tile).alias("xc"), ((F.col("y1") + F.col("y2")) / 2 / tile).alias("yc"),
        (w / tile).alias("w"), (h / tile).alias("h"))


def clip_parts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part_id, ring, holes): the parts of polygons within their tile, for hits with rings, x0, y0 and tile in pixels of the raster.

    keys tell the hits apart. Polygons that lie in their tile are their only part. The others' rings are clipped as columns; only where two edges lie on one border of the tile can the rest have
    fallen apart (concave shapes, cut holes), and only these are traced by the even-odd rule. Polygons are valid; null
    and empty ones, and those that only touch the tile, have no part.
    """
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    x1, y1 = x0 + F.col("tile"), y0 + F.col("tile")
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    rows = hits.where("size(rings) > 0").withColumn("rings", rings)
    a, b, c, d = G.polygon_box(F.col("rings"))
    rows = rows.withColumn("_in", F.coalesce((a >= x0) & (b >= y0) & (c <= x1) & (d <= y1), F.lit(False)))
    rows = G.clip_passes(rows, "rings", x0, y0, x1, y1, F.col("_in"))
    lines = F.flatten(F.transform("rings", G.edges))

    def along(a: str, b: str, bound: Column) -> Column:
        return F.size(F.filter(lines, lambda e: (e[a] == bound) & (e[b] == bound)))

    whole = F.col("_in") | (F.greatest(along("x", "u", x0), along("x", "u", x1), along("y", "v", y0), along("y", "v", y1)) < 2)
    # the condition comes after the table: pushed below the passes it would put their expressions into each other
    rows = cut_lineage(rows.select(*keys, "rings", whole.alias("_whole"))).where("size(rings) > 0")
    ring = F.col("rings")[0]
    one = rows.where(F.col("_whole") & (G.area(ring) > 0))
    one = one.select(*keys, F.lit(0).alias("part_id"), ring.alias("ring"), F.slice("rings", F.lit(2), F.size("rings") - 1).alias("holes"))
    return one.unionByName(split_even_odd(rows.where("NOT _whole").select(*keys, "rings"), keys))


def used_rings() -> Column:
    """The rings (columns rings, epsg, raster_epsg) in the raster's system: reprojected where the match used the fallback."""
    moved = F.transform("rings", lambda r: G.reproject_ring(r, F.col("epsg"), F.col("raster_epsg")))
    return F.when(F.col("used_crs_fallback"), moved).otherwise(F.col("rings"))


def part_labels(hits: DataFrame, rings: Callable[[], Column] = used_rings, min_area: int = 80) -> DataFrame:
    """box_labels of every part that a tile cuts from the polygons of hits (tile_objects), one row a part.

    rings gives the polygons (array of rings) in the raster's system; the default reads columns rings, epsg and raster_epsg.
    (object_id, raster_id, x0, y0) tells hits apart.
    """
    keys = ["object_id", "raster_id", "x0", "y0"]
    px = F.col("px")
    moved = F.transform(rings(), lambda r: F.transform(r, lambda p: F.struct(((p["x"] - F.col("x_left")) / px).alias("x"), ((F.col("y_top") - p["y"]) / px).alias("y"))))
    rows = hits.withColumn("rings", moved).select(*keys, "modality", "class_name", "tile", "rings")
    about = ["modality", "class_name", "tile"]
    parts = clip_parts(rows, [*keys, *about])
    box = G.box(F.col("ring"))
    bounds = [F.floor(v).cast("long").alias(n) for v, n in zip(box, ("c0", "r0", "c1", "r1"))]
    return box_labels(parts.select(*keys, *about, *bounds), min_area)


def labelled_tiles(
    objects: DataFrame, rasters: DataFrame, fallback: Callable[[], Box] = utm_box, rings: Callable[[], Column] | None = None,
) -> DataFrame:
    """Box labels of all objects over the tile grid: layer match, tile grid, tile join, labels.

    With rings (see part_labels; used_rings is its default) every clipped part has a box of its own, without it the object's box is cut.
    """
    sized = with_stride(choose_tile_size(rasters))
    pairs = match_layer(objects, rasters, fallback)
    matched = pairs.join(objects, "object_id").join(sized.drop("region_id", "region", "modality"), "raster_id")
    hits = tile_objects(pixel_box(matched, fallback), tile_grid(choose_tile_size(rasters)))
    return box_labels(hits) if rings is None else part_labels(hits, rings)


def _object_box() -> tuple[Column, Column, Column, Column]:
    return F.col("cx") - F.col("hw"), F.col("cy") - F.col("hh"), F.col("cx") + F.col("hw"), F.col("cy") + F.col("hh")


def gathered(frame: DataFrame, member: str) -> DataFrame:
    """Rows that are equal but for the column `member` (an id) as one row, whose `member` is the list of theirs.

    Of more than MEMBERS equal rows several rows are made, each with about MEMBERS ids, so that no list grows with the table.
    Nulls are equal. F.explode of the list gives the rows back, once each.
    """
    by = [c for c in frame.columns if c != member]
    large = frame.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_n")).where(F.col("_n") > MEMBERS)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    deal = F.pmod(F.xxhash64(member), F.ceil(F.coalesce("_n", F.lit(1)) / MEMBERS))
    dealt = frame.join(F.broadcast(large), same, "left").select(*frame.columns, deal.alias("_deal"))
    # in structs, as lists of values leave out null ones
    lists = dealt.groupBy(*by, "_deal").agg(F.collect_list(F.struct(F.col(member).alias("_m"))).alias(member)).drop("_deal")
    return lists.withColumn(member, F.transform(member, lambda m: m["_m"]))


def window_pairs(windows: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """Objects of each window: (window columns, object columns, rings in pixels of the window).

    windows: the columns `on`, c0, r0 and crop_size (pixels of the raster), px, x_left, y_top, and any others; each has its own size. objects: `on`,
    rings (array of rings; or ring, one outer ring), cx, cy, hw, hh (box) and any others, in the raster's system. Names other than `on`
    must differ. Boxes meet on a hierarchical grid, so no object enters more than a fixed number of cells however large it is,
    then rings (holes count as outside) are held against the window exactly, borders included, but where the window spans the outer
    ring's bounds along one axis and meets them along the other: a closed line that runs from bound to bound meets it. Objects without a
    ring meet nothing.
    """
    px = F.col("px")
    wx0, wy1 = F.col("x_left") + F.col("c0") * px, F.col("y_top") - F.col("r0") * px
    wx1, wy0 = wx0 + F.col("crop_size") * px, wy1 - F.col("crop_size") * px
    if "rings" not in objects.columns:
        objects = objects.withColumn("rings", F.array("ring")).drop("ring")
    outer, endless = F.get("rings", F.lit(0)), F.lit(float("inf"))
    line = (F.size(outer) > 2) & F.forall(outer, lambda p: (F.abs(p["x"]) < endless) & (F.abs(p["y"]) < endless))
    bounds = [F.when(line, c).alias(f"_r{k}") for k, c in enumerate(G.box(outer))]
    boxed = objects.select("*", *[c.alias(n) for c, n in zip(_object_box(), ("_x0", "_y0", "_x1", "_y1"))], *bounds).drop("cx", "cy", "hw", "hh")
    pairs = box_pairs(windows, (wx0, wy0, wx1, wy1), boxed, tuple(F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")), on).drop("_x0", "_y0", "_x1", "_y1")
    rx0, ry0, rx1, ry1 = (F.col(f"_r{k}") for k in range(4))
    spans = ((rx0 >= wx0) & (rx1 <= wx1) & (ry0 <= wy1) & (wy0 <= ry1)) | ((ry0 >= wy0) & (ry1 <= wy1) & (rx0 <= wx1) & (wx0 <= rx1))
    exact = pairs.where(F.when(spans, True).otherwise(G.polygon_meets_rectangle(F.col("rings"), wx0, wy0, wx1, wy1))).drop("_r0", "_r1", "_r2", "_r3")
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(((p["x"] - wx0) / px).alias("x"), ((wy1 - p["y"]) / px).alias("y"))))
    return exact.withColumn("rings", moved)


def window_neighbors(objects: DataFrame, half: float = 128.0) -> DataFrame:
    """(object_id, n_objects_in_patch): objects of the same layer whose box, and ring if there is one, meets the window around each object's centre."""
    layer = ["region_id", "modality"]
    x0, y0, x1, y1 = F.col("wx") - half, F.col("wy") - half, F.col("wx") + half, F.col("wy") + half
    windows = objects.select(*layer, "object_id", F.col("cx").alias("wx"), F.col("cy").alias("wy"))
    ring = ["ring"] if "ring" in objects.columns else []
    pairs = box_pairs(windows, (x0, y0, x1, y1), objects.select(*layer, "cx", "cy", "hw", "hh", *ring), _object_box(), layer)
    if ring:
        pairs = pairs.where(G.meets_rectangle(F.col("ring"), x0, y0, x1, y1))
    return pairs.groupBy("object_id").agg(F.count("*").alias("n_objects_in_patch"))


def adaptive_window(matched: DataFrame, scale: float = 2.0, least: int = 256, most: int = 4096, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """Square window of an object: twice its larger side in pixels, between least and most, even, centred; and what of it is raster."""
    cx, cy, hw, hh = _used_box(fallback)
    w, h = 2 * hw / F.col("px"), 2 * hh / F.col("px")
    raw = F.least(F.greatest(F.ceil(F.greatest(w, h) * scale), F.lit(least)), F.lit(most))
    crop = (raw + raw % 2).cast("long")
    rows = matched.select("object_id", "raster_id", "width", "height", w.alias("obj_w_px"), h.alias("obj_h_px"), crop.alias("crop_size"),
                          F.floor((cx - F.col("x_left")) / F.col("px")).alias("col"), F.floor((F.col("y_top") - cy) / F.col("px")).alias("row"))
    half = F.floor(F.col("crop_size") / 2)
    rows = rows.withColumn("c0", F.col("col") - half).withColumn("r0", F.col("row") - half)
    c1, r1 = F.col("c0") + F.col("crop_size"), F.col("r0") + F.col("crop_size")
    rows = rows.select(
        "object_id", "raster_id", "crop_size", "c0", "r0", F.greatest("c0", F.lit(0)).alias("read_c0"), F.greatest("r0", F.lit(0)).alias("read_r0"),
        (F.least(c1, F.col("width")) - F.greatest("c0", F.lit(0))).alias("read_w"), (F.least(r1, F.col("height")) - F.greatest("r0", F.lit(0))).alias("read_h"),
        ((F.col("c0") < 0) | (F.col("r0") < 0) | (c1 > F.col("width")) | (r1 > F.col("height"))).alias("touches_border"),
        (F.greatest("obj_w_px", "obj_h_px") <= F.col("crop_size")).alias("target_fits_inside"))
    return rows.where("read_w > 0 AND read_h > 0")


def padded_window(matched: DataFrame, pad: float = 5.0, fallback: Callable[[], Box] = utm_box) -> DataFrame:
    """Window of the box and `pad` metres around: floored offset, ceiled length, cut at the raster's border."""
    cx, cy, hw, hh = _used_box(fallback)
    x0, y0 = (cx - hw - pad - F.col("x_left")) / F.col("px"), (F.col("y_top") - cy - hh - pad) / F.col("px")
    w, h = F.ceil((2 * hw + 2 * pad) / F.col("px")), F.ceil((2 * hh + 2 * pad) / F.col("px"))
    rows = matched.select("object_id", "raster_id", "width", "height", F.floor(x0).alias("a"), F.floor(y0).alias("b"), w.alias("w"), h.alias("h"))
    rows = rows.select("object_id", "raster_id", F.greatest("a", F.lit(0)).alias("col0"), F.greatest("b", F.lit(0)).alias("row0"),
                       F.least(F.col("a") + F.col("w"), F.col("width")).alias("c1"), F.least(F.col("b") + F.col("h"), F.col("height")).alias("r1"))
    rows = rows.select("object_id", "raster_id", "col0", "row0", (F.col("c1") - F.col("col0")).alias("w"), (F.col("r1") - F.col("row0")).alias("h"))
    return rows.where("w > 0 AND h > 0")


def resolve_paths(labels: DataFrame, inventory: DataFrame) -> DataFrame:
    """Labels with the recorded path if it exists, else the one of equal base name in the split folder, else null."""
    exact = inventory.select(F.col("path").alias("path"), F.col("path").alias("_exact")).distinct()
    by_name = inventory.groupBy("split", "name").agg(F.min("path").alias("_other"))
    named = labels.withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = named.join(exact, "path", "left").join(by_name, ["split", "name"], "left")
    return joined.withColumn("resolved", F.coalesce("_exact", "_other")).drop("_exact", "_other")


