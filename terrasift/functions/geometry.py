"""Column functions on rings (array<struct<x, y>>, not closed) and on WGS 84 coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def edges(r: Column) -> Column:
    """array<struct<x, y, u, v>>: each point and the next one."""
    after = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(r: Column) -> Column:
    x0, y0 = F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]
    return _sum(F.transform(edges(r), lambda e: (e["x"] - x0) * (e["v"] - y0) - (e["u"] - x0) * (e["y"] - y0))) / 2


def area(r: Column) -> Column:
    return F.abs(signed_area(r))


def perimeter(r: Column) -> Column:
    return _sum(F.transform(edges(r), lambda e: F.sqrt((e["u"] - e["x"]) * (e["u"] - e["x"]) + (e["v"] - e["y"]) * (e["v"] - e["y"]))))


def centroid(r: Column) -> tuple[Column, Column]:
    x0, y0 = F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]

    def along(part) -> Column:
        return _sum(F.transform(edges(r), lambda e: part(e) * ((e["x"] - x0) * (e["v"] - y0) - (e["u"] - x0) * (e["y"] - y0))))

    six = 6 * signed_area(r)
    return x0 + along(lambda e: e["x"] + e["u"] - 2 * x0) / six, y0 + along(lambda e: e["y"] + e["v"] - 2 * y0) / six


def box(r: Column) -> tuple[Column, Column, Column, Column]:
    x, y = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def _half_plane(axis: str, bound: Column, sign: int):
    """Points and crossings that an edge adds to the ring's part on the bound's inner side."""
    other = "y" if axis == "x" else "x"
    tail = {"x": "u", "y": "v"}

    def point(x: Column, y: Column) -> Column:
        return F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))

    def cut(e: Column) -> Column:
        a, b = (e[axis] - bound) * sign, (e[tail[axis]] - bound) * sign
        at = e[other] + a / (a - b) * (e[tail[other]] - e[other])
        hit = point(bound, at) if axis == "x" else point(at, bound)
        own = point(e["x"], e["y"])
        none = F.slice(own, 1, 0)
        crossing = ((a >= 0) & (b < 0)) | ((a < 0) & (b >= 0))
        return F.concat(F.when(a >= 0, own).otherwise(none), F.when(crossing, hit).otherwise(none))

    return cut


def clip(r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a ring inside a rectangle, one half plane after the other.

    Of a concave ring that falls apart, the parts hang together by edges that run twice along the rectangle's border: the area is
    right, and spatial.clip_parts gives the parts.
    """
    for half in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        # bound at each half plane: edges names its ring three times, so put into each other they would be 81 rings
        r = _bind(r, lambda q: F.flatten(F.transform(edges(q), _half_plane(*half))))
    return r


def clip_passes(rows: DataFrame, column: str, x0: Column, y0: Column, x1: Column, y1: Column, inside: Column) -> DataFrame:
    """rows with every ring of an array-of-rings column clipped, a projection for each half plane; rings that lie outside go.

    Rings of rows whose condition inside holds lie in the rectangle and stay as they are.
    """
    for axis, bound, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        cut = F.transform(column, lambda r: F.flatten(F.transform(edges(r), _half_plane(axis, bound, sign))))
        rows = rows.withColumn(column, F.when(inside, F.col(column)).otherwise(F.filter(cut, lambda r: F.size(r) > 2)))
    return rows.withColumn(column, F.filter(column, lambda r: F.size(r) > 2))


# Fixed values of WGS 84 and of the transverse Mercator series of order 3.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]
_C = 2 * math.sqrt(_N) / (1 + _N)


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of geographic degrees."""
    s, d = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(_atanh(s) - F.lit(_C) * _atanh(F.lit(_C) * s))
    xi, eta = F.atan2(t, F.cos(d)), _atanh(F.sin(d) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = F.lit(_K0 * _RADIUS)
    return F.lit(500000.0) + scale * e, scale * n + F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0))


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    scale = F.lit(_K0 * _RADIUS)
    xi = (northing - F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0))) / scale
    eta = (easting - 500000.0) / scale
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - F.lit(k) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(k) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(_DELTA, 1):
        lat = lat + F.lit(k) * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (6 * zone - 183), F.degrees(lat)


def inside_ring(r: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point."""
    hits = F.filter(edges(r), lambda e: ((e["y"] <= y) != (e["v"] <= y)) & (x < e["x"] + (y - e["y"]) * (e["u"] - e["x"]) / (e["v"] - e["y"])))
    return F.size(hits) % 2 == 1


def edges_meet(r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge of a ring and a rectangle share a point; a corner nearer to the edge than the rounding of coordinates lies on it."""
    far = F.greatest(F.abs(x0), F.abs(x1), F.abs(y0), F.abs(y1)) * F.lit(2.0**-50)

    def met(e: Column) -> Column:
        def side(x: Column, y: Column) -> Column:
            return (e["u"] - e["x"]) * (y - e["y"]) - (e["v"] - e["y"]) * (x - e["x"])

        hair = (F.abs(e["u"] - e["x"]) + F.abs(e["v"] - e["y"])) * far

        corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        apart = (F.greatest(e["x"], e["u"]) < x0) | (F.least(e["x"], e["u"]) > x1) | (F.greatest(e["y"], e["v"]) < y0) | (F.least(e["y"], e["v"]) > y1)
        return ~apart & (F.least(*corners) <= hair) & (F.greatest(*corners) >= -hair)

    return F.exists(edges(r), met)


def meets_rectangle(r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a polygon and a rectangle share a point: an edge meets the rectangle, or a corner of it lies in the ring."""
    return edges_meet(r, x0, y0, x1, y1) | inside_ring(r, x0, y0)


def all_edges(rings: Column) -> Column:
    """Edges of all rings of a polygon (array of rings, the outer one first, then its holes)."""
    return F.flatten(F.transform(rings, edges))


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring without its holes."""
    return area(F.get(rings, F.lit(0))) - _sum(F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), area))


def polygon_perimeter(rings: Column) -> Column:
    """Length of all rings."""
    return _sum(F.transform(rings, perimeter))


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid of the outer ring without its holes: first moments of the rings, the holes' subtracted."""
    def moments(r: Column) -> Column:
        x, y = centroid(r)
        return F.struct(x.alias("x"), y.alias("y"), area(r).alias("a"))

    outer = moments(F.get(rings, F.lit(0)))
    holes = F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), moments)

    def along(axis: str) -> Column:
        return (outer[axis] * outer["a"] - _sum(F.transform(holes, lambda h: h[axis] * h["a"]))) / polygon_area(rings)

    return along("x"), along("y")


def polygon_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    return box(F.get(rings, F.lit(0)))


def inside_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point over all rings."""
    return F.aggregate(F.transform(rings, lambda r: inside_ring(r, x, y)), F.lit(False), lambda a, b: a != b)


def polygon_meets_rectangle(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a polygon with holes and a rectangle share a point: an edge of any ring meets it, or its corner lies inside."""
    def meets(b: Column) -> Column:
        return F.exists(b["r"], lambda r: edges_meet(r, b["x0"], b["y0"], b["x1"], b["y1"])) | inside_polygon(b["r"], b["x0"], b["y0"])

    return _bind(F.struct(rings.alias("r"), *[c.alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))]), meets)


def _zone(epsg: Column) -> Column:
    return F.when(epsg.between(32601, 32660), epsg - 32600).when(epsg.between(32701, 32760), epsg - 32700)


def known_crs(epsg: Column) -> Column:
    """Geographic WGS 84 or one of its UTM zones."""
    return F.coalesce((epsg == 4326) | _zone(epsg).isNotNull(), F.lit(False))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as the variable of a lambda function; formulas put into each other would grow out of hand."""
    return F.transform(F.array(value), use)[0]


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("x"), b.alias("y"))


def _geographic(point: Column, zone: Column, south: Column) -> Column:
    """from_utm in bound steps: struct<x, y> of degrees."""
    scale = F.lit(_K0 * _RADIUS)

    def series(q: Column) -> Column:
        a, b = q["x"], q["y"]
        for j, k in enumerate(_BETA, 1):
            a = a - F.lit(k) * F.sin(2 * j * q["x"]) * F.cosh(2 * j * q["y"])
            b = b - F.lit(k) * F.cos(2 * j * q["x"]) * F.sinh(2 * j * q["y"])
        return _pair(a, b)

    def latitude(q: Column) -> Column:
        lat = q["y"]
        for j, k in enumerate(_DELTA, 1):
            lat = lat + F.lit(k) * F.sin(2 * j * q["y"])
        return _pair(q["x"] + (6 * zone - 183), F.degrees(lat))

    start = _pair((point["y"] - F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0))) / scale, (point["x"] - 500000.0) / scale)
    angles = _bind(_bind(start, series), lambda q: _pair(F.degrees(F.atan2(F.sinh(q["y"]), F.cos(q["x"]))), F.asin(F.sin(q["x"]) / F.cosh(q["y"]))))
    return _bind(angles, latitude)


def _projected(degrees: Column, zone: Column, south: Column) -> Column:
    """to_utm in bound steps: struct<x, y> of easting and northing."""
    def conformal(q: Column) -> Column:
        return _pair(F.sinh(_atanh(q["x"]) - F.lit(_C) * _atanh(F.lit(_C) * q["x"])), q["y"])

    def series(q: Column) -> Column:
        e, n = q["y"], q["x"]
        for j, a in enumerate(_ALPHA, 1):
            e = e + F.lit(a) * F.cos(2 * j * q["x"]) * F.sinh(2 * j * q["y"])
            n = n + F.lit(a) * F.sin(2 * j * q["x"]) * F.cosh(2 * j * q["y"])
        scale = F.lit(_K0 * _RADIUS)
        return _pair(F.lit(500000.0) + scale * e, scale * n + F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0)))

    start = _pair(F.sin(F.radians(degrees["y"])), F.radians(degrees["x"] - (6 * zone - 183)))
    angles = _bind(_bind(start, conformal), lambda q: _pair(F.atan2(q["x"], F.cos(q["y"])), _atanh(F.sin(q["y"]) / F.sqrt(1 + q["x"] * q["x"]))))
    return _bind(angles, series)


def reproject_ring(r: Column, source: Column, target: Column) -> Column:
    """The ring in another system; as it is if the systems are equal or one is null, null if one is not known."""
    degrees = F.when(source == 4326, r).otherwise(F.transform(r, lambda p: _geographic(p, _zone(source), source > 32700)))
    moved = F.when(target == 4326, degrees).otherwise(F.transform(degrees, lambda p: _projected(p, _zone(target), target > 32700)))
    return F.when(F.coalesce(source == target, F.lit(True)), r).when(known_crs(source) & known_crs(target), moved)
