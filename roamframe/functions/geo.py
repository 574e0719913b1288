"""Geometry as columns: distances, projections, cells, polygons. Polygons are rings of literal or array coordinates."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import EARTH_RADIUS_M

MERCATOR_R = 6378137.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere, from degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def distance(a: Sequence[Column], b: Sequence[Column], geographic: bool) -> Column:
    """Between (x, y) pairs, or (longitude, latitude) pairs."""
    return haversine(a[1], a[0], b[1], b[0]) if geographic else euclidean(*a, *b)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * MERCATOR_R, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_R


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326, as (longitude, latitude)."""
    return F.degrees(x / MERCATOR_R), F.degrees(2 * F.atan(F.exp(y / MERCATOR_R)) - F.lit(math.pi / 2))


def project(a: Column, b: Column, crs_from: str, crs_to: str) -> tuple[Column, Column]:
    pair = tuple(c.upper().replace("EPSG:", "") for c in (crs_from, crs_to))
    if pair[0] == pair[1]:
        return a, b
    if pair == ("4326", "3857"):
        return to_mercator(a, b)
    if pair == ("3857", "4326"):
        return from_mercator(a, b)
    raise ValueError(f"only EPSG:4326 and EPSG:3857 are supported, not {crs_from} to {crs_to}")


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    """Geohash of degrees, up to 12 characters: bits of both coordinates, interleaved."""
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    u = F.least(F.floor((lon + 180) / 360 * F.lit(float(1 << n_lon))), F.lit((1 << n_lon) - 1)).cast("long")
    v = F.least(F.floor((lat + 90) / 180 * F.lit(float(1 << n_lat))), F.lit((1 << n_lat) - 1)).cast("long")
    out = []
    for c in range(precision):
        code = F.lit(0)
        for bit in range(5 * c, 5 * c + 5):
            source, place = (u, n_lon - 1 - bit // 2) if bit % 2 == 0 else (v, n_lat - 1 - bit // 2)
            code = code * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substr(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def grid_cell(x: Column, y: Column, size: float) -> Column:
    """A square cell as text: column and row."""
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def tessellate(a: Column, b: Column, index: str, res: float) -> Column:
    """geohash of (longitude, latitude), or a square grid of (x, y)."""
    if index == "geohash":
        return geohash(a, b, int(res))
    if index == "grid":
        return grid_cell(a, b, res)
    if index == "h3":
        try:
            import h3
        except ImportError as e:
            raise ImportError("H3 cells need the h3 package") from e

        @F.pandas_udf("string")
        def cell(lon, lat):
            import pandas as pd

            return pd.Series([h3.latlng_to_cell(y, x, int(res)) for x, y in zip(lon, lat, strict=True)], dtype=object)

        return cell(a, b)
    raise NotImplementedError(index)


def parse_wkt(text: str) -> list[list[list[tuple[float, float]]]]:
    """A POLYGON or MULTIPOLYGON as polygons of rings."""
    if not re.match(r"\s*(MULTI)?POLYGON", text, re.IGNORECASE):
        raise ValueError("only POLYGON and MULTIPOLYGON are supported")
    polygons = re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", text)
    rings = [re.findall(r"\(([^()]*)\)", p) for p in polygons]
    return [[[tuple(map(float, q.split()[:2])) for q in r.split(",")] for r in p] for p in rings]


def bounds(polygons) -> tuple[float, float, float, float]:
    points = [q for p in polygons for r in p for q in r]
    return min(q[0] for q in points), min(q[1] for q in points), max(q[0] for q in points), max(q[1] for q in points)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Four range predicates, which a scan can push down."""
    return (x >= box[0]) & (y >= box[1]) & (x <= box[2]) & (y <= box[3])


def _in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> tuple[Column, Column]:
    """(an odd number of crossings, on the boundary)."""
    crossings, on = F.lit(0), F.lit(False)
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    for (x1, y1), (x2, y2) in zip(closed, closed[1:], strict=False):
        if (x1, y1) == (x2, y2):
            continue
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on |= (cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        if y1 != y2:
            crossings += (((y > y1) != (y > y2)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return crossings % 2 == 1, on


def is_within(x: Column, y: Column, within) -> Column:
    """Strictly inside a polygon: WKT, or polygons of rings; holes and their edges are outside."""
    polygons = parse_wkt(within) if isinstance(within, str) else within
    inside = F.lit(False)
    for shell, *holes in polygons:
        odd, on = _in_ring(x, y, shell)
        part = odd & ~on
        for hole in holes:
            odd, on = _in_ring(x, y, hole)
            part &= ~odd & ~on
        inside |= part
    return in_box(x, y, bounds(polygons)) & inside


def ring_contains(x: Column, y: Column, ring: Column, boundary: bool = False) -> Column:
    """Inside a ring held as array<struct<x,y>>, its last point the first again; with boundary, on it too."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i.cast("int")).alias("a"), F.element_at(ring, (i + 1).cast("int")).alias("b")))

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((y > y1) != (y > y2)) & (x < (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)

    def on(e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)
        return flat & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd | F.exists(edges, on) if boundary else odd & ~F.exists(edges, on)


def polygon_contains(x: Column, y: Column, ring: Column, holes: Column) -> Column:
    """Strictly inside a ring and neither in nor on one of its holes."""
    return ring_contains(x, y, ring) & ~F.exists(holes, lambda h: ring_contains(x, y, h, boundary=True))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Euclidean distance to a ring's boundary."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i.cast("int")).alias("a"), F.element_at(ring, (i + 1).cast("int")).alias("b")))

    def away(e: Column) -> Column:
        x1, y1 = e["a"]["x"], e["a"]["y"]
        dx, dy = e["b"]["x"] - x1, e["b"]["y"] - y1
        size = dx * dx + dy * dy
        t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / size)))
        return euclidean(x, y, x1 + t * dx, y1 + t * dy)

    return F.array_min(F.transform(edges, away))


def _bound(value: Column, f) -> Column:
    """f(value), the value worked out once: a lambda's variable stands for it, where nested expressions would repeat it."""
    return F.transform(F.array(value), f)[0]


def _clip_half(ring: Column, keep, cross) -> Column:
    """A closed ring without what lies beyond one line. keep(p): p stays; cross(a, b): where an edge meets the line."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def points(r: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.element_at(r, i.cast("int")), F.element_at(r, (i + 1).cast("int"))
            return F.concat(F.when(keep(a) != keep(b), F.array(cross(a, b))).otherwise(none), F.when(keep(b), F.array(b)).otherwise(none))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(r) - 1), edge))

    closed = lambda q: F.when(F.size(q) > 2, F.concat(F.slice(q, -1, 1), q))
    return _bound(ring, lambda r: F.when(r.isNotNull(), _bound(points(r), closed)))


def clip_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a closed ring (array<struct<x,y>>) in a box (x0, y0, x1, y1), closed; null if nothing of it is. Parts of a hollow ring stay joined along the box."""
    x0, y0, x1, y1 = map(float, box)
    at_x = lambda x: lambda a, b: F.struct(F.lit(x).alias("x"), (a["y"] + (b["y"] - a["y"]) * ((F.lit(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))).alias("y"))
    at_y = lambda y: lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * ((F.lit(y) - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))).alias("x"), F.lit(y).alias("y"))
    for keep, cross in (
        (lambda p: p["x"] >= x0, at_x(x0)), (lambda p: p["x"] <= x1, at_x(x1)), (lambda p: p["y"] >= y0, at_y(y0)), (lambda p: p["y"] <= y1, at_y(y1)),
    ):
        ring = _clip_half(ring, keep, cross)
    return ring


def blocks_to_mercator(x: Column, y: Column, block: float = 15.0, false_easting: float = 0.0, false_northing: float = 0.0, rotation_deg: float = 0.0) -> tuple[Column, Column]:
    """City blocks to metres: scale, shift, then turn about the origin."""
    u, v = x * block + false_easting, y * block + false_northing
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    return (u, v) if not rotation_deg else (u * c - v * s, u * s + v * c)


def mercator_to_blocks(x: Column, y: Column, block: float = 15.0, false_easting: float = 0.0, false_northing: float = 0.0, rotation_deg: float = 0.0) -> tuple[Column, Column]:
    """The inverse, rotation included."""
    c, s = math.cos(math.radians(-rotation_deg)), math.sin(math.radians(-rotation_deg))
    u, v = (x, y) if not rotation_deg else (x * c - y * s, x * s + y * c)
    return (u - false_easting) / block, (v - false_northing) / block


def bearing_rotation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Aggregate: the turn in degrees, modulo 90, that aligns street segments with the axes."""
    theta = 4 * F.atan2(y2 - y1, x2 - x1)
    return F.degrees(F.atan2(F.sum(F.sin(theta)), F.sum(F.cos(theta)))) / 4
