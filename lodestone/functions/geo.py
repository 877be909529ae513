"""Geographic predicates and distances as Columns."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.7714  # mean radius in metres
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344}


def metres(distance: str | float) -> float:
    """``"12 km"``, ``"3mi"``, ``"100"`` (metres) in metres."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*(m|km|mi)?\s*", str(distance))
    if not m:
        raise ValueError(f"not a distance: {distance!r}")
    return float(m[1]) * UNITS[m[2] or "m"]


def haversine(lat: Column, lon: Column, lat2: float, lon2: float) -> Column:
    """Great-circle distance in metres; null where the place is."""
    a1, b1, a2, b2 = F.radians(lat), F.radians(lon), F.radians(F.lit(float(lat2))), F.radians(F.lit(float(lon2)))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((b2 - b1) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))  # least() passes over nulls


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Inside, borders included; a box whose left is east of its right crosses the date line."""
    across = (lon >= left) & (lon <= right) if left <= right else (lon >= left) | (lon <= right)
    return (lat >= bottom) & (lat <= top) & across


def _edges(ring: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    points = [(float(a), float(b)) for a, b in ring]
    if len(points) < 3:
        raise ValueError("a polygon needs three points at least")
    if points[0] != points[-1]:
        points.append(points[0])
    if len(points) < 4:
        raise ValueError("a closed polygon needs four points at least")
    return [*zip(points, points[1:])]


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) corners: an odd number of edges lies east of the point."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in _edges(ring):
        if y1 != y2:
            east = lon < (F.lit(x2) - x1) * (lat - y1) / (y2 - y1) + x1
            crossings = crossings + F.when((F.lit(y1) > lat) != (F.lit(y2) > lat), east.cast("int")).otherwise(0)
    return crossings % 2 == 1


def in_polygon(lat: Column, lon: Column, shell: list[tuple[float, float]], holes: list[list[tuple[float, float]]] = ()) -> Column:
    inside = in_ring(lat, lon, shell)
    for h in holes:
        inside = inside & ~in_ring(lat, lon, h)
    return inside


RINGS = "struct<type:string,coordinates:array<array<array<double>>>>"


def rings(geojson: Column) -> Column:
    """Rings of a GeoJSON polygon, corners as [lon, lat]."""
    return F.from_json(geojson, RINGS)["coordinates"]


def rings_contain(polygon: Column, lat: float, lon: float) -> Column:
    """Whether a polygon column (rings of [lon, lat]) holds a point: in the first ring and in none of the others."""

    def odd(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

        def crossing(e: Column) -> Column:
            y1, x1, y2, x2 = e["p"][1], e["p"][0], e["q"][1], e["q"][0]
            return F.when((y1 > lat) != (y2 > lat), (F.lit(lon) < (x2 - x1) * (F.lit(lat) - y1) / (y2 - y1) + x1).cast("int")).otherwise(0)

        return F.aggregate(F.transform(edges, crossing), F.lit(0), lambda a, b: a + b) % 2 == 1

    return odd(polygon[0]) & ~F.exists(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), odd)


def _any_edge(polygon: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether an edge of a ring, from one corner [lon, lat] to the next, passes."""

    def of(ring: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.coalesce(test(F.get(ring, i - 1), F.get(ring, i)), F.lit(False)))

    return F.exists(polygon, of)


def _crosses(a: Column, b: Column, c: tuple[float, float], d: tuple[float, float]) -> Column:
    """Whether the segment between two corners [lon, lat] meets that between two places (lat, lon), ends included."""
    (y3, x3), (y4, x4) = c, d
    x1, y1, x2, y2 = a[0], a[1], b[0], b[1]

    def side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    x3, y3, x4, y4 = (F.lit(float(v)) for v in (x3, y3, x4, y4))
    apart = (side(x1, y1, x2, y2, x3, y3) * side(x1, y1, x2, y2, x4, y4) > 0) | (side(x3, y3, x4, y4, x1, y1) * side(x3, y3, x4, y4, x2, y2) > 0)
    boxes = (F.greatest(x1, x2) >= F.least(x3, x4)) & (F.greatest(x3, x4) >= F.least(x1, x2)) & (F.greatest(y1, y2) >= F.least(y3, y4)) & (F.greatest(y3, y4) >= F.least(y1, y2))
    return boxes & ~apart


def polygon_meets(polygon: Column, inside: Callable[[Column, Column], Column], rings_: list[list[tuple[float, float]]]) -> Column:
    """Whether a polygon column meets a shape with edges: a corner of one lies in the other, or two edges cross.

    ``inside`` tells whether a place (lat, lon) lies in the shape; ``rings_`` are its rings of (lat, lon), the outer first.
    """
    corner = F.exists(polygon, lambda ring: F.exists(ring, lambda c: inside(c[1], c[0])))
    edges = [e for r in rings_ for e in _edges(r)]
    crossed = _any_edge(polygon, lambda a, b: reduce(lambda x, y: x | y, [_crosses(a, b, *e) for e in edges]))
    return corner | rings_contain(polygon, *map(float, rings_[0][0])) | crossed


def polygon_near(polygon: Column, lat: float, lon: float, radius: float) -> Column:
    """Whether a polygon column comes within ``radius`` metres of a place: it holds the place, a corner is as near, or an edge is,
    measured on the plane that touches the earth there."""
    k = math.radians(1) * EARTH
    east = k * math.cos(math.radians(lat))
    corner = F.exists(polygon, lambda ring: F.exists(ring, lambda c: haversine(c[1], c[0], lat, lon) <= radius))

    def near(a: Column, b: Column) -> Column:
        x1, y1, x2, y2 = (a[0] - lon) * east, (a[1] - lat) * k, (b[0] - lon) * east, (b[1] - lat) * k
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / length))).otherwise(0.0)
        return F.pow(x1 + t * dx, F.lit(2)) + F.pow(y1 + t * dy, F.lit(2)) <= radius * radius

    return corner | rings_contain(polygon, float(lat), float(lon)) | _any_edge(polygon, near)


def check_polygon(geojson: str) -> str:
    """The text itself if it is one GeoJSON polygon."""
    if json.loads(geojson).get("type") != "Polygon":
        raise ValueError("one polygon is expected")
    return geojson
