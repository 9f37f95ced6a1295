"""Planar and spherical geometry in Spark's expressions; ``shapes`` has columns of any geometry.

Points are two columns, bounding boxes four, rings and lines arrays of structs (x, y). Predicates give NULL for NULL. A
point on a ring's edge intersects the polygon but is not within it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; the mean radius of the sphere that distances are measured on.
EARTH = 6371008.771415
Box = tuple[Column, Column, Column, Column]


def boxes_intersect(a: Box, b: Box) -> Column:
    """Boxes are (xmin, ymin, xmax, ymax); touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """1 inside, 0 on an edge, -1 outside a ring of constant points (closed or not)."""
    points = ring if ring[0] != ring[-1] else ring[:-1]
    pairs = list(zip(points, points[1:] + points[:1], strict=True))
    edges, crossings = [], []
    for (x1, y1), (x2, y2) in pairs:
        side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        edges.append((side == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings.append(crosses.cast("int"))
    odd = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("int")).when(reduce(lambda a, b: a | b, edges), 0).when(odd == 1, 1).otherwise(-1)


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """The same for a polygon: a shell and its holes."""
    shell, *holes = [in_ring(x, y, r) for r in rings]
    if not holes:
        return shell
    most = F.greatest(*holes) if len(holes) > 1 else holes[0]
    return F.when(shell < 1, shell).otherwise(-most)


def intersects(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    return in_polygon(x, y, rings) >= 0


def within(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    return in_polygon(x, y, rings) > 0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def within_distance(x1: Column, y1: Column, x2: Column, y2: Column, r: float) -> Column:
    """Boxes first: the cheap test settles most pairs."""
    return (F.abs(x1 - x2) <= r) & (F.abs(y1 - y2) <= r) & (distance(x1, y1, x2, y2) <= r)


def sphere_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along a great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def segments_intersect(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments ab and cd have a point in common."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    on = lambda px, py, qx, qy, rx, ry: (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))
    o1, o2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    o3, o4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    proper = (o1 != o2) & (o3 != o4)
    return proper | ((o1 == 0) & on(ax, ay, bx, by, cx, cy)) | ((o2 == 0) & on(ax, ay, bx, by, dx, dy)) | ((o3 == 0) & on(cx, cy, dx, dy, ax, ay)) | ((o4 == 0) & on(cx, cy, dx, dy, bx, by))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def envelope(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring around a box."""
    return F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))


def _pairs(points: Column) -> Column:
    """Successive points of a line."""
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(points: Column) -> Column:
    step = lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])
    return F.aggregate(_pairs(points), F.lit(0.0), step)


def signed_area(ring: Column) -> Column:
    """Positive where the closed ring turns left."""
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Of a closed ring; the mean of its points where it has no area."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    total = lambda k: F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + (p["a"][k] + p["b"][k]) * cross(p))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    a = signed_area(ring)
    return point(F.when(a == 0, mean("x")).otherwise(total("x") / (6 * a)), F.when(a == 0, mean("y")).otherwise(total("y") / (6 * a)))


def bounds(points: Column) -> Column:
    xs, ys = points.getField("x"), points.getField("y")
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def segmentize(points: Column, most: float) -> Column:
    """Points added evenly so that no segment is longer than ``most``."""

    def cut(p: Column) -> Column:
        n = F.greatest(F.ceil(distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]) / most), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda i: point(p["a"]["x"] + (p["b"]["x"] - p["a"]["x"]) * i / n, p["a"]["y"] + (p["b"]["y"] - p["a"]["y"]) * i / n))

    return F.concat(F.slice(points, 1, 1), F.flatten(F.transform(_pairs(points), cut)))


def as_text(points: Column, kind: str = "LINESTRING") -> Column:
    """Well-known text of a line or of a polygon with one ring."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ",")
    return F.concat(F.lit("POLYGON(("), body, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind}("), body, F.lit(")"))


PARSED = "srid int, kind string, empty boolean, npoints int, xmin double, ymin double, xmax double, ymax double, x double, y double, valid boolean"


def from_text(texts: Column) -> Column:
    """What a geometry's text says, as a struct column: NULL fields for NULL, an error for what is no geometry (see ``shapes`` for whole geometries)."""

    @F.pandas_udf(PARSED)
    def parsed(batch: pd.Series) -> pd.DataFrame:
        from lodestar.functions import shapes

        def row(text: str | None) -> tuple:
            if text is None:
                return (None,) * 11
            g = shapes.from_wkt(text)
            v = g.vertices
            if g.empty:
                return (g.srid, g.kind, True, 0, *(None,) * 6, True)
            return (g.srid, g.kind, False, len(v), *v.min(axis=0), *v.max(axis=0), *(v[0] if g.kind == "POINT" else (None, None)), shapes.valid(g))

        return pd.DataFrame([row(t) for t in batch], columns=[c.split()[0] for c in PARSED.split(", ")])

    return parsed(texts)


def ring_side(x: Column, y: Column, ring: Column) -> Column:
    """``in_ring`` for a ring that is a column, a closed array of points: 1 inside, 0 on an edge, -1 outside."""
    side = lambda p: (x - p["a"]["x"]) * (p["b"]["y"] - p["a"]["y"]) - (y - p["a"]["y"]) * (p["b"]["x"] - p["a"]["x"])
    held = lambda p: x.between(F.least(p["a"]["x"], p["b"]["x"]), F.greatest(p["a"]["x"], p["b"]["x"])) & y.between(F.least(p["a"]["y"], p["b"]["y"]), F.greatest(p["a"]["y"], p["b"]["y"]))
    edge = F.exists(_pairs(ring), lambda p: (side(p) == 0) & held(p))
    # An edge that passes the point's height turns the count by the side on which the point lies.
    up = lambda p: (p["a"]["y"] <= y) & (p["b"]["y"] > y) & (side(p) < 0)
    down = lambda p: (p["b"]["y"] <= y) & (p["a"]["y"] > y) & (side(p) > 0)
    turns = F.aggregate(_pairs(ring), F.lit(0), lambda n, p: n + F.when(up(p), 1).when(down(p), -1).otherwise(0))
    return F.when(x.isNull() | y.isNull() | ring.isNull(), F.lit(None).cast("int")).when(edge, 0).when(turns != 0, 1).otherwise(-1)
