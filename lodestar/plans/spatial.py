"""Spatial queries. Points are made from keys in whole hundredths, so both engines compute with the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import geo, shapes
from lodestar.operators.spatial import boxes_join, forms_join, least_of_places
from lodestar.plans.registry import query
from lodestar.sources.shipping import ship
from lodestar.sources.tables import load, spread

POINTS = "WITH t AS (SELECT event_id AS k, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id * 37 % 1000 AS DOUBLE) END AS x, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id * 101 % 800 AS DOUBLE) END AS y FROM events)"
#: A triangle, its edges as half planes in SQL, and a square hole in it.
TRIANGLE = [(100.0, 100.0), (700.0, 100.0), (100.0, 700.0), (100.0, 100.0)]
HOLE = [(200.0, 200.0), (300.0, 200.0), (300.0, 300.0), (200.0, 300.0), (200.0, 200.0)]
IN_TRIANGLE = "x >= 100 AND y >= 100 AND x + y <= 800"
INSIDE_TRIANGLE = "x > 100 AND y > 100 AND x + y < 800"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    made = lambda m, n, gap: F.when(k % gap != 0, (k * m % n).cast("double"))
    return spread(load(spark, sf_dir, "events", "event_id")).select(k.alias("k"), made(37, 1000, 17).alias("x"), made(101, 800, 13).alias("y"))



@query("st_intersects_count", f"{POINTS} SELECT COUNT(*) AS n FROM t WHERE {IN_TRIANGLE}")
def st_intersects_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(geo.intersects(F.col("x"), F.col("y"), [TRIANGLE])).agg(F.count(F.lit(1)).alias("n"))


@query("st_within_hole", f"{POINTS} SELECT k FROM t WHERE {INSIDE_TRIANGLE} AND NOT (x BETWEEN 200 AND 300 AND y BETWEEN 200 AND 300)")
def st_within_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(geo.within(F.col("x"), F.col("y"), [TRIANGLE, HOLE])).select("k")


@query("st_position", f"{POINTS} SELECT k, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN {INSIDE_TRIANGLE} THEN 1 WHEN {IN_TRIANGLE} THEN 0 ELSE -1 END AS position FROM t")
def st_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("k", geo.in_ring(F.col("x"), F.col("y"), TRIANGLE).alias("position"))


@query("st_within_envelope", f"{POINTS} SELECT k FROM t WHERE x > 250 AND x < 400 AND y > 100 AND y < 500")
def st_within_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(geo.within(F.col("x"), F.col("y"), [[(250, 100), (400, 100), (400, 500), (250, 500)]])).select("k")


@query("st_dwithin_grouped", f"{POINTS} SELECT k % 10 AS zone, COUNT(*) AS n FROM t WHERE (x - 500) * (x - 500) + (y - 400) * (y - 400) <= 22500 GROUP BY k % 10")
def st_dwithin_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = points(spark, sf_dir).where(geo.within_distance(F.col("x"), F.col("y"), F.lit(500.0), F.lit(400.0), 150))
    return near.groupBy((F.col("k") % 10).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("st_distance_top_k", f"{POINTS} SELECT k, SQRT((x - 500) * (x - 500) + (y - 400) * (y - 400)) AS d FROM t WHERE x IS NOT NULL AND y IS NOT NULL ORDER BY d, k LIMIT 100")
def st_distance_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.distance(F.col("x"), F.col("y"), F.lit(500.0), F.lit(400.0))
    return points(spark, sf_dir).where("x IS NOT NULL AND y IS NOT NULL").select("k", d.alias("d")).orderBy("d", "k").limit(100)


@query("st_sphere_distance", f"{POINTS} SELECT k, ROUND(2 * 6371008.771415 * ASIN(SQRT(POW(SIN(RADIANS(10 - (y / 10 - 40)) / 2), 2) + COS(RADIANS(y / 10 - 40)) * COS(RADIANS(10)) * POW(SIN(RADIANS(20 - (x / 10 - 50)) / 2), 2))), 3) AS metres FROM t")
def st_sphere_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("k", F.round(geo.sphere_distance(F.col("x") / 10 - 50, F.col("y") / 10 - 40, F.lit(20.0), F.lit(10.0)), 3).alias("metres"))


@query("st_measures", "SELECT p_partkey AS k, CAST(p_size * (p_size + 3) AS DOUBLE) AS area, CAST(2 * (p_size + p_size + 3) AS DOUBLE) AS perimeter, p_partkey % 100 + p_size / 2.0 AS cx, 5 + (p_size + 3) / 2.0 AS cy, CAST(p_partkey % 100 AS DOUBLE) AS xmin, CAST(8 + p_size AS DOUBLE) AS ymax FROM part")
def st_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter, centroid and bounds of rectangles."""
    x0, n = F.col("p_partkey") % 100, F.col("p_size")
    ring = geo.envelope(x0, F.lit(5), x0 + n, 8 + n)
    out = load(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), ring.alias("r")).select("k", geo.area(F.col("r")).alias("area"), geo.length(F.col("r")).alias("perimeter"), geo.centroid(F.col("r")).alias("c"), geo.bounds(F.col("r")).alias("b"))
    return out.select("k", "area", "perimeter", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("b.xmin").alias("xmin"), F.col("b.ymax").alias("ymax"))


@query("st_segments_intersect", f"{POINTS} SELECT k, CASE WHEN y = 400 THEN x <= 500 ELSE x + 100 <= 500 END AS hit FROM t WHERE x IS NOT NULL AND y IS NOT NULL")
def st_segments_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted segments from (x, y) to (x + 200, 800 - y), some of them flat, against one that lies from (0, 400) to (500, 400)."""
    some, x, y = points(spark, sf_dir).where("x IS NOT NULL AND y IS NOT NULL"), F.col("x"), F.col("y")
    return some.select("k", geo.segments_intersect(x, y, x + 200, 800 - y, F.lit(0.0), F.lit(400.0), F.lit(500.0), F.lit(400.0)).alias("hit"))


OVERLAPS = "a.c_custkey < b.c_custkey AND ABS(a.c_custkey * 13 % 500 - b.c_custkey * 13 % 500) <= 9 AND ABS(a.c_custkey * 29 % 700 - b.c_custkey * 29 % 700) <= 9"


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of customers that have a point in common."""
    k = F.col("c_custkey")
    boxes = load(spark, sf_dir, "customer", "c_custkey").select(k, (k * 13 % 500).alias("x"), (k * 29 % 700).alias("y"))
    side = lambda n: boxes.select(k.alias(n), F.col("x").alias(f"{n}x0"), F.col("y").alias(f"{n}y0"), (F.col("x") + 9).alias(f"{n}x1"), (F.col("y") + 9).alias(f"{n}y1"))
    box = lambda n: (f"{n}x0", f"{n}y0", f"{n}x1", f"{n}y1")
    return boxes_join(side("a"), box("a"), side("b"), box("b"), 10, widest=9).where("a < b").select("a", "b")


@query("st_bbox_overlap", f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON {OVERLAPS}")
def st_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(spark, sf_dir)


@query("st_bbox_hits", f"SELECT a.c_custkey AS a, COUNT(*) AS hits FROM customer a JOIN customer b ON {OVERLAPS} GROUP BY a.c_custkey")
def st_bbox_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes each meets."""
    return overlapping(spark, sf_dir).groupBy("a").agg(F.count(F.lit(1)).alias("hits"))


def places(some: DataFrame) -> DataFrame:
    """Each place with its number of points and their least key."""
    return some.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"))


def of_zones(zones: DataFrame, met: DataFrame, form: list[str]) -> DataFrame:
    """Number and least key of each zone's points, from its form's places."""
    each = met.groupBy(*form).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))
    return zones.join(each, form).groupBy("zone").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))


ZONES = "z AS (SELECT c_custkey AS zone, CAST(c_custkey * 53 % 1000 AS DOUBLE) AS x0, CAST(c_custkey * 71 % 800 AS DOUBLE) AS y0 FROM customer)"


@query("spatial_join", f"{POINTS}, {ZONES} SELECT zone, COUNT(*) AS n, MIN(k) AS lo FROM t JOIN z ON x BETWEEN x0 AND x0 + 20 AND y BETWEEN y0 AND y0 + 15 GROUP BY zone")
def spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in boxes, grouped by box."""
    c = F.col("c_custkey")
    zones = load(spark, sf_dir, "customer", "c_custkey").select(c.alias("zone"), (c * 53 % 1000).cast("double").alias("x0"), (c * 71 % 800).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 15})
    met = forms_join(places(points(spark, sf_dir)), "x", "y", zones, ["x0", "y0", "x1", "y1"], ("x0", "y0", "x1", "y1"), 20, widest=20)
    return of_zones(zones, met, ["x0", "y0", "x1", "y1"])


#: Texts of geometries by the key's remainder, and what they are: kind, points, greatest x, emptiness, validity.
KINDS = (
    ("'POINT(' || n || ' 7)'", "POINT", "1", "n", "FALSE", "TRUE"),
    ("'SRID=4326;LINESTRING(0 0,' || n || ' 1,2 5)'", "LINESTRING", "3", "GREATEST(n, 2)", "FALSE", "TRUE"),
    ("'SRID=3857;POLYGON((0 0,0 9,' || n || ' 9,' || n || ' 0,0 0))'", "POLYGON", "5", "n", "FALSE", "TRUE"),
    ("'POLYGON((0 0,' || n || ' ' || n || ',' || n || ' 0,0 ' || n || ',0 0))'", "POLYGON", "5", "n", "FALSE", "FALSE"),
    ("'MULTIPOINT((1 2),(' || n || ' 4),(0 0))'", "MULTIPOINT", "3", "GREATEST(n, 1)", "FALSE", "TRUE"),
    ("'MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((' || n || ' 5,60 5,60 6,' || n || ' 5)))'", "MULTIPOLYGON", "8", "60", "FALSE", "TRUE"),
    ("'GEOMETRYCOLLECTION(POINT(' || n || ' 1),LINESTRING(0 0,2 2))'", "GEOMETRYCOLLECTION", "3", "GREATEST(n, 2)", "FALSE", "TRUE"),
    ("'SRID=4326;LINESTRING EMPTY'", "LINESTRING", "0", "NULL", "TRUE", "TRUE"),
    ("NULL", "", "NULL", "NULL", "NULL", "NULL"),
)
_of = lambda i: " ".join(f"WHEN {r} THEN {k[i]}" for r, k in enumerate(KINDS))
_kinds = " ".join(f"WHEN {r} THEN {repr(k[1]) if k[1] else 'NULL'}" for r, k in enumerate(KINDS))


@query("st_from_text", f"WITH t AS (SELECT p_partkey AS k, p_partkey % {len(KINDS)} AS r, p_size AS n FROM part) SELECT k, CASE r {_kinds} END AS kind, CAST(CASE r {_of(2)} END AS INTEGER) AS npoints, CAST(CASE r {_of(3)} END AS DOUBLE) AS xmax, CASE r {_of(4)} END AS empty, CASE r WHEN 1 THEN 4326 WHEN 2 THEN 3857 WHEN 7 THEN 4326 WHEN 8 THEN NULL ELSE 0 END AS srid, CASE r {_of(5)} END AS valid FROM t")
def st_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries of every kind from text: valid, crossing themselves, empty and NULL."""
    ship(spark.sparkContext)
    text = "CASE r " + " ".join(f"WHEN {r} THEN {k[0]}" for r, k in enumerate(KINDS)) + " END"
    some = spread(load(spark, sf_dir, "part", "p_partkey", "p_size")).selectExpr("p_partkey AS k", f"p_partkey % {len(KINDS)} AS r", "CAST(p_size AS STRING) AS n")
    g = some.selectExpr("k", f"{text} AS g").select("k", geo.from_text(F.col("g")).alias("g"))
    return g.select("k", "g.kind", "g.npoints", "g.xmax", "g.empty", "g.srid", "g.valid")


@query("st_segmentize", "SELECT p_partkey AS k, CAST(CEIL(p_size / 4.0) + 1 AS INTEGER) AS n, CAST(p_size AS DOUBLE) AS length FROM part")
def st_segmentize(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = geo.segmentize(F.array(geo.point(F.lit(0), F.lit(1)), geo.point(F.col("p_size"), F.lit(1))), 4)
    out = load(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), line.alias("l"))
    return out.select("k", F.size("l").alias("n"), F.round(geo.length(F.col("l")), 9).alias("length"))


# Geometry columns: boxes and lines made from keys, so that SQL can say how they lie.
BOXES = "t AS (SELECT p_partkey AS k, p_partkey % 6 AS ax, p_partkey % 6 + 1 + p_partkey % 4 AS ax1, p_partkey * 5 % 6 AS ay, p_partkey * 5 % 6 + 1 + p_partkey % 3 AS ay1, p_partkey * 7 % 5 AS bx, p_partkey * 7 % 5 + 1 + p_partkey // 6 % 4 AS bx1, p_partkey * 3 % 7 AS y, p_partkey * 3 % 7 + 1 + p_partkey // 4 % 3 AS y1 FROM part)"
MEET = "ax <= bx1 AND bx <= ax1 AND ay <= y1 AND y <= ay1"
INSIDE = "ax < bx1 AND bx < ax1 AND ay < y1 AND y < ay1"
A_IN_B = "ax >= bx AND ax1 <= bx1 AND ay >= y AND ay1 <= y1"
B_IN_A = "bx >= ax AND bx1 <= ax1 AND y >= ay AND y1 <= ay1"


def box_text(x0: str, y0: str, x1: str, y1: str) -> str:
    """A rectangle's text, in SQL."""
    return " || ".join(f"CAST({a} AS STRING) || ' ' || CAST({b} AS STRING) || '{end}'" for a, b, end in ((x0, y0, ","), (x1, y0, ","), (x1, y1, ","), (x0, y1, ","), (x0, y0, "))")))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rectangles of each part as geometry columns; every 19th first one is NULL."""
    ship(spark.sparkContext)
    made = spread(load(spark, sf_dir, "part", "p_partkey")).selectExpr(
        "p_partkey AS k", "p_partkey % 6 AS ax", "p_partkey % 6 + 1 + p_partkey % 4 AS ax1", "p_partkey * 5 % 6 AS ay", "p_partkey * 5 % 6 + 1 + p_partkey % 3 AS ay1",
        "p_partkey * 7 % 5 AS bx", "p_partkey * 7 % 5 + 1 + p_partkey div 6 % 4 AS bx1", "p_partkey * 3 % 7 AS y", "p_partkey * 3 % 7 + 1 + p_partkey div 4 % 3 AS y1",
    )
    texts = made.selectExpr("*", f"CASE WHEN k % 19 <> 0 THEN 'SRID=4326;POLYGON((' || {box_text('ax', 'ay', 'ax1', 'ay1')} END AS ta", f"'SRID=4326;POLYGON((' || {box_text('bx', 'y', 'bx1', 'y1')} AS tb")
    return texts.withColumns({"a": shapes.st_from_text(F.col("ta")), "b": shapes.st_from_text(F.col("tb"))})


_null = "CASE WHEN k % 19 <> 0 THEN {} END"
_relations = {
    "intersects": MEET, "disjoint": f"NOT ({MEET})", "contains": B_IN_A, "within": A_IN_B, "equals": f"({A_IN_B}) AND ({B_IN_A})",
    "touches": f"({MEET}) AND NOT ({INSIDE})", "crosses": "FALSE", "overlaps": f"({INSIDE}) AND NOT ({A_IN_B}) AND NOT ({B_IN_A})",
}


@query("st_relations", f"WITH {BOXES} SELECT k, {', '.join(f'{_null.format(w)} AS {n}' for n, w in _relations.items())} FROM t")
def st_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of pairs of polygons."""
    return boxes(spark, sf_dir).select("k", shapes.st_relate(F.col("a"), F.col("b")).alias("r")).select("k", "r.*")


@query("st_polygon_distance", f"WITH {BOXES} SELECT k, ROUND({_null.format('SQRT(POW(GREATEST(ax - bx1, bx - ax1, 0), 2) + POW(GREATEST(ay - y1, y - ay1, 0), 2))')}, 9) AS d FROM t")
def st_polygon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("k", F.round(shapes.st_distance(F.col("a"), F.col("b")), 9).alias("d"))


@query("st_pairwise_intersects", f"WITH {BOXES} SELECT COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS s FROM t WHERE k % 19 <> 0 AND {MEET}")
def st_pairwise_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair i with i of two geometry columns."""
    met = boxes(spark, sf_dir).where(shapes.st_relation("intersects", F.col("a"), F.col("b")))
    return met.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s"))


LINES = "t AS (SELECT p_partkey AS k, p_partkey % 9 - 2 AS x, p_partkey % 9 - 2 + 1 + p_partkey % 5 AS x1, p_partkey * 5 % 7 - 1 AS h FROM part)"


@query("st_line_relations", f"WITH {LINES} SELECT k, x <= 4 AND x1 >= 0 AND h BETWEEN 0 AND 4 AS intersects, (x < 4 AND x1 > 0 AND h > 0 AND h < 4) AND NOT (x >= 0 AND x1 <= 4) AS crosses, x >= 0 AND x1 <= 4 AND h > 0 AND h < 4 AS within, (x <= 4 AND x1 >= 0 AND h BETWEEN 0 AND 4) AND NOT (x < 4 AND x1 > 0 AND h > 0 AND h < 4) AS touches FROM t")
def st_line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lines against a square."""
    ship(spark.sparkContext)
    made = spread(load(spark, sf_dir, "part", "p_partkey")).selectExpr("p_partkey AS k", "p_partkey % 9 - 2 AS x", "p_partkey % 9 - 2 + 1 + p_partkey % 5 AS x1", "p_partkey * 5 % 7 - 1 AS h")
    line = shapes.st_make_line(F.array(shapes.st_make_point(F.col("x"), F.col("h")), shapes.st_make_point(F.col("x1"), F.col("h"))))
    r = shapes.st_relate(line, shapes.geometry("POLYGON((0 0,4 0,4 4,0 4,0 0))"))
    return made.select("k", r.alias("r")).select("k", "r.intersects", "r.crosses", "r.within", "r.touches")


TRIANGLES = "z AS (SELECT c_custkey AS zone, c_custkey * 53 % 1000 AS x0, c_custkey * 71 % 800 AS y0, 10 + c_custkey % 20 AS side FROM customer)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-angled triangles as a column of rings, with their boxes."""
    c = F.col("c_custkey")
    some = load(spark, sf_dir, "customer", "c_custkey").select(c.alias("zone"), (c * 53 % 1000).cast("double").alias("x0"), (c * 71 % 800).cast("double").alias("y0"), (10 + c % 20).alias("side")).withColumns({"x1": F.col("x0") + F.col("side"), "y1": F.col("y0") + F.col("side")})
    corners = [geo.point(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0"))]
    return some.withColumn("ring", F.array(*corners))


def in_triangles(some: DataFrame, zones: DataFrame) -> DataFrame:
    """Pairs of points, or places, and forms of triangles."""
    exact = geo.ring_side(F.col("x"), F.col("y"), F.col("ring")) >= 0
    return forms_join(some, "x", "y", zones, ["ring"], ("x0", "y0", "x1", "y1"), 20, exact, widest=29)


IN_ZONE = "x >= x0 AND y >= y0 AND (x - x0) + (y - y0) <= side"


@query("spatial_join_polygons", f"{POINTS}, {TRIANGLES} SELECT zone, COUNT(*) AS n, MIN(k) AS lo FROM t JOIN z ON {IN_ZONE} GROUP BY zone")
def spatial_join_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in polygons that are rows themselves, grouped by polygon."""
    zones = triangles(spark, sf_dir)
    return of_zones(zones, in_triangles(places(points(spark, sf_dir)), zones), ["ring"])


@query("window_over_spatial_join", f"{POINTS}, {TRIANGLES}, j AS (SELECT zone, k, x, y, x0, y0 FROM t JOIN z ON {IN_ZONE}) SELECT zone, k, CAST(rn AS BIGINT) AS rn, n FROM (SELECT zone, k, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY (x - x0) * (x - x0) + (y - y0) * (y - y0), k) AS rn, COUNT(*) OVER (PARTITION BY zone) AS n FROM j) w WHERE rn <= 3")
def window_over_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three points of each polygon that are nearest its corner: they are among the three least keys of their places."""
    far = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))
    some, zones = points(spark, sf_dir), triangles(spark, sf_dir)
    nearest = in_triangles(least_of_places(some, "x", "y", "k", 3), zones)
    own = F.row_number().over(Window.partitionBy("ring").orderBy(far, "k"))
    ranked = nearest.select("ring", "k", far.alias("far"), own.alias("own")).where("own <= 3")
    counted = in_triangles(places(some), zones).groupBy("ring").agg(F.sum("n").alias("n"))
    met, zone = zones.join(ranked.join(counted, "ring"), "ring"), Window.partitionBy("zone")
    n = F.sum(F.when(F.col("own") == 1, F.col("n"))).over(zone)
    return met.select("zone", "k", F.row_number().over(zone.orderBy("far", "k")).cast("long").alias("rn"), n.alias("n")).where("rn <= 3")


@query("set_over_spatial", f"{POINTS} SELECT k FROM t WHERE {IN_TRIANGLE} EXCEPT SELECT k FROM t WHERE x >= 250 AND x <= 400 AND y >= 100 AND y <= 500")
def set_over_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a triangle except those in a box."""
    x, y, some = F.col("x"), F.col("y"), points(spark, sf_dir)
    box = [[(250, 100), (400, 100), (400, 500), (250, 500)]]
    return some.where(geo.intersects(x, y, [TRIANGLE])).select("k").subtract(some.where(geo.intersects(x, y, box)).select("k"))


@query("st_makers", "SELECT p_partkey AS k, 'LINESTRING(0 0,' || p_size || ' 3)' AS line, ROUND(SQRT(p_size * p_size + 9), 9) AS length, 'POLYGON((0 0,' || p_size || ' 0,' || p_size || ' 2,0 0))' AS polygon, CAST(p_size AS DOUBLE) AS area, 41 AS bytes FROM part")
def st_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and polygons from points, their text and binary form."""
    ship(spark.sparkContext)
    n = F.col("p_size")
    at = lambda x, y: shapes.st_make_point(x if not isinstance(x, int) else F.lit(x), F.lit(y))
    made = spread(load(spark, sf_dir, "part", "p_partkey", "p_size")).select(F.col("p_partkey").alias("k"), shapes.st_make_line(F.array(at(0, 0), at(n, 3))).alias("l"), shapes.st_make_polygon(shapes.st_make_line(F.array(at(0, 0), at(n, 0), at(n, 2), at(0, 0)))).alias("p"))
    return made.select("k", shapes.st_as_text(F.col("l")).alias("line"), F.round(shapes.st_length(F.col("l")), 9).alias("length"), shapes.st_as_text(F.col("p")).alias("polygon"), shapes.st_area(F.col("p")).alias("area"), F.octet_length(shapes.st_as_ewkb(F.col("l"))).alias("bytes"))


@query("st_buffer_area", "SELECT p_partkey AS k, ROUND(16 * p_size * p_size * SIN(PI() / 16), 6) AS area, 33 AS npoints FROM part")
def st_buffer_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points buffered by polygons of 32 corners."""
    ship(spark.sparkContext)
    parts = spread(load(spark, sf_dir, "part", "p_partkey", "p_size")).select(F.col("p_partkey").alias("k"), "p_size", shapes.st_make_point(F.col("p_partkey"), F.lit(1)).alias("g"))
    unit = shapes.st_buffer(F.col("g"), 1.0)
    return parts.select("k", F.round(shapes.st_area(unit) * F.col("p_size") * F.col("p_size"), 6).alias("area"), shapes.st_npoints(unit).alias("npoints"))


@query("st_transform", f"{POINTS} SELECT k, ROUND((x / 10 - 50) * 20037508.342789244 / 180, 3) AS mx, ROUND(LN(TAN(PI() / 4 + RADIANS(y / 10 - 40) / 2)) * 20037508.342789244 / PI(), 3) AS my FROM t WHERE x IS NOT NULL AND y IS NOT NULL")
def st_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to the square map of the world."""
    ship(spark.sparkContext)
    some = points(spark, sf_dir).where("x IS NOT NULL AND y IS NOT NULL")
    g = shapes.st_transform(shapes.st_make_point(F.col("x") / 10 - 50, F.col("y") / 10 - 40, 4326), 3857)
    return some.select("k", g.alias("g")).select("k", F.round(shapes.st_x(F.col("g")), 3).alias("mx"), F.round(shapes.st_y(F.col("g")), 3).alias("my"))


@query("st_geography_distance", f"{POINTS} SELECT k, ROUND(2 * 6371008.771415 * ASIN(SQRT(POW(SIN(RADIANS(10 - (y / 10 - 40)) / 2), 2) + COS(RADIANS(y / 10 - 40)) * COS(RADIANS(10)) * POW(SIN(RADIANS(20 - (x / 10 - 50)) / 2), 2))), 3) AS metres FROM t")
def st_geography_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry columns in degrees, measured on the sphere."""
    ship(spark.sparkContext)
    g = shapes.st_make_point(F.col("x") / 10 - 50, F.col("y") / 10 - 40, 4326)
    return points(spark, sf_dir).select("k", F.round(shapes.st_distance_sphere(g, shapes.geometry("SRID=4326;POINT(20 10)")), 3).alias("metres"))


@query("st_column_centroid", "SELECT p_partkey AS k, ROUND(p_partkey % 50 + p_size / 3.0, 8) AS x, ROUND(2 * p_size / 3.0, 8) AS y FROM part")
def st_column_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of triangles with corners (k, 0), (k + n, n) and (k, n), as geometry columns."""
    ship(spark.sparkContext)
    text = "'POLYGON((' || x || ' 0,' || x1 || ' ' || n || ',' || x || ' ' || n || ',' || x || ' 0))'"
    made = spread(load(spark, sf_dir, "part", "p_partkey", "p_size")).selectExpr("p_partkey AS k", "CAST(p_partkey % 50 AS STRING) AS x", "CAST(p_partkey % 50 + p_size AS STRING) AS x1", "CAST(p_size AS STRING) AS n")
    c = made.select("k", shapes.st_centroid(shapes.st_from_text(F.expr(text))).alias("c"))
    return c.select("k", F.round(shapes.st_x(F.col("c")), 8).alias("x"), F.round(shapes.st_y(F.col("c")), 8).alias("y"))
