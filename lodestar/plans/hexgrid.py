"""Queries on hexagonal grid cells. Cells are made from keys: base cell, resolution and digits by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import h3
from lodestar.functions.h3grid import cell_to_boundary, cell_to_latlng, grid_disk, grid_distance, grid_ring, latlng_to_cell, polygon_to_cells
from lodestar.plans.registry import query
from lodestar.sources.shipping import ship
from lodestar.sources.tables import load, spread

RES = 9


def cell_sql(key: str, base: str = "{key} % 122", res: int = RES) -> str:
    """A cell from a key, in SQL."""
    digits = " + ".join(f"(({key} // {7**(d - 1)} + {d}) % 7) * {1 << (45 - 3 * d)}" for d in range(1, res + 1))
    rest = sum(7 << (45 - 3 * d) for d in range(res + 1, 16))
    return f"({(1 << 59) + (res << 52) + rest} + ({base.format(key=key)}) * {1 << 45} + {digits})"


def cell_column(key: Column, base: Column | None = None, res: int = RES) -> Column:
    """The same with Spark's functions."""
    key = key.cast("long")
    out = F.lit((1 << 59) + (res << 52) + sum(7 << (45 - 3 * d) for d in range(res + 1, 16))) + (key % 122 if base is None else base) * (1 << 45)
    for d in range(1, res + 1):
        out = out + (F.call_function("div", key, F.lit(7 ** (d - 1)).cast("long")) + d) % 7 * (1 << (45 - 3 * d))
    return out.cast("long")


CELLS = f"WITH t AS (SELECT c_custkey AS k, {cell_sql('c_custkey')} AS cell FROM customer)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), cell_column(F.col("c_custkey")).alias("cell"))


@query("h3_cell_to_parent", f"{CELLS} SELECT k, (cell & ~(15::BIGINT << 52)) | (5::BIGINT << 52) | ((1::BIGINT << 30) - 1) AS parent FROM t")
def h3_cell_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("k", h3.parent(F.col("cell"), 5).alias("parent"))


@query("h3_parent_count", f"WITH t AS (SELECT {cell_sql('l_partkey')} AS cell FROM lineitem) SELECT (cell & ~(15::BIGINT << 52)) | (2::BIGINT << 52) | ((1::BIGINT << 39) - 1) AS parent, COUNT(*) AS n FROM t GROUP BY 1")
def h3_parent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem", "l_partkey").select(cell_column(F.col("l_partkey")).alias("cell"))
    return items.groupBy(h3.parent(F.col("cell"), 2).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("h3_bits", f"WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN {cell_sql('c_custkey')} WHEN 1 THEN {cell_sql('c_custkey', res=4)} ELSE {cell_sql('c_custkey', res=15)} END + CASE WHEN c_custkey % 5 = 0 THEN 1::BIGINT << 56 ELSE 0 END AS cell FROM customer) SELECT k, CASE k % 3 WHEN 0 THEN 9 WHEN 1 THEN 4 ELSE 15 END AS res, k % 122 AS base, k % 5 <> 0 AS valid, k % 3 <> 1 AS class_iii FROM t")
def h3_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three resolutions, every fifth with a reserved bit set."""
    c, k = F.col("cell"), F.col("c_custkey")
    made = F.when(k % 3 == 0, cell_column(k)).when(k % 3 == 1, cell_column(k, res=4)).otherwise(cell_column(k, res=15))
    made = made + F.when(k % 5 == 0, F.lit(1 << 56)).otherwise(F.lit(0).cast("long"))
    return load(spark, sf_dir, "customer", "c_custkey").select(k.alias("k"), made.alias("cell")).select("k", h3.resolution(c).alias("res"), h3.base_cell(c).alias("base"), h3.is_valid(c).alias("valid"), h3.is_class_iii(c).alias("class_iii"))


@query(
    "h3_validity",
    f"""WITH t AS (SELECT c_custkey AS k, {cell_sql('c_custkey')} AS cell FROM customer) SELECT k, k % 4 = 0 AS valid FROM t""",
)
def h3_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four cells are spoilt: in mode, in a digit, in the base cell."""
    c, k = F.col("cell"), F.col("k")
    spoilt = F.when(k % 4 == 1, c.bitwiseXOR(F.lit(1 << 60))).when(k % 4 == 2, c.bitwiseOR(F.lit(7 << (45 - 3 * 4)))).when(k % 4 == 3, c.bitwiseOR(F.lit(127 << 45))).otherwise(c)
    return cells(spark, sf_dir).select("k", h3.is_valid(spoilt).alias("valid"))


@query("h3_center_child", f"{CELLS} SELECT k, (cell & ~(15::BIGINT << 52) & ~(((1::BIGINT << 9) - 1) << 9)) | (12::BIGINT << 52) AS child FROM t")
def h3_center_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("k", h3.center_child(F.col("cell"), 12).alias("child"))


@query("h3_pentagons", "SELECT b, b IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) AS pentagon, CASE WHEN b IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) THEN 41 ELSE 49 END AS children FROM (SELECT UNNEST(range(122)) AS b) t")
def h3_pentagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base cells as cells of resolution 0, and how many descendants each has two levels below."""
    base = spark.range(122).select(F.col("id").alias("b"), (F.lit((1 << 59) + (1 << 45) - 1) + F.col("id") * (1 << 45)).alias("cell"))
    return base.select("b", h3.is_pentagon(F.col("cell")).alias("pentagon"), h3.child_count(F.col("cell"), 2).alias("children"))


@query("h3_cell_to_children", f"{CELLS} SELECT k, (cell & ~(15::BIGINT << 52) & ~(7::BIGINT << 15)) | (10::BIGINT << 52) | (d << 15) AS child FROM t, (SELECT UNNEST(range(7)) AS d) x")
def h3_cell_to_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("k", F.explode(h3.children(F.col("cell"), 10)).alias("child"))


@query("h3_latlng_to_cell")
def h3_latlng_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of points made from keys; every 17th point is NULL."""
    ship(spark.sparkContext)
    k = F.col("event_id")
    lat, lng = F.when(k % 17 != 0, (k * 37 % 16900) / 100.0 - 84.5), (k * 101 % 35900) / 100.0 - 179.5
    return spread(load(spark, sf_dir, "events", "event_id")).select(k.alias("k"), latlng_to_cell(lat, lng, 7).alias("cell"))


@query("h3_latlng_count")
def h3_latlng_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points grouped by cell."""
    return h3_latlng_to_cell(spark, sf_dir).groupBy(h3.parent(F.col("cell"), 2).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


#: Keys whose cells are no descendants of pentagons, in SQL and here.
HEXAGONS = f"c_custkey % 122 NOT IN {h3.PENTAGONS}"


def places(spark: SparkSession, sf_dir: str, res: int = RES) -> DataFrame:
    """Cells that have a place: the digits made from keys may be such as pentagons lack."""
    ship(spark.sparkContext)
    k = F.col("c_custkey")
    return spread(load(spark, sf_dir, "customer", "c_custkey")).where(~(k % 122).isin(*h3.PENTAGONS)).select(k.alias("k"), cell_column(k, res=res).alias("cell"))


@query("h3_center_and_back", f"{CELLS.replace('FROM customer', 'FROM customer WHERE ' + HEXAGONS)} SELECT k, cell FROM t")
def h3_center_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to their centers, and these to cells: the way back must give every bit again."""
    c = cell_to_latlng(F.col("cell"))
    return places(spark, sf_dir).select("k", c.alias("c")).select("k", latlng_to_cell(F.col("c.lat"), F.col("c.lng"), RES).alias("cell"))


EIGHT = f"WITH t AS (SELECT c_custkey AS k, {cell_sql('c_custkey', res=8)} AS cell FROM customer WHERE {HEXAGONS})"
NINTH = "(cell & ~(15::BIGINT << 52) & ~(7::BIGINT << 18)) | (9::BIGINT << 52)"


@query("h3_grid_disk", f"{EIGHT} SELECT k, {NINTH} | (d << 18) AS near FROM t, (SELECT UNNEST(range(7)) AS d) x")
def h3_grid_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disk of one step around a center child holds its parent's seven children."""
    return places(spark, sf_dir, 8).select("k", F.explode(grid_disk(h3.center_child(F.col("cell"), 9), 1)).alias("near"))


@query("h3_grid_ring", f"{EIGHT} SELECT k, {NINTH} | (d << 18) AS near FROM t, (SELECT UNNEST(range(1, 7)) AS d) x")
def h3_grid_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir, 8).select("k", F.explode(grid_ring(h3.center_child(F.col("cell"), 9), 1)).alias("near"))


@query("h3_grid_distance", f"{EIGHT}, r AS (SELECT * FROM (VALUES (1, 0), (5, 1), (4, 2), (6, 3), (2, 4), (3, 5)) v(d, place)) SELECT k, {NINTH} | (x.d << 18) AS a, {NINTH} | (y.d << 18) AS b, CASE WHEN x.d = y.d THEN 0 WHEN ABS(x.place - y.place) IN (1, 5) THEN 1 ELSE 2 END AS steps FROM t, r x, r y WHERE k <= 300")
def h3_grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the six outer children of a cell: neighbours in the ring are one step apart, others two through the middle."""
    outer = F.filter(h3.children(F.col("cell"), 9), lambda c: h3.digit(c, 9) != 0)
    pairs = places(spark, sf_dir, 8).where("k <= 300").select("k", F.explode(outer).alias("a"), outer.alias("o")).select("k", "a", F.explode("o").alias("b"))
    return pairs.withColumn("steps", grid_distance(F.col("a"), F.col("b")).cast("int"))


@query("h3_boundary", "SELECT b, CASE WHEN b IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) THEN 5 ELSE 6 END AS corners, CASE WHEN b IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) THEN 5 ELSE 6 END AS held FROM (SELECT UNNEST(range(122)) AS b) t")
def h3_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of cells, and how many lie in the cell once they are moved a little to its center."""
    ship(spark.sparkContext)
    base = spark.range(122).select(F.col("id").alias("b"), h3.center_child(F.lit((1 << 59) + (1 << 45) - 1) + F.col("id") * (1 << 45), 4).alias("cell"))
    corners = base.select("b", "cell", cell_to_latlng(F.col("cell")).alias("c"), F.posexplode(cell_to_boundary(F.col("cell"))).alias("i", "p"))
    moved = lambda n: F.col(f"p.{n}") + 0.05 * (F.col(f"c.{n}") - F.col(f"p.{n}"))
    back = corners.select("b", (latlng_to_cell(moved("lat"), moved("lng"), 4) == F.col("cell")).alias("same"))
    return back.groupBy("b").agg(F.count(F.lit(1)).cast("int").alias("corners"), F.count_if("same").cast("int").alias("held"))


@query("h3_polygon_to_cells")
def h3_polygon_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of boxes, one for each nation."""
    ship(spark.sparkContext)
    k = F.col("n_nationkey")
    corner = lambda a, b: F.struct((k * 3.0 - 40 + a).alias("lat"), (k * 7.0 - 100 + b).alias("lng"))
    ring = F.array(corner(0, 0), corner(0, 6), corner(5, 6), corner(5, 0))
    return spread(load(spark, sf_dir, "nation", "n_nationkey")).select(k, F.explode(polygon_to_cells(ring, 3)).alias("cell"))
