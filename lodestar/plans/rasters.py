"""Queries on rasters: 10 x 10 tiles whose pixels are made from keys; every 17th is NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import raster
from lodestar.plans.registry import query
from lodestar.sources.shipping import ship
from lodestar.sources.tables import load, spread

TILES = """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE list_transform(range(100), lambda i: (p_partkey * 31 + i * 7) % 50) END AS a,
CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE list_transform(range(100), lambda i: (p_partkey * 13 + i * 11) % 40) END AS b FROM part)"""
RULES = "1:10,2:20,3:30,7:70,49:255"
RULES_SQL = "CASE x WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 7 THEN 70 WHEN 49 THEN 255 ELSE 0 END"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pixel = lambda m, s, n: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (k * m + i * s) % n)
    some = k % 17 != 0
    return spread(load(spark, sf_dir, "part", "p_partkey")).select(k.alias("k"), F.when(some, pixel(31, 7, 50)).alias("a"), F.when(some, pixel(13, 11, 40)).alias("b"))


@query("raster_reclass", f"{TILES} SELECT k, array_to_string(list_transform(a, lambda x: {RULES_SQL}), ',') AS pixels FROM t")
def raster_reclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("k", F.array_join(raster.reclass(F.col("a"), RULES, whole=True), ",").alias("pixels"))


@query("raster_reclass_sum", f"{TILES} SELECT COUNT(*) AS n, CAST(SUM(list_sum(list_transform(a, lambda x: {RULES_SQL}))) AS BIGINT) AS s FROM t")
def raster_reclass_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.aggregate(raster.reclass(F.col("a"), RULES, whole=True), F.lit(0).cast("long"), lambda s, v: s + v)
    return tiles(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(done).alias("s"))


@query("raster_reclass_ranges", f"{TILES} SELECT k, CAST(list_sum(list_transform(a, lambda x: CASE WHEN x < 10 THEN 1 WHEN x < 30 THEN 2 ELSE 0 END)) AS BIGINT) AS s FROM t")
def raster_reclass_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.aggregate(raster.reclass_ranges(F.col("a"), [(0, 10, 1), (10, 30, 2)]), F.lit(0.0), lambda s, v: s + v)
    return tiles(spark, sf_dir).select("k", done.cast("long").alias("s"))


@query("raster_ndvi", f"{TILES} SELECT k, ROUND(list_avg(list_transform(list_zip(a, b), lambda p: CASE WHEN p[1] + p[2] = 0 THEN 0.0 ELSE CAST(p[1] - p[2] AS DOUBLE) / (p[1] + p[2]) END)), 8) AS mean FROM t")
def raster_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = raster.ndvi(F.col("a"), F.col("b"))
    return tiles(spark, sf_dir).select("k", F.round(F.aggregate(done, F.lit(0.0), lambda s, v: s + v) / 100, 8).alias("mean"))


@query("raster_summary", f"{TILES} SELECT k, CAST(len(list_filter(a, lambda x: x <> 0)) AS BIGINT) AS n, CAST(list_sum(a) AS DOUBLE) AS s, ROUND(list_stddev_pop(list_filter(a, lambda x: x <> 0)), 8) AS sd, CAST(list_min(list_filter(a, lambda x: x <> 0)) AS DOUBLE) AS lo, CAST(list_max(a) AS DOUBLE) AS hi FROM t")
def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tiles(spark, sf_dir).select("k", raster.summary(F.col("a"), nodata=0).alias("s"))
    return s.select("k", F.col("s.count").alias("n"), F.col("s.sum").alias("s"), F.round("s.stddev", 8).alias("sd"), F.col("s.min").alias("lo"), F.col("s.max").alias("hi"))


@query("raster_value_clip", f"{TILES} SELECT k, a[24] AS v, array_to_string(list_transform([12, 13, 22, 23], lambda i: a[i]), ',') AS clipped FROM t WHERE a IS NOT NULL")
def raster_value_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return tiles(spark, sf_dir).where(a.isNotNull()).select("k", raster.value(a, 10, F.lit(4), F.lit(3)).alias("v"), F.array_join(raster.clip(a, 10, 2, 2, 3, 3), ",").alias("clipped"))


def at_sql(dx: int, dy: int) -> str:
    """A neighbour of pixel i in SQL; beyond the edge the pixel itself."""
    return f"CASE WHEN i % 10 + {dx} BETWEEN 0 AND 9 AND i // 10 + {dy} BETWEEN 0 AND 9 THEN a[(i // 10 + {dy}) * 10 + i % 10 + {dx} + 1] ELSE a[i + 1] END"


_east = " + ".join(f"{w} * ({at_sql(1, dy)})" for dy, w in ((-1, 1), (0, 2), (1, 1)))
_west = " + ".join(f"{w} * ({at_sql(-1, dy)})" for dy, w in ((-1, 1), (0, 2), (1, 1)))
_south = " + ".join(f"{w} * ({at_sql(dx, 1)})" for dx, w in ((-1, 1), (0, 2), (1, 1)))
_north = " + ".join(f"{w} * ({at_sql(dx, -1)})" for dx, w in ((-1, 1), (0, 2), (1, 1)))


@query("raster_slope", f"{TILES} SELECT k, ROUND(list_sum(list_transform(range(100), lambda i: degrees(atan(sqrt(pow((({_east}) - ({_west})) / 8.0, 2) + pow((({_south}) - ({_north})) / 8.0, 2)))))) / 100, 6) AS mean FROM (SELECT k, a FROM t WHERE a IS NOT NULL)")
def raster_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark.sparkContext)
    done = raster.slope(F.col("a"), 10, 10)
    return tiles(spark, sf_dir).where("a IS NOT NULL").select("k", F.round(F.aggregate(done, F.lit(0.0), lambda s, v: s + v) / 100, 6).alias("mean"))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of two bands, the first of whole numbers without a value where it is 7, the second of real ones."""
    r = raster.make_empty(F.when(F.col("a").isNotNull(), F.lit(10)), F.lit(10))
    two = raster.add_band(raster.add_band(r, "8BUI", F.col("a"), nodata=7), "64BF", F.transform(F.col("b"), lambda v: v / 4))
    return tiles(spark, sf_dir).select("k", two.alias("r"))


@query("raster_bands", f"{TILES} SELECT k, CASE WHEN a IS NOT NULL THEN 2 END AS n, CASE WHEN a IS NOT NULL THEN 10 END AS width, CASE WHEN a IS NOT NULL THEN '8BUI' END AS kind, CASE WHEN a IS NOT NULL THEN 7.0::DOUBLE END AS nodata, CAST(NULLIF(a[k % 10 + 1], 7) AS DOUBLE) AS v, b[10 * (k % 10) + 3] / 4.0 AS w, CASE WHEN a IS NOT NULL THEN 61 + 102 + 809 END AS bytes FROM t")
def raster_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors of rasters with bands, and the length of the binary form."""
    r, x = F.col("r"), (F.col("k") % 10).cast("int")
    first = raster.band(r, 1)
    return banded(spark, sf_dir).select(
        "k", raster.num_bands(r).alias("n"), r["width"].alias("width"), first["kind"].alias("kind"), first["nodata"].alias("nodata"), raster.band_value(r, 1, x + 1, F.lit(1)).alias("v"), raster.band_value(r, 2, F.lit(3), x + 1).alias("w"), F.octet_length(raster.as_binary(r)).alias("bytes")
    )


@query("raster_reclass_band", f"{TILES} SELECT k, CAST(list_sum(list_transform(a, lambda x: {RULES_SQL})) AS DOUBLE) AS first, list_sum(b) / 4.0 AS second, list_sum(b) / 4.0 AS untouched FROM t")
def raster_reclass_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band of two is changed; a band that is missing leaves the raster as it is."""
    total = lambda r, n: F.aggregate(raster.band(r, n)["pixels"], F.lit(0.0), lambda s, v: s + v)
    changed, same = raster.reclass_band(F.col("r"), 1, RULES), raster.reclass_band(F.col("r"), 5, RULES)
    return banded(spark, sf_dir).select("k", total(changed, 1).alias("first"), total(changed, 2).alias("second"), total(same, 2).alias("untouched"))
