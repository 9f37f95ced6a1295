"""Operators and functions on small made-up rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geo, h3, pg, raster, registry, shapes
from lodestar.operators.aggregates import average_seconds, distinct_on, ordered_array
from lodestar.operators.joins import null_aware_anti, range_join, salted_join
from lodestar.operators.recursion import recursive_union
from lodestar.operators.spatial import boxes_join, grid_join
from lodestar.operators.windows import with_global_rank
from lodestar.sources.tables import Pins, Prepared, create_table_as, delete_where, generate_series, insert_select, load, update_where, write_table


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_range_join(spark):
    r = random.Random(1)
    points = [(i, r.uniform(-50, 50) if i % 9 else None) for i in range(200)]
    ranges = [(i, a := r.uniform(-60, 60), a + r.choice((-1, 0, 3, 40))) for i in range(60)] + [(99, None, 1.0)]
    got = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "q int, lo double, hi double"), "x", "lo", "hi", 7).select("p", "q")
    want = [(p, q) for p, x in points for q, lo, hi in ranges if x is not None and lo is not None and lo <= x <= hi]
    assert values(got) == sorted(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(60)], "a int, k int")
    right = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (None, "n")], "k int, b string")
    got, want = salted_join(left, right, "k", 4, how), left.join(right, "k", how)
    assert Counter(map(str, got.select(*sorted(got.columns)).collect())) == Counter(map(str, want.select(*sorted(want.columns)).collect()))
    with pytest.raises(ValueError):
        salted_join(left, right, "k", 4, "full")


def test_null_aware_anti(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "b int")
    assert values(null_aware_anti(left, of(2), "a", "b")) == [(1,)]
    assert null_aware_anti(left, of(2, None), "a", "b").count() == 0
    assert null_aware_anti(left, of(), "a", "b").count() == 3


def test_ordered_array_and_distinct_on(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), ("a", 2, "z")], "k string, o int, v string")
    assert values(df.groupBy("k").agg(ordered_array("v", "o").alias("r"))) == [("a", ["y", "z", "x"]), ("b", [None])]
    assert values(distinct_on(df, ["k"], [F.col("o")]).select("k", "o", "v")) == [("a", 1, "y"), ("b", 2, None)]


def test_average_of_long_intervals(spark):
    """Intervals whose sum is beyond 2^63 microseconds, and one that is unknown."""
    df = spark.sql("SELECT TIMESTAMP '1000-01-01 00:00:00' AS a, IF(id = 9, NULL, TIMESTAMP '9000-01-01 00:00:00.5' + make_dt_interval(0, 0, 0, id % 3)) AS b FROM range(300)")
    days = (datetime(9000, 1, 1) - datetime(1000, 1, 1)).days
    assert df.agg(average_seconds(F.col("a"), F.col("b"))).first()[0] == pytest.approx(days * 86400 + 0.5 + 300 / 299, abs=1e-4)


def test_grid_join(spark):
    r = random.Random(2)
    pts = [(i, r.uniform(0, 100), r.uniform(0, 100) if i % 11 else None) for i in range(300)]
    boxes = [(i, x := r.uniform(-5, 95), y := r.uniform(-5, 95), x + r.uniform(0, 25), y + r.uniform(0, 25)) for i in range(40)]
    got = grid_join(spark.createDataFrame(pts, "p int, x double, y double"), "x", "y", spark.createDataFrame(boxes, "b int, x0 double, y0 double, x1 double, y1 double"), ("x0", "y0", "x1", "y1"), 10)
    want = [(p, b) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if y is not None and x0 <= x <= x1 and y0 <= y <= y1]
    assert values(got.select("p", "b")) == sorted(want)


def test_pins(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(100).withColumns({"v": F.col("id") * 2, "w": F.col("id") * 3}), path)
    pins = Pins(spark)
    assert pins.pin("t", path, ["id"]) == 100
    assert pins.status().collect()[0].columns == ["id"]
    assert pins.table("t", path, ["id"]).storageLevel.useMemory or pins.table("t", path, ["id"]).count() == 100
    assert pins.table("t", path, ["v"]).count() == 100  # not pinned: it is now
    assert pins.status().collect()[0].columns == ["id", "v"]
    insert_select(spark.createDataFrame([(7, 8, 100)], "v long, w long, id long"), path)
    assert not pins.dependencies().collect()[0].current
    assert pins.table("t", path, ["id"]).count() == 101  # the change is seen
    assert pins.dependencies().collect()[0].current and pins.ingestion().collect()[0].loads == 3
    assert [r.column for r in pins.representation().collect()] == ["id", "v"]
    assert pins.refresh("t") == 101
    pins.budget = pins.live_bytes()
    assert pins.table("t", path, ["w"]).count() == 101 and pins.status().collect()[0].columns == ["id", "v"]  # no room: read from its files
    said = [r.decision for r in pins.decisions().orderBy("request").collect()]
    assert said[0] == "served from storage" and "loaded: columns were missing" in said and "loaded again: files changed" in said and said[-1] == "read from files: not enough room"
    assert pins.evict() == "t" and not pins.unpin("t") and pins.live_bytes() == 0
    with pytest.raises(MemoryError):
        Pins(spark, budget=1).pin("t", path)


def test_changed_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(10).withColumn("v", F.when(F.col("id") % 3 != 0, F.col("id").cast("int"))), path)
    assert delete_where(spark, path, F.col("v") > 6) == 8
    assert update_where(spark, path, {"v": F.col("v") + F.col("id")}, F.col("id") < 3) == 8
    insert_select(spark.sql("SELECT CAST(77 AS BIGINT) AS v, CAST(9 AS INT) AS id").where("id > 9"), path)  # other types: cast
    insert_select(spark.sql("SELECT CAST(6 AS BIGINT) AS v, CAST(10 AS INT) AS id"), path)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got.pop(10) == 6 and got == {0: None, 1: 2, 2: 4, 3: None, 4: 4, 5: 5, 6: None, 9: None}
    assert dict(spark.read.parquet(path).dtypes)["v"] == "int"


def test_prepared_statements(spark):
    find = Prepared("SELECT id, s FROM {t} WHERE s = :name AND id > :least", {"t": spark.createDataFrame([(1, "a"), (2, "a"), (3, "x' OR 1=1")], "id int, s string")})
    assert values(find(name="a", least=1)) == [(2, "a")]
    assert values(find(name="x' OR 1=1", least=0)) == [(3, "x' OR 1=1")]


def test_global_row_numbers(spark, tmp_path, sf_dir):
    """Right whatever else is selected, over several files, with nulls, and for tables without rows."""
    path = str(tmp_path / "o")
    load(spark, sf_dir, "orders").repartition(7).write.parquet(path)
    got = with_global_rank(spark.read.parquet(path), ["o_totalprice", "o_orderkey"], "rn", alone=0).toPandas().sort_values("rn")
    assert got["rn"].tolist() == list(range(1, len(got) + 1))
    keys = list(zip(got["o_totalprice"], got["o_orderkey"], strict=True))
    assert keys == sorted(keys)
    rows = [(i, None if i % 3 else i % 7, float("nan") if i % 5 == 0 else i / 2) for i in range(500)]
    some = spark.createDataFrame(rows, "i int, a int, _part double").repartition(5)
    for alone in (0, 1 << 30):
        got = with_global_rank(some, ["a", "_part", "i"], "rn", alone).orderBy("rn").collect()
        assert [r.rn for r in got] == list(range(1, 501))
        assert [r.i for r in got] == [r.i for r in some.orderBy("a", "_part", "i").collect()]
        assert with_global_rank(some.where("i < 0"), ["i"], "rn", alone).count() == 0


def test_recursive_union(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None), (9, 9)], "f int, t int")
    seed = spark.createDataFrame([(1,), (1,)], "n int")
    got = [r.n for r in recursive_union(seed, lambda s: s.join(edges, F.col("n") == F.col("f")).select("t")).collect()]
    assert sorted(got, key=str) == [1, 2, 3, None]


def test_wide_ranges_and_boxes(spark):
    """Ranges and boxes far wider than the buckets are copied a few times only."""
    points = spark.createDataFrame([(i, float(i)) for i in range(0, 1000, 7)], "p int, x double")
    ranges = [(0, -1e9, 1e9), (1, 10.0, 500.0), (2, 3.0, 3.5), (3, 40.0, 45.0), (4, 0.0, float("inf"))]
    want = [(i, q) for i in range(0, 1000, 7) for q, lo, hi in ranges if lo <= i <= hi < float("inf")]
    joined = range_join(points, spark.createDataFrame(ranges, "q int, lo double, hi double"), "x", "lo", "hi", 1)
    assert values(joined.select("p", "q")) == sorted(want)
    for widest in (1, 40, 2e9):  # said rather than found; some are wider
        some = [r for r in ranges if widest > 1e6 or r[2] - r[1] < 1e6]
        joined = range_join(points, spark.createDataFrame(some, "q int, lo double, hi double"), "x", "lo", "hi", 1, widest)
        assert values(joined.select("p", "q")) == sorted(w for w in want if w[1] in {r[0] for r in some})
    r = random.Random(5)
    made = lambda n, wide: [(i, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.choice((0, 1, wide)), y + r.choice((0, 2, wide))) for i in range(n)]
    a, b = made(60, 300), made(50, 90)
    left, right = (spark.createDataFrame(rows, f"{n} int, {n}x0 double, {n}y0 double, {n}x1 double, {n}y1 double") for n, rows in (("a", a), ("b", b)))
    got = boxes_join(left, ("ax0", "ay0", "ax1", "ay1"), right, ("bx0", "by0", "bx1", "by1"), 2).select("a", "b")
    want = [(i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1]
    assert values(got) == sorted(want)
    assert values(boxes_join(left, ("ax0", "ay0", "ax1", "ay1"), right, ("bx0", "by0", "bx1", "by1"), 20, 90).select("a", "b")) == sorted(want)
    got = grid_join(spark.createDataFrame([(i, r.uniform(-60, 300), r.uniform(-60, 300)) for i in range(200)], "p int, x double, y double"), "x", "y", left, ("ax0", "ay0", "ax1", "ay1"), 2)
    assert all(q.ax0 <= q.x <= q.ax1 and q.ay0 <= q.y <= q.ay1 for q in got.collect()) and got.count() == got.select("p", "a").distinct().count()


def test_functions_by_name(spark):
    names = registry.register(spark)
    assert {"st_intersects", "st_overlaps", "h3_grid_disk"} <= set(names)
    got = spark.sql("SELECT st_area(st_geomfromtext('POLYGON((0 0,4 0,4 2,0 0))')) AS a, h3_latlng_to_cell(37.3615593D, -122.0553238D, 7) AS c, size(h3_grid_disk(h3_latlng_to_cell(10D, 20D, 5), 2)) AS n").collect()[0]
    assert (got.a, got.c, got.n) == (4.0, 0x87283472BFFFFFF, 19)
    assert dict(r for r in registry.device_info(spark).collect())["version"] == registry.version()
    assert {r.operator for r in registry.plan_stats(spark.range(10).groupBy().count()).collect()} & {"HashAggregate"}


def test_json_contains(spark):
    rows = [('{"a": [1, {"b": "x"}], "n": 2.0}', {"a": [{"b": "x"}], "n": 2}, True), ('{"a": 1}', {"a": "1"}, False), ('["foo", "bar"]', "bar", True), ('["foo"]', ["foo", "foo"], True), ("[1, 2]", [3], False), ('{"a": null}', {"a": None}, True), ("{}", {"a": None}, False), ("null", None, True), ('"x"', "x", True), ('{"it\'s": 1}', {"it's": 1}, True)]
    for text, want, found in rows:
        assert spark.createDataFrame([(text,)], "j string").select(pg.json_contains(F.col("j"), want)).collect()[0][0] is found, (text, want)
    assert spark.createDataFrame([(None,)], "j string").select(pg.json_contains(F.col("j"), {})).collect()[0][0] is None


def test_raster_bands(spark):
    one = spark.range(1)
    r = raster.add_band(raster.make_empty(F.lit(2), F.lit(2)), "16BSI", F.array(F.lit(1), F.lit(-2), F.lit(300), F.lit(0)), nodata=0)
    got = one.select(raster.as_binary(r).alias("b"), raster.band_value(r, 1, F.lit(2), F.lit(2)).alias("none"), raster.band_value(r, 1, F.lit(1), F.lit(2)).alias("v"), raster.band_value(r, 2, F.lit(1), F.lit(1)).alias("missing")).collect()[0]
    import struct

    assert bytes(got.b) == struct.pack("<BHHddddddiHH", 1, 0, 1, 1.0, -1.0, 0, 0, 0, 0, 0, 2, 2) + bytes([5 | 64]) + struct.pack("<5h", 0, 1, -2, 300, 0)
    assert (got.none, got.v, got.missing) == (None, 300.0, None)
    assert one.select(raster.num_bands(raster.make_empty(F.lit(None).cast("int"), F.lit(2)))).collect()[0][0] is None
    with pytest.raises(Exception, match="not a 8BUI"):
        one.select(raster.add_band(raster.make_empty(F.lit(1), F.lit(1)), "8BUI", F.array(F.lit(256)))).collect()
    with pytest.raises(ValueError):
        raster.add_band(raster.make_empty(F.lit(1), F.lit(1)), "8BUI", 256)
    assert raster.fits("32BF", 0.5) and not raster.fits("1BB", 2)


def test_equal_geometries_are_worked_out_once():
    """With Nones among them, and whatever a value is."""
    seen = []
    got = shapes.once(lambda a, b: seen.append((a, b)) or len(a) + len(b), [b"x", None, b"x", b"xy", b"x"], [b"", b"q", b"", None, b"z"])
    assert got == [1, None, 1, None, 2] and seen == [(b"x", b""), (b"x", b"z")]


def test_work_by_the_row_uses_all_cores(spark, tmp_path):
    """A file with one row group is dealt to all cores before geometries are made."""
    from lodestar.plans.catalog import QUERIES

    spark.range(2000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("st_buffer_area", "functions_by_name"):
        assert QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism, name


def test_made_points_and_lines(spark):
    """The same bytes as of one point at a time, with and without a reference system; NULL for NULL and NaN."""
    rows = [(1.5, -2.0), (None, 1.0), (3.0, None), (float("nan"), 4.0)]
    df = spark.createDataFrame(rows, "x double, y double").coalesce(1)
    for srid in (0, 4326):
        p = shapes.st_make_point(F.col("x"), F.col("y"), srid)
        got = [tuple(None if v is None else bytes(v) for v in r) for r in df.select(p.alias("p"), shapes.st_make_line(F.array(p, F.lit(None).cast("binary"))).alias("l"), shapes.st_make_line(F.array(F.lit(None).cast("binary"))).alias("none")).collect()]
        one = lambda x, y: shapes.to_ewkb(shapes.Shape(srid, "POINT", [("POINT", [shapes.np.array([[x, y]])])]))
        assert [r[0] for r in got] == [one(1.5, -2.0), None, None, None]
        line = shapes.from_ewkb(got[0][1])
        assert (line.srid, line.kind, line.vertices.tolist()) == (srid, "LINESTRING", [[1.5, -2.0]]) and got[1][1] is None and {r[2] for r in got} == {None}


def test_slopes_of_many_tiles(spark, monkeypatch):
    """Tiles of 3 x 2 pixels at once: NULL tiles and pixels, NaN, a tile cut short, an empty one, in blocks smaller than a tile."""
    import math

    import pyarrow as pa

    r = random.Random(3)
    tiles = [None, [], [1.0, 2.0, 4.0, 8.0], [None, 1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 1.0, 1.0, 1.0, 1.0, float("nan")], *[[r.uniform(0, 9) for _ in range(6)] for _ in range(40)]]

    def one(t):
        def at(i, dx, dy):
            x, y = i % 3 + dx, i // 3 + dy
            j = y * 3 + x if 0 <= x < 3 and 0 <= y < 2 else i
            return t[j] if j < len(t) else None

        out = []
        for i in range(len(t)):
            near = {(dx, dy): at(i, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy}
            if None in near.values():
                out.append(None)
                continue
            g = [sum(w * (near[p] - near[q]) for p, q, w in ps) / 16 for ps in ([((1, k), (-1, k), 2 - abs(k)) for k in (-1, 0, 1)], [((k, 1), (k, -1), 2 - abs(k)) for k in (-1, 0, 1)])]
            out.append(math.degrees(math.atan(math.hypot(*g))))
        return out

    want = [None if t is None else one(t) for t in tiles]
    same = lambda a, b: a == b or a is not None and b is not None and (a != a and b != b or math.isclose(a, b, abs_tol=1e-12))
    for block in (1, 20, 1 << 18):
        monkeypatch.setattr(raster, "BLOCK", block)
        got = raster.slopes(pa.array(tiles, pa.list_(pa.float64()))[0:], 3, 2, 2.0).to_pylist()
        assert [g if g is None else len(g) for g in got] == [w if w is None else len(w) for w in want]
        assert all(same(a, b) for g, w in zip(got, want, strict=True) if w for a, b in zip(g, w, strict=True))
        assert raster.slopes(pa.array(tiles, pa.list_(pa.float64()))[3:9], 3, 2, 2.0).to_pylist()[2:] == got[5:9]
    df = spark.createDataFrame([(t,) for t in tiles], "t array<double>").coalesce(1)
    got = [x[0] for x in df.select(raster.slope(F.col("t"), 3, 2, 2.0)).collect()]
    assert all((g is None) == (w is None) and (w is None or all(same(a, b) for a, b in zip(g, w, strict=True))) for g, w in zip(got, want, strict=True))


def test_partitioned_and_bucketed_tables(spark, tmp_path):
    path = str(tmp_path / "p")
    write_table(spark.range(90).withColumn("k", F.col("id") % 3), path, partition_by=["k"], rows_per_file=20)
    assert spark.read.parquet(path).where("k = 1").count() == 30
    spark.sql("DROP TABLE IF EXISTS bucketed_t")
    create_table_as(spark.range(50), "bucketed_t", (4, "id"))
    assert spark.table("bucketed_t").count() == 50
    spark.sql("DROP TABLE bucketed_t")
    assert [r[0] for r in generate_series(spark, 5, 1, -2).orderBy("generate_series").collect()] == [1, 3, 5]


@pytest.mark.parametrize("bad", [lambda: pg.sqrt(F.lit(-1.0)), lambda: pg.ln(F.lit(0.0)), lambda: pg.log(F.lit(-2.0)), lambda: pg.power(F.lit(-2.0), F.lit(0.5)), lambda: pg.int_div(F.lit(1), F.lit(0))])
def test_errors_as_in_postgresql(spark, bad):
    with pytest.raises(Exception, match="cannot take|out of range|division by zero"):
        spark.range(1).select(bad().alias("v")).collect()


def test_integer_division_and_rounding(spark):
    one = spark.range(1)
    got = one.select(*[pg.int_div(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(((7, 2), (-7, 2), (7, -2), (2**60 + 1, 1)))]).collect()[0]
    assert tuple(got) == (3, -3, -3, 2**60 + 1)
    assert tuple(one.select(*[pg.rounded(F.lit(x)).alias(f"c{i}") for i, x in enumerate((2.5, -2.5, 0.4))]).collect()[0]) == (3.0, -3.0, 0.0)


TEXTS = {
    "POINT(1 2)": ("POINT", False, 1, True),
    "SRID=4326;LINESTRING(0 0,1 1,2 0)": ("LINESTRING", False, 3, True),
    "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))": ("POLYGON", False, 10, True),
    "POLYGON((0 0,4 4,4 0,0 4,0 0))": ("POLYGON", False, 5, False),
    "MULTIPOINT((1 1),(2 2))": ("MULTIPOINT", False, 2, True),
    "MULTIPOINT(1 1,2 2)": ("MULTIPOINT", False, 2, True),
    "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))": ("MULTIPOLYGON", False, 8, True),
    "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,2 2))": ("GEOMETRYCOLLECTION", False, 3, True),
    "POLYGON EMPTY": ("POLYGON", True, 0, True),
}


def test_parse():
    for text, (kind, empty, n, valid) in TEXTS.items():
        g = shapes.from_wkt(text)
        assert (g.kind, g.empty, len(g.vertices), shapes.valid(g)) == (kind, empty, n, valid), text
        again = shapes.from_ewkb(shapes.to_ewkb(g))
        assert (again.srid, shapes.to_wkt(again)) == (g.srid, shapes.to_wkt(g))
    assert shapes.from_wkt("SRID=4326;POINT(1 2)").srid == 4326
    for bad in ("CIRCLE(1 2)", "POINT(1 2", "", "12"):
        with pytest.raises(ValueError):
            shapes.from_wkt(bad)


def test_in_ring_against_plain(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]
    points = [(x, y) for x in range(-1, 12) for y in range(-1, 12)]

    def plain(x, y):
        inside = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return 0
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
        return 1 if inside else -1

    got = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double").select("x", "y", geo.in_ring(F.col("x"), F.col("y"), ring).alias("p"))
    assert values(got) == sorted((float(x), float(y), plain(x, y)) for x, y in points)


def test_srid_mismatch(spark):
    """Raised by every predicate and distance; NULL stays NULL."""
    a, b = shapes.geometry("SRID=4326;POINT(1 2)"), shapes.geometry("SRID=3857;POINT(1 2)")
    for f in (shapes.st_relate(a, b), shapes.st_distance(a, b), shapes.st_dwithin(a, b, 1.0), shapes.st_relation("touches", a, b)):
        with pytest.raises(Exception, match="mixed SRIDs"):
            spark.range(1).select(f.alias("v")).collect()
    null = F.lit(None).cast("binary")
    got = spark.range(1).select(shapes.st_relate(a, null).alias("r"), shapes.st_distance(null, b).alias("d")).collect()[0]
    assert set(got.r) == {None} and got.d is None


def relations(a, b):
    return {k for k, v in shapes.relate(shapes.from_wkt(a), shapes.from_wkt(b)).items() if v}


SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1))"
LYING = [
    (SQUARE, "POLYGON((2 2,6 2,6 6,2 6,2 2))", {"overlaps"}),
    (SQUARE, "POLYGON((4 0,8 0,8 4,4 4,4 0))", {"touches"}),
    (SQUARE, "POLYGON((4 4,8 4,8 8,4 8,4 4))", {"touches"}),
    (SQUARE, "POLYGON((1 1,2 1,2 2,1 2,1 1))", {"contains"}),
    (SQUARE, "POLYGON((0 0,0 4,4 4,4 0,0 0))", {"contains", "within", "equals"}),
    (SQUARE, "POLYGON((0 0,2 0,2 4,0 4,0 0))", {"contains"}),
    (HOLED, "POLYGON((1 1,3 1,3 3,1 3,1 1))", {"touches"}),
    (HOLED, "POINT(2 2)", None),
    ("LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)", {"crosses"}),
    ("LINESTRING(0 0,4 4)", "LINESTRING(2 2,6 6)", {"overlaps"}),
    ("LINESTRING(0 0,4 4)", "LINESTRING(4 4,6 0)", {"touches"}),
    ("LINESTRING(0 0,4 4)", "LINESTRING(2 2,6 0)", {"touches"}),
    ("LINESTRING(0 0,4 0,4 4)", "LINESTRING(4 4,4 0,0 0)", {"contains", "within", "equals"}),
    ("LINESTRING(-1 2,5 2)", SQUARE, {"crosses"}),
    ("LINESTRING(1 2,3 2)", SQUARE, {"within"}),
    ("LINESTRING(0 0,4 0)", SQUARE, {"touches"}),
    ("POINT(0 0)", SQUARE, {"touches"}),
    ("POINT(1 1)", SQUARE, {"within"}),
    ("MULTIPOINT(1 1,9 9)", SQUARE, {"crosses"}),
    ("MULTIPOINT(1 1,9 9)", "MULTIPOINT((1 1),(2 2))", {"overlaps"}),
    ("POINT(2 0)", "LINESTRING(0 0,4 0)", {"within"}),
    ("POINT(4 0)", "LINESTRING(0 0,4 0)", {"touches"}),
    ("POINT EMPTY", "POINT(1 1)", None),
    ("GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(5 5,6 6))", SQUARE, set()),
]


@pytest.mark.parametrize(("a", "b", "want"), LYING)
def test_relations(a, b, want):
    turned = {"contains": "within", "within": "contains"}
    assert relations(a, b) == ({"disjoint"} if want is None else want | {"intersects"})
    assert relations(b, a) == ({"disjoint"} if want is None else {turned.get(x, x) for x in want} | {"intersects"})


DEGENERATE = ["POINT EMPTY", "POINT(1 1)", "LINESTRING EMPTY", "LINESTRING(1 1,1 1)", "LINESTRING(0 0,0 0,2 2)", "POLYGON EMPTY", "POLYGON((1 1,1 1,1 1,1 1))", "POLYGON((0 0,2 2,0 0,0 0))", "POLYGON((0 0,4 4,4 0,0 4,0 0))", "MULTIPOINT EMPTY", "MULTIPOLYGON EMPTY", "GEOMETRYCOLLECTION EMPTY", "MULTIPOINT((0 0),(0 0))", "LINESTRING(0 0,2 2,0 0)", "POLYGON((0 0,1 0,1 1,0 1,0 0),(0 0,1 0,1 1,0 1,0 0))"]


def test_degenerate_shapes():
    """None of them crashes, and intersects and disjoint are opposites."""
    for a in [*DEGENERATE, SQUARE]:
        for b in [*DEGENERATE, SQUARE, "LINESTRING(0 0,4 4)"]:
            g, h = shapes.from_wkt(a), shapes.from_wkt(b)
            r = shapes.relate(g, h)
            assert r["intersects"] != r["disjoint"], (a, b)
            d = shapes.distance(g, h)
            assert (d is None) == (g.empty or h.empty)
            if d is not None and not r["intersects"]:
                assert d >= 0
            shapes.area(g), shapes.length(g), shapes.centroid(g), shapes.valid(g)


def test_relations_of_boxes_against_plain():
    """Random rectangles: how they lie follows from their sides."""
    r = random.Random(4)
    box = lambda: (x := r.randrange(6), y := r.randrange(6), x + 1 + r.randrange(4), y + 1 + r.randrange(4))
    text = lambda x, y, z, w: f"POLYGON(({x} {y},{z} {y},{z} {w},{x} {w},{x} {y}))"
    for _ in range(400):
        a, b = box(), box()
        meet = a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
        inner = a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
        ab, ba = a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3], b[0] >= a[0] and b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3]
        want = {"intersects": meet, "disjoint": not meet, "contains": ba, "within": ab, "equals": ab and ba, "touches": meet and not inner, "crosses": False, "overlaps": inner and not ab and not ba}
        assert shapes.relate(shapes.from_wkt(text(*a)), shapes.from_wkt(text(*b))) == want, (a, b)


def test_cells(spark):
    cell = 0x8928308280FFFFF  # a published cell of resolution 9
    one = spark.createDataFrame([(cell,)], "c long")
    c = F.col("c")
    got = one.select(h3.resolution(c), h3.base_cell(c), h3.is_valid(c), h3.is_pentagon(c), h3.parent(c, 5), h3.center_child(c, 10), h3.child_count(c, 11), F.size(h3.children(c, 11))).collect()[0]
    assert tuple(got) == (9, 20, True, False, 0x85283083FFFFFFF, 0x8A28308280C7FFF, 49, 49)
    assert one.select(h3.parent(F.col("c").cast("long"), 9)).collect()[0][0] == cell
    with pytest.raises(Exception, match="no ancestor"):
        one.select(h3.parent(c, 12)).collect()
    kids = one.select(F.explode(h3.children(c, 11)).alias("k"))
    assert kids.where(h3.is_valid(F.col("k")) & (h3.parent(F.col("k"), 9) == cell)).distinct().count() == 49


def test_validity_of_cells(spark):
    """Bits set at once are tested like digits one by one."""
    r = random.Random(8)

    def plain(c):
        res, base = c >> 52 & 15, c >> 45 & 127
        digits = [c >> (45 - 3 * n) & 7 for n in range(1, 16)]
        return c > 0 and c >> 59 & 15 == 1 and c >> 56 & 7 == 0 and base < 122 and all(d < 7 for d in digits[:res]) and all(d == 7 for d in digits[res:])

    cells = []
    for _ in range(400):
        res = r.randrange(16)
        c = 1 << 59 | res << 52 | r.randrange(128) << 45
        for n in range(1, 16):
            c |= (r.randrange(7) if n <= res else 7) << (45 - 3 * n)
        cells += [c, c ^ 1 << r.randrange(63)]
    got = spark.createDataFrame([(c,) for c in cells], "c long").select("c", h3.is_valid(F.col("c"))).collect()
    assert [x[1] for x in got] == [plain(x[0]) for x in got]
    assert spark.range(1).select(h3.is_valid(F.lit(None).cast("long"))).collect()[0][0] is None


def test_cells_and_places():
    """Every cell's center lies in it; neighbours are mutual; steps in the plane are those counted ring by ring; no cell is missing."""
    import numpy as np

    from lodestar.functions import h3grid

    rng = np.random.default_rng(1)
    points = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, 3)))
    for res in (0, 1, 2, 4, 7, 11, 15):
        cells = h3grid.cells_at(points(800), res)
        assert (h3grid.cells_at(h3grid.centers(cells), res) == cells).all()
    cells = np.unique(h3grid.cells_at(points(40_000), 1))
    assert len(cells) == 2 + 120 * 7 and h3grid.pentagons(cells).sum() == 12
    beside = dict(zip(cells.tolist(), h3grid.neighbours(cells), strict=True))
    assert all(len(v) == (5 if p else 6) for v, p in zip(beside.values(), h3grid.pentagons(cells), strict=True))
    assert all(a in beside[b] for a in beside for b in beside[a])
    for c in cells[::60].tolist():
        near = h3grid.disk(c, 4)
        got = h3grid.distances(np.full(len(near), c), np.array(list(near)))
        assert all(g is None or g == n for g, n in zip(got, near.values(), strict=True))
    ring = [(10.0, 10.0), (10.0, 30.0), (25.0, 20.0)]
    every = np.unique(h3grid.cells_at(points(120_000), 2))
    lat, lng = h3grid.degrees(h3grid.centers(every))
    inside = (lat > 10) & (lat < 10 + 1.5 * (lng - 10)) & (lat < 10 + 1.5 * (30 - lng))
    assert len(every) == 2 + 120 * 49 and h3grid.polygon_cells(ring, 2).tolist() == sorted(every[inside].tolist())
    with pytest.raises(ValueError):
        h3grid.centers(np.array([(1 << 59) | (1 << 52) | (4 << 45) | (1 << 42) | ((1 << 42) - 1)]))  # a digit that pentagons lack


def test_rules():
    assert raster.parse_rules("1:2,3:4") == {1: 2, 3: 4}
    for bad in ("1:2,1:3", "1", "", ",".join(f"{i}:1" for i in range(65))):
        with pytest.raises(ValueError):
            raster.parse_rules(bad)
    with pytest.raises(ValueError):
        raster.reclass(F.lit(None), "1:256", "8BUI")


def test_summary_and_value(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],), (None,)], "a array<int>")
    got = [r[0] for r in df.select(raster.summary(F.col("a"), nodata=4)).collect()]
    assert (got[0]["count"], got[0]["sum"], got[0]["mean"]) == (3, 6.0, 2.0) and got[1]["count"] == 0 and got[2] is None
    assert [r[0] for r in df.select(raster.value(F.col("a"), 2, F.lit(1), F.lit(2))).collect()] == [3, None, None]
