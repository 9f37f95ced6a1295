"""Queries over tables that are written, changed, pinned or streamed, and statements with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.registry import register
from lodestar.plans.registry import query
from lodestar.sources.lineage import work_folder
from lodestar.sources.tables import Pins, Prepared, delete_where, insert_select, load, spread, update_where, write_table
from lodestar.streaming.rollup import rollup, write_rollup


@query("table_insert_select", "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0) t WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def table_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table made from a query, more rows inserted, and read with a filter on its folders."""
    orders, path = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), work_folder(spark)
    write_table(orders.where("o_orderkey % 2 = 0"), path, partition_by=["o_orderstatus"])
    write_table(orders.where("o_orderkey % 5 = 0"), path, mode="append", partition_by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("table_update_delete", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING') UNION ALL SELECT -1, 0.5, 1")
def table_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    write_table(load(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), path)
    delete_where(spark, path, F.col("c_mktsegment") == "BUILDING")
    update_where(spark, path, {"c_acctbal": F.col("c_acctbal") * 2, "c_nationkey": F.col("c_nationkey") + 100}, F.col("c_nationkey") == 3)
    insert_select(spark.sql("SELECT 'x' AS c_mktsegment, CAST(1 AS BIGINT) AS c_nationkey, CAST(0.5 AS DOUBLE) AS c_acctbal, CAST(-1 AS BIGINT) AS c_custkey"), path)
    return spark.read.parquet(path).drop("c_mktsegment")


@query("prepared_statement", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey BETWEEN 100 AND 900 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey BETWEEN 5 AND 40")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement run with two sets of values."""
    find = Prepared("SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderpriority = :priority AND o_orderkey BETWEEN :low AND :high", {"orders": load(spark, sf_dir, "orders")})
    return find(priority="1-URGENT", low=100, high=900).unionAll(find(priority="2-HIGH", low=5, high=40))


@query("pinned_columns", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
def pinned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped sum over pinned columns, one of which is loaded when it is first asked for."""
    pins, path = Pins(spark), f"{sf_dir}/lineitem.parquet"
    pins.pin("lineitem", path, ["l_returnflag"])
    return pins.table("lineitem", path, ["l_returnflag", "l_partkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("s"))


@query("functions_by_name", "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS area, 'POLYGON' AS kind, p_size >= 20 AS touches FROM part")
def functions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions in SQL."""
    register(spark)
    text = "'POLYGON((0 0,' || n || ' 0,' || n || ' ' || n || ',0 ' || n || ',0 0))'"
    return spark.sql(f"SELECT p_partkey, st_area(g) AS area, st_geometrytype(g) AS kind, st_intersects(g, st_geomfromtext('POINT(20 20)')) AS touches FROM (SELECT p_partkey, st_geomfromtext({text}) AS g FROM (SELECT p_partkey, CAST(p_size AS STRING) AS n FROM {{part}}) a) b", part=spread(load(spark, sf_dir, "part", "p_partkey", "p_size")))


@query("stream_rollup", "SELECT user_id, CAST(SUM(n) AS BIGINT) AS n, MIN(lo) AS lo, MAX(hi) AS hi FROM (SELECT user_id, DATE_TRUNC('day', ts) AS d, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, DATE_TRUNC('day', ts)) g WHERE d < (SELECT DATE_TRUNC('day', MAX(ts) - INTERVAL 10 MINUTE) FROM events) GROUP BY user_id")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream: windows of a day that the watermark has closed."""
    schema = load(spark, sf_dir, "events", "user_id", "ts", "value").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = work_folder(spark)
    write_rollup(rollup(stream, "ts", "user_id", "value", "1 day"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("user_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
