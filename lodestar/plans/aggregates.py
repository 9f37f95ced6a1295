"""Aggregation: every function, key kind and modifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.aggregates import average_seconds, distinct_on, distinct_sets, filtered, ordered_array, percentiles_disc, rollup_sets
from lodestar.plans.registry import query, sql
from lodestar.sources.tables import load

sql("agg_grouped_int", "SELECT l_linenumber, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi FROM lineitem GROUP BY l_linenumber")
sql("agg_ungrouped_int", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part")
sql("agg_empty_input", "SELECT COUNT(*) AS n, COUNT(p_size) AS c, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part WHERE p_size > 1000")
sql(
    "agg_count_bool",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice > 200000 END AS v FROM orders)
    SELECT k, COUNT(*) AS n, COUNT(v) AS c FROM t GROUP BY k""",
)
sql("agg_high_cardinality", "SELECT COUNT(*) AS users, CAST(SUM(n) AS BIGINT) AS events FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) g")
sql("agg_high_cardinality_groups", "SELECT l_partkey, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_partkey")
sql("agg_filtered_grouped", "SELECT c_nationkey, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS s FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 GROUP BY c_nationkey")
sql("agg_dictionary_key", "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(c_nationkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment")
sql("agg_three_keys", "SELECT o_orderstatus, o_orderpriority, CAST(o_custkey % 4 AS BIGINT) AS part, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, CAST(o_custkey % 4 AS BIGINT)")
sql("agg_null_key", "WITH t AS (SELECT CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS k, c_custkey FROM customer) SELECT k, COUNT(*) AS n, COUNT(k) AS c, MAX(c_custkey) AS hi FROM t GROUP BY k")
sql(
    "agg_float_key",
    """WITH t AS (SELECT CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN -0.0 WHEN l_linenumber = 3 THEN 0.0 WHEN l_linenumber = 4 THEN CAST('NaN' AS DOUBLE) * -1 ELSE l_linenumber / 2.0 END AS k, l_partkey FROM lineitem),
    g AS (SELECT k, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM t GROUP BY k) SELECT CASE WHEN ISNAN(k) THEN 'nan' WHEN k = 0 THEN 'zero' ELSE 'other' END AS kind, CASE WHEN ISNAN(k) OR k = 0 THEN NULL ELSE k END AS k, n, s FROM g""",
)
sql("agg_expression_key", "SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(MONTH(o_orderdate) AS BIGINT) AS m, LOWER(o_orderstatus) AS s, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate), LOWER(o_orderstatus)")
sql("agg_abs_key", "SELECT CAST(ABS(p_size - 25) AS BIGINT) AS k, COUNT(*) AS n FROM part GROUP BY ABS(p_size - 25)")
sql("agg_int_product", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_linenumber AS BIGINT) * l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_int_difference", "SELECT l_linestatus, CAST(SUM(l_partkey - l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_linestatus")
sql("agg_product_in_range", "SELECT p_size, COUNT(*) AS n, CAST(SUM(p_size * p_partkey) AS BIGINT) AS s FROM part WHERE p_partkey >= 100 AND p_partkey <= 1500 GROUP BY p_size")

CASES = {
    "plain": "l_returnflag = 'R'",
    "and": "l_returnflag = 'R' AND l_quantity > 20",
    "in": "l_linenumber IN (1, 3, 5)",
    "not_in": "l_linenumber NOT IN (1, 3, 5)",
    "not_null": "NULLIF(l_linestatus, 'O') IS NOT NULL",
    "or": "l_returnflag = 'A' OR l_discount > 0.05",
    "between": "l_quantity BETWEEN 10 AND 20",
    "at_least": "l_quantity >= 30",
}
for _name, _when in CASES.items():
    sql(f"agg_case_{_name}", f"SELECT l_suppkey, COUNT(*) AS n, ROUND(SUM(CASE WHEN {_when} THEN l_extendedprice * l_discount ELSE 0 END), 4) AS s FROM lineitem GROUP BY l_suppkey")

sql("agg_filter_clause", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS n, ROUND(SUM(l_extendedprice) FILTER (WHERE l_discount = 0.1), 2) AS s, MIN(l_partkey) FILTER (WHERE l_linenumber = 99) AS none FROM lineitem GROUP BY l_returnflag")
sql("agg_reductions", "SELECT ROUND(SUM(l_extendedprice), 2) AS s, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(l_extendedprice) AS n FROM lineitem")
sql("agg_reductions_masked", "WITH t AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem WHERE l_returnflag = 'N') SELECT CAST(SUM(v) AS BIGINT) AS s, MIN(v) AS lo, MAX(v) AS hi, COUNT(v) AS n, COUNT(*) AS total FROM t")
sql("agg_mask_count", "SELECT COUNT_IF(l_quantity > 25 AND l_tax < 0.05) AS n FROM lineitem")
sql("agg_statistics", "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS a, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, CAST(SUM(l_quantity * l_quantity) AS BIGINT) AS sq FROM lineitem GROUP BY l_returnflag")
sql("agg_two_columns", "SELECT l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS a, COUNT(l_quantity) AS na, CAST(SUM(l_partkey) AS BIGINT) AS b, COUNT(l_partkey) AS nb FROM lineitem GROUP BY l_linestatus")
sql("agg_stddev_single", "SELECT n_nationkey, STDDEV_SAMP(n_regionkey) AS sd, VAR_POP(CAST(n_regionkey AS DOUBLE)) AS vp FROM nation GROUP BY n_nationkey")
sql("agg_bool", "SELECT p_brand, BOOL_AND(p_size > 1) AS every_one, BOOL_OR(p_size > 49) AS some, BOOL_AND(CASE WHEN p_size > 1000 THEN TRUE END) AS none FROM part GROUP BY p_brand")
sql("agg_bits", "SELECT c_nationkey, BIT_AND(c_custkey) AS a, BIT_OR(c_custkey) AS o, BIT_XOR(c_custkey) AS x FROM customer GROUP BY c_nationkey")
sql("agg_bits_empty", "SELECT BIT_AND(c_custkey) AS a, BIT_OR(c_custkey) AS o, BIT_XOR(c_custkey) AS x, BOOL_AND(c_custkey > 0) AS b FROM customer WHERE c_custkey < 0")
sql("agg_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority")
sql("agg_sum_distinct", "SELECT l_returnflag, CAST(SUM(DISTINCT l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_average_integers", "SELECT l_linenumber, ROUND(AVG(l_partkey), 6) AS a, ROUND(AVG(CAST(l_suppkey AS SMALLINT)), 6) AS b, ROUND(AVG(CAST(l_linenumber AS INT)), 6) AS c FROM lineitem GROUP BY l_linenumber")
sql("agg_decimal", "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15, 2))) AS VARCHAR(60)) AS s, ROUND(CAST(AVG(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DOUBLE), 3) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 10 AND SUM(o_totalprice) > 2000000")
sql("agg_having_without_keys", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 5")
sql("distinct_column", "SELECT DISTINCT l_suppkey FROM lineitem")
sql("distinct_columns", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity > 10")
sql("distinct_expression", "SELECT DISTINCT CAST(o_custkey % 10 AS BIGINT) AS k, UPPER(o_orderstatus) AS s FROM orders")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS lo FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql(
    "agg_group_by_distinct",
    f"SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY {distinct_sets(rollup_sets('o_orderstatus', 'o_orderpriority'), rollup_sets('o_orderstatus'))}",
    "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
)
sql("agg_string", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_sensor_rollup", "SELECT user_id, DATE_FORMAT(ts, 'yyyy-MM-dd HH:00') AS hour, COUNT(*) AS n, ROUND(AVG(value), 6) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, DATE_FORMAT(ts, 'yyyy-MM-dd HH:00')", "SELECT user_id, STRFTIME(ts, '%Y-%m-%d %H:00') AS hour, COUNT(*) AS n, ROUND(AVG(value), 6) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, STRFTIME(ts, '%Y-%m-%d %H:00')")


@query("agg_ordered_array", "SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice, o_orderkey), ',') AS orders, COALESCE(array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F'), ','), '') AS done FROM orders GROUP BY o_custkey")
def agg_ordered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").withColumn("k", F.col("o_orderkey").cast("string"))
    joined = lambda c: F.array_join(c, ",")
    return orders.groupBy("o_custkey").agg(joined(ordered_array("k", "o_totalprice", "o_orderkey")).alias("orders"), joined(ordered_array("k", "o_totalprice", "o_orderkey", where=F.col("o_orderstatus") == "F")).alias("done"))


@query("agg_average_interval", "SELECT l_returnflag, ROUND(AVG(epoch(l_shipdate) - epoch(o_orderdate)), 3) AS seconds, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def agg_average_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVG of intervals."""
    items, orders = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate"), load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    made = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag").agg(average_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"), F.count(F.lit(1)).alias("n"))
    return made.select("l_returnflag", F.round("seconds", 3).alias("seconds"), "n")


@query("agg_percentile_disc", "SELECT l_returnflag, array_to_string(list_transform(quantile_disc(l_partkey, [0.25, 0.5, 0.99]), lambda x: CAST(x AS VARCHAR)), ',') AS q FROM lineitem GROUP BY l_returnflag")
def agg_percentile_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.array_join(percentiles_disc("l_partkey", [0.25, 0.5, 0.99], "bigint"), ",").alias("q"))


@query("agg_filter_functions", "SELECT event_type, COUNT(*) FILTER (value > 20) AS n, ROUND(SUM(value) FILTER (user_id < 50), 2) AS s FROM events GROUP BY event_type")
def agg_filter_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "event_type", "value", "user_id")
    return events.groupBy("event_type").agg(filtered(F.count, F.col("value") > 20).alias("n"), F.round(filtered(F.sum, F.col("user_id") < 50, F.col("value")), 2).alias("s"))


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer."""
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return distinct_on(orders, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])
