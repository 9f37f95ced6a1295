"""Window functions, sorting and top-k, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.recursion import recursive_union
from lodestar.operators.windows import ntile, with_global_rank
from lodestar.plans.registry import query, sql
from lodestar.sources.tables import generate_series, load

BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"

sql("window_row_number", f"SELECT event_id, CAST(ROW_NUMBER() OVER ({BY_USER}) AS BIGINT) AS rn FROM events")
sql("window_rank", "SELECT l_orderkey, l_linenumber, CAST(RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS d FROM lineitem")
sql("window_running_default", "SELECT l_orderkey, l_linenumber, CAST(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS s FROM lineitem")
sql("window_running_rows", f"SELECT event_id, ROUND(SUM(value) OVER w, 2) AS s, COUNT(*) OVER w AS n, ROUND(AVG(value) OVER w, 8) AS a FROM events WINDOW w AS ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
sql("window_moving_sum", f"SELECT event_id, ROUND(SUM(value) OVER ({BY_USER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS s FROM events")
sql("window_lag_lead", f"SELECT event_id, LAG(value, 1, -1.0) OVER ({BY_USER}) AS before, LEAD(value, 2) OVER ({BY_USER}) AS after, LAG(value, 1000000, -999.0) OVER ({BY_USER}) AS far FROM events")
sql("window_named", f"SELECT event_id, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, LAG(event_type) OVER w AS before FROM events WINDOW w AS ({BY_USER})")
sql("window_null_order", "WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY p DESC NULLS LAST, o_orderkey) AS BIGINT) AS rn FROM t")
sql("window_first_last", f"SELECT event_id, FIRST_VALUE(event_type) OVER ({BY_USER}) AS first_type, LAST_VALUE(event_type) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type FROM events")
sql("window_over_aggregate", "SELECT o_custkey, n, CAST(RANK() OVER (PARTITION BY part ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT o_custkey, o_custkey % 8 AS part, COUNT(*) AS n FROM orders GROUP BY o_custkey) g")
sql("window_top_per_group", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) t WHERE rn <= 3")


@query("window_global_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders")
def window_global_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_global_rank(load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "rn").select("o_orderkey", "rn")


@query("window_global_row_number_wide", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) AS rn FROM orders")
def window_global_row_number_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With columns besides the keys, by ranges."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return with_global_rank(orders, ["o_orderstatus", "o_totalprice", "o_orderkey"], "rn", alone=0)


@query("window_global_nulls", "SELECT o_orderkey, k, ROW_NUMBER() OVER (ORDER BY k NULLS FIRST, o_orderkey) AS rn FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS k FROM orders) t")
def window_global_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and few different values in the first key, by ranges."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 5).alias("k"))
    return with_global_rank(orders, ["k", "o_orderkey"], "rn", alone=0)


@query("window_ntile_buckets", "SELECT b, COUNT(*) AS n, MIN(p) AS lo, MAX(p) AS hi FROM (SELECT CAST(NTILE(100) OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS b, o_totalprice AS p FROM orders) t GROUP BY b")
def window_ntile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ntile(100) from global row numbers."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    ranked = with_global_rank(orders, ["o_totalprice", "o_orderkey"], "rn")
    return ranked.groupBy(ntile(ranked, "rn", 100, orders.count()).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


sql("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 1000")
sql("sort_multi_key", "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS k1, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS k2 FROM orders) SELECT o_orderkey, k1, k2 FROM t ORDER BY k1 ASC NULLS LAST, k2 DESC NULLS FIRST, o_orderkey ASC LIMIT 500")
sql("sort_wide_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
sql("sort_limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
sql("sort_limit_beyond", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1000")
sql("sort_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 30")
sql("sort_expression", "SELECT p_partkey, p_size FROM part ORDER BY ABS(p_size - 25), SQRT(p_retailprice), LOWER(p_name), p_partkey LIMIT 200")
sql("sort_by_aggregate", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 50")

KEYS = "WITH l AS (SELECT CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 40 END AS BIGINT) AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT CAST(CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 50 END AS BIGINT) AS k FROM customer)"
for _op in ("INTERSECT ALL", "INTERSECT", "EXCEPT", "EXCEPT ALL", "UNION ALL", "UNION"):
    sql(f"set_{_op.lower().replace(' ', '_')}", f"{KEYS} SELECT k FROM l {_op} SELECT k FROM r")


@query("recursive_union_all", "WITH RECURSIVE s(n, top) AS (SELECT n_nationkey AS n, n_nationkey + 5 AS top FROM nation UNION ALL SELECT n + 1, top FROM s WHERE n < top) SELECT CAST(n AS BIGINT) AS n, COUNT(*) AS times FROM s GROUP BY n")
def recursive_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "WITH RECURSIVE s(n, top) AS (SELECT n_nationkey AS n, n_nationkey + 5 AS top FROM {nation} UNION ALL SELECT n + 1, top FROM s WHERE n < top) SELECT CAST(n AS BIGINT) AS n, COUNT(*) AS times FROM s GROUP BY n"
    return spark.sql(text, nation=load(spark, sf_dir, "nation"))


@query("recursive_union", "WITH RECURSIVE s(n) AS (SELECT n_regionkey AS n FROM nation UNION SELECT n + 1 FROM s WHERE n < 12) SELECT CAST(n AS BIGINT) AS n FROM s")
def recursive_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and rounds without duplicates."""
    seed = load(spark, sf_dir, "nation", "n_regionkey").select(F.col("n_regionkey").cast("long").alias("n"))
    return recursive_union(seed, lambda s: s.where("n < 12").select(F.col("n") + 1))


@query("recursive_union_cycle", "WITH RECURSIVE s(n) AS (SELECT s_suppkey % 90 AS n FROM supplier WHERE s_suppkey <= 3 UNION SELECT e.t FROM s JOIN (SELECT c_custkey % 90 AS f, (c_custkey * 7 + 3) % 30 * 3 AS t FROM customer) e ON e.f = s.n) SELECT CAST(n AS BIGINT) AS n FROM s")
def recursive_union_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be reached along edges that form cycles; the recursion ends when nothing is new."""
    c = F.col("c_custkey")
    edges = load(spark, sf_dir, "customer", "c_custkey").select((c % 90).cast("long").alias("f"), ((c * 7 + 3) % 30 * 3).cast("long").alias("t")).distinct()
    seed = load(spark, sf_dir, "supplier", "s_suppkey").where("s_suppkey <= 3").select((F.col("s_suppkey") % 90).cast("long").alias("n"))
    return recursive_union(seed, lambda s: s.join(edges, F.col("n") == F.col("f")).select("t"))


@query("generate_series", "SELECT generate_series AS n FROM generate_series(5, 500, 7)")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_series(spark, 5, 500, 7, "n")


sql("subquery_cte_chain", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey, AVG(s) AS m FROM a JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) SELECT n_name, ROUND(m, 5) AS m FROM b JOIN nation ON c_nationkey = n_nationkey")
sql("subquery_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subquery_nested", "SELECT k, COUNT(*) AS n FROM (SELECT k FROM (SELECT k, v FROM (SELECT o_custkey % 10 AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O') a WHERE v > 1000) b WHERE v < 400000) c GROUP BY k")
sql("subquery_in_select", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer")
sql("subquery_union_spans", "SELECT 'c' AS t, COUNT(*) AS n FROM customer UNION ALL SELECT 's' AS t, COUNT(*) AS n FROM supplier UNION ALL SELECT 'p' AS t, COUNT(*) AS n FROM part")
