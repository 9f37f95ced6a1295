"""Joins of every kind, with nulls, duplicates and empty sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.joins import null_aware_anti, range_join, salted_join
from lodestar.operators.windows import with_global_rank
from lodestar.plans.registry import query, sql
from lodestar.sources.tables import load

sql("join_inner", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 4000")
sql("join_count", "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000")
sql("join_left_unmatched", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 450000")
sql(
    "join_full",
    """WITH a AS (SELECT c_custkey AS ka, c_nationkey AS x FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS kb, c_mktsegment AS y FROM customer WHERE c_custkey % 3 = 0)
    SELECT ka, kb, x, y FROM a FULL OUTER JOIN b ON ka = kb""",
)
sql("join_cross", "SELECT r_name, n_name, r_regionkey = n_regionkey AS own FROM region CROSS JOIN nation")
sql("join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_chain", "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_text_key", "WITH d AS (SELECT DISTINCT c_mktsegment AS s, LENGTH(c_mktsegment) AS n FROM customer) SELECT c_mktsegment, CAST(n AS BIGINT) AS n, COUNT(*) AS customers FROM customer JOIN d ON c_mktsegment = s GROUP BY c_mktsegment, n")
sql(
    "join_nan_key",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(c_nationkey AS DOUBLE) END AS x FROM customer),
    b AS (SELECT DISTINCT CASE WHEN s_nationkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(s_nationkey AS DOUBLE) END AS y FROM supplier) SELECT c_custkey FROM a JOIN b ON x = y""",
)
sql("join_empty_side", "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS matched FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice < 0) e ON c_custkey = e.o_custkey")
sql(
    "join_merge_null_keys",
    """WITH l AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey AS v FROM orders), r AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey AS w FROM customer)
    SELECT COUNT(*) AS n, MIN(v) AS lo, MAX(w) AS hi FROM l JOIN r ON l.k = r.k""",
)
sql("join_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("join_in_having", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14)")
sql("join_lateral_series", "SELECT n_nationkey, s FROM nation, LATERAL (SELECT EXPLODE(SEQUENCE(0, n_regionkey)) AS s) t", "SELECT n_nationkey, s FROM nation, LATERAL (SELECT UNNEST(range(0, n_regionkey + 1)) AS s) t")
sql(
    "join_lateral",
    "SELECT c_custkey, o.n, o.total FROM customer, LATERAL (SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') o",
)
sql("join_hash_filter", "SELECT p_type, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25 GROUP BY p_type")


@query("join_not_in_null", "WITH l AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM l)")
def join_not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with nulls: nothing."""
    keys = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"))
    return null_aware_anti(load(spark, sf_dir, "customer", "c_custkey"), keys, "c_custkey", "k")


@query("join_not_in", "SELECT c_custkey FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey END AS c_custkey FROM customer) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without nulls: rows with a null key don't pass."""
    customers = load(spark, sf_dir, "customer", "c_custkey").select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")).alias("c_custkey"))
    keys = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000").select("o_custkey")
    return null_aware_anti(customers, keys, "c_custkey", "o_custkey")


@query("join_many_to_many", "SELECT c_nationkey, COUNT(*) AS n, COUNT(DISTINCT s_suppkey) AS suppliers FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_nationkey")
def join_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted on each side before the join: a nation has as many pairs as customers times suppliers."""
    suppliers = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    left = load(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    each = suppliers.groupBy("s_nationkey", "s_suppkey").agg(F.count(F.lit(1)).alias("rows"))
    right = each.groupBy("s_nationkey").agg(F.sum("rows").alias("rows"), F.count("s_suppkey").alias("suppliers"))
    return left.join(right, F.col("c_nationkey") == F.col("s_nationkey")).select("c_nationkey", (F.col("customers") * F.col("rows")).alias("n"), "suppliers")


@query("join_inequality", "SELECT a.c_custkey AS a, COUNT(*) AS n FROM customer a JOIN customer b ON a.c_custkey > b.c_custkey AND a.c_nationkey <> b.c_nationkey GROUP BY a.c_custkey")
def join_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from row numbers: of the smaller keys all less those of the same nation, so that no pair is made."""
    ranked = with_global_rank(load(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), ["c_custkey"], "all")
    own = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return ranked.withColumn("own", own).select(F.col("c_custkey").alias("a"), (F.col("all") - F.col("own")).cast("long").alias("n")).where("n > 0")


sql("join_inequality_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey AND a.n_regionkey <> b.n_regionkey")

WINDOWS = "WITH w AS (SELECT l_orderkey * 7 + l_linenumber AS w_id, l_partkey * 1000.0 AS lo, l_partkey * 1000.0 + l_quantity * 20 AS hi FROM lineitem WHERE l_linenumber = 1)"


@query("join_range_between", f"{WINDOWS} SELECT event_id, w_id FROM events JOIN w ON epoch_us(ts) % 2000000000 / 1000.0 >= lo AND epoch_us(ts) % 2000000000 / 1000.0 <= hi")
def join_range_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of up to 1,000 milliseconds, by buckets."""
    events = load(spark, sf_dir, "events", "event_id", "ts").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) % 2_000_000_000 / 1000.0).alias("t"))
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_linenumber = 1")
    windows = items.select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("w_id"), (F.col("l_partkey") * 1000.0).alias("lo"), (F.col("l_partkey") * 1000.0 + F.col("l_quantity") * 20).alias("hi"))
    return range_join(events, windows, "t", "lo", "hi", 1000, widest=1000).select("event_id", "w_id")


@query("join_salted", "SELECT event_type, COUNT(*) AS n, SUM(CAST(LENGTH(event_type) AS BIGINT)) AS letters FROM events GROUP BY event_type")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a key with few values, split by salts."""
    events = load(spark, sf_dir, "events", "event_id", "event_type")
    kinds = events.select("event_type").distinct().withColumn("letters", F.length("event_type").cast("long"))
    return salted_join(events, kinds, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters"))
