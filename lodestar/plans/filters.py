"""Scans, filters and projections."""

from __future__ import annotations

from lodestar.plans.registry import sql

ITEM = "l_orderkey, l_linenumber, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents"

sql("filter_range", f"SELECT {ITEM} FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12")
sql("filter_between", f"SELECT {ITEM} FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 21000")
sql("filter_reversed_operand", f"SELECT {ITEM} FROM lineitem WHERE 48 < l_quantity AND 0.05 >= l_discount")
sql("filter_empty_range", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_quantity < 20")
sql("filter_in_list", f"SELECT {ITEM} FROM lineitem WHERE l_linenumber IN (1, 7) AND l_returnflag IN ('R', 'N')")
sql("filter_not_in_list", f"SELECT {ITEM} FROM lineitem WHERE l_linenumber NOT IN (2, 3, 4, 5)")
sql("filter_or_chain", f"SELECT {ITEM} FROM lineitem WHERE l_quantity < 3 OR l_quantity BETWEEN 24 AND 25 OR l_discount = 0.1 OR l_linenumber = 7")
sql("filter_not", f"SELECT {ITEM} FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity > 5)")
sql("filter_not_equal", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'red%' OR p_brand LIKE 'Brand#_'")
sql("filter_case", f"SELECT {ITEM} FROM lineitem WHERE CASE WHEN l_returnflag = 'A' THEN l_quantity > 40 WHEN l_returnflag = 'R' THEN l_quantity < 5 ELSE FALSE END")
sql("filter_bool_mask", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 5000 END AS active FROM customer) SELECT c_custkey FROM c WHERE active")
sql("filter_mask_and_ranges", "WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_custkey % 3 = 0 AS active FROM customer) SELECT c_custkey, c_nationkey FROM c WHERE active AND (c_nationkey BETWEEN 1 AND 3 OR c_nationkey BETWEEN 8 AND 9 OR c_nationkey = 20) AND c_acctbal > 0")
sql("filter_columns_compared", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate AND l_tax > l_discount")
sql(
    "filter_null_logic",
    """WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS v, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS w FROM lineitem)
    SELECT k, n FROM t WHERE (v IS NULL AND w IS NOT NULL) OR (v > 49 OR w > 0.07) OR NOT (v > 2 AND w > 0.0)""",
)
sql("filter_coalesce", "WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem) SELECT k, n, CAST(COALESCE(v, -1) AS BIGINT) AS v FROM t WHERE COALESCE(v, 50) >= 50")
sql("filter_is_null", "WITH t AS (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s FROM orders) SELECT o_orderkey FROM t WHERE s IS NULL")
sql("filter_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
sql("filter_date_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-02-01 00:00:00'")
sql("filter_nan_order", "WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS v FROM lineitem) SELECT k, n FROM t WHERE v > 49")

sql(
    "project_arithmetic",
    """SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_linenumber AS a, l_orderkey - l_partkey AS b, CAST(-l_linenumber AS BIGINT) AS c, CAST(l_orderkey % 7 AS BIGINT) AS d,
    ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""",
)
sql("project_integer_division", "SELECT p_partkey, CAST(p_size div 7 AS BIGINT) AS q, CAST((p_size - 25) div 7 AS BIGINT) AS s, CAST((p_size - 25) % 7 AS BIGINT) AS r FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, CAST(TRUNC((p_size - 25) / 7.0) AS BIGINT) AS s, CAST((p_size - 25) % 7 AS BIGINT) AS r FROM part")
sql("project_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END AS code FROM part")
sql("project_coalesce_chain", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), NULLIF(c_mktsegment, 'MACHINERY'), 'none') AS s, GREATEST(c_nationkey, 10) AS hi, LEAST(c_nationkey, 10) AS lo FROM customer")
sql("project_nested_math", "SELECT l_orderkey, l_linenumber, ROUND(SQRT(ABS(SQRT(l_extendedprice) - l_quantity)), 6) AS v FROM lineitem")
sql("project_view", "WITH v AS (SELECT c_nationkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0) SELECT c_nationkey, COUNT(*) AS n, ROUND(SUM(twice), 2) AS s FROM v GROUP BY c_nationkey")
