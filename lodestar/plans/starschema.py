"""Star-schema workloads: pricing and revenue reports, the thirteen star queries, dashboards over events.

The star's fact is lineitem with its order; dates come from the order. Sums are of whole numbers or rounded to the digits
that their terms have, so that the order of addition does not show.
"""

from __future__ import annotations

from lodestar.plans.registry import sql

sql(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
    ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 8) AS avg_disc, MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price, COUNT(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql("tpch_q3", "SELECT o_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) = DATE '1996-01-01' AS first_day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10")
sql("tpch_q4", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
sql("tpch_q5", "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name")
sql("tpch_q6", "SELECT ROUND(SUM(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
sql("tpch_q10", "SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("tpch_q12", "SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_returnflag")
sql("tpch_q14", "SELECT ROUND(100.0 * SUM(CASE WHEN p_type = 'ECONOMY' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'")
sql("tpch_q18", "SELECT c_custkey, o_orderkey, o_totalprice, CAST(SUM(l_quantity) AS BIGINT) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
sql("tpch_q19", "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30)")

FACT = "lineitem JOIN orders ON l_orderkey = o_orderkey"
YEAR = "CAST(YEAR(o_orderdate) AS BIGINT)"
PRICE = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
CENTS = f"CAST(SUM({PRICE}) AS BIGINT)"
DISCOUNTED = f"CAST(SUM({PRICE} * CAST(ROUND(l_discount * 100) AS BIGINT)) AS BIGINT)"
SUPPLIED = f"{FACT} JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey"
SOLD = f"{SUPPLIED} JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey"

sql("ssb_q1_1", f"SELECT {DISCOUNTED} AS revenue FROM {FACT} WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.005 AND 0.035 AND l_quantity < 25")
sql("ssb_q1_2", f"SELECT {DISCOUNTED} AS revenue FROM {FACT} WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-02-01 00:00:00' AND l_discount BETWEEN 0.035 AND 0.065 AND l_quantity BETWEEN 26 AND 35")
sql("ssb_q1_3", f"SELECT {DISCOUNTED} AS revenue FROM {FACT} WHERE o_orderdate >= TIMESTAMP '1997-02-03 00:00:00' AND o_orderdate < TIMESTAMP '1997-02-10 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity BETWEEN 26 AND 40")
sql("ssb_q2_1", f"SELECT {CENTS} AS revenue, {YEAR} AS y, p_brand FROM {SUPPLIED} JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' AND ns.n_regionkey = 1 GROUP BY YEAR(o_orderdate), p_brand")
sql("ssb_q2_2", f"SELECT {CENTS} AS revenue, {YEAR} AS y, p_brand FROM {SUPPLIED} JOIN part ON l_partkey = p_partkey WHERE p_brand BETWEEN 'Brand#12' AND 'Brand#18' AND ns.n_regionkey = 2 GROUP BY YEAR(o_orderdate), p_brand")
sql("ssb_q2_3", f"SELECT {CENTS} AS revenue, {YEAR} AS y, p_brand FROM {SUPPLIED} JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3' AND ns.n_regionkey = 3 GROUP BY YEAR(o_orderdate), p_brand")
sql("ssb_q3_1", f"SELECT nc.n_name AS c_nation, ns.n_name AS s_nation, {YEAR} AS y, {CENTS} AS revenue FROM {SOLD} WHERE nc.n_regionkey = 2 AND ns.n_regionkey = 2 AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY nc.n_name, ns.n_name, YEAR(o_orderdate)")
sql("ssb_q3_2", f"SELECT c_mktsegment, s_suppkey, {YEAR} AS y, {CENTS} AS revenue FROM {SOLD} WHERE nc.n_nationkey = 7 AND ns.n_nationkey = 7 AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY c_mktsegment, s_suppkey, YEAR(o_orderdate)")
sql("ssb_q3_3", f"SELECT c_custkey, s_suppkey, {YEAR} AS y, {CENTS} AS revenue FROM {SOLD} WHERE c_nationkey IN (3, 5) AND s_nationkey IN (3, 5) AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY c_custkey, s_suppkey, YEAR(o_orderdate)")
sql("ssb_q3_4", f"SELECT c_custkey, s_suppkey, {YEAR} AS y, {CENTS} AS revenue FROM {SOLD} WHERE c_nationkey IN (3, 5, 9) AND s_nationkey IN (3, 5, 9) AND o_orderdate >= TIMESTAMP '1997-12-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_custkey, s_suppkey, YEAR(o_orderdate)")
sql("ssb_q4_1", f"SELECT {YEAR} AS y, nc.n_name AS c_nation, {CENTS} - CAST(SUM(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS profit FROM {SOLD} JOIN part ON l_partkey = p_partkey WHERE nc.n_regionkey = 1 AND ns.n_regionkey = 1 AND p_type IN ('ECONOMY', 'SMALL') GROUP BY YEAR(o_orderdate), nc.n_name")
sql("ssb_q4_2", f"SELECT {YEAR} AS y, ns.n_name AS s_nation, p_type, {CENTS} AS profit FROM {SOLD} JOIN part ON l_partkey = p_partkey WHERE nc.n_regionkey = 1 AND ns.n_regionkey = 1 AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' AND p_type IN ('ECONOMY', 'SMALL') GROUP BY YEAR(o_orderdate), ns.n_name, p_type")
sql("ssb_q4_3", f"SELECT {YEAR} AS y, s_suppkey, p_brand, {CENTS} AS profit FROM {SOLD} JOIN part ON l_partkey = p_partkey WHERE nc.n_regionkey = 1 AND ns.n_nationkey = 6 AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' AND p_type = 'SMALL' GROUP BY YEAR(o_orderdate), s_suppkey, p_brand")
sql("star_two_dimensions", "SELECT o_orderpriority, p_size, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 5 AND 12 GROUP BY o_orderpriority, p_size")
sql("star_dimension_filter", "SELECT c_nationkey, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1000 AND c_mktsegment <> 'FURNITURE' GROUP BY c_nationkey")

sql("dashboard_by_type", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE value > 1 GROUP BY event_type")
sql("dashboard_top_users", "SELECT user_id, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
sql("dashboard_daily", "SELECT CAST(DAY(ts) AS BIGINT) AS d, event_type, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY DAY(ts), event_type")
sql("series_hourly_change", "WITH h AS (SELECT user_id, CAST(DAY(ts) AS BIGINT) AS d, COUNT(*) AS n FROM events GROUP BY user_id, DAY(ts)) SELECT user_id, d, n, n - LAG(n) OVER (PARTITION BY user_id ORDER BY d) AS change FROM h")
sql("series_last_per_user", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
sql("series_outliers", "WITH s AS (SELECT user_id, AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM events GROUP BY user_id) SELECT event_id FROM events e JOIN s ON e.user_id = s.user_id WHERE value > m + 3 * sd")
sql("series_share_of_day", "SELECT user_id, CAST(HOUR(ts) AS BIGINT) AS h, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY user_id), 7) AS share FROM events GROUP BY user_id, HOUR(ts)")
