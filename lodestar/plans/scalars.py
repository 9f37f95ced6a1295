"""Scalar functions: numbers, bits, text, dates, JSON, arrays."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import pg
from lodestar.plans.registry import query, sql
from lodestar.sources.tables import load

sql("scalar_math", "SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_extendedprice), 6) AS a, ROUND(POW(l_quantity, 1.5), 4) AS b, ROUND(LN(l_extendedprice), 8) AS c, ROUND(LOG10(l_quantity), 8) AS d, ROUND(EXP(l_discount), 8) AS e, ABS(l_orderkey - l_partkey) AS f FROM lineitem")
sql("scalar_trigonometry", "SELECT p_partkey, ROUND(SIN(p_size), 8) AS s, ROUND(COS(p_size), 8) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(PI(), 8) AS p FROM part")
sql("scalar_rounding", "SELECT c_custkey, CAST(CEIL(c_acctbal) AS BIGINT) AS up, CAST(FLOOR(c_acctbal) AS BIGINT) AS down, CAST(ROUND(c_custkey / 2.0) AS BIGINT) AS half FROM customer")
sql("scalar_casts", "SELECT p_partkey, CAST(p_size AS BIGINT) AS a, CAST(p_size AS DOUBLE) AS b, CAST(p_partkey AS DOUBLE) AS c, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS d, CAST(p_size > 20 AS INT) AS e, CAST(p_size AS VARCHAR(12)) AS f FROM part")
sql("scalar_bits", "SELECT c_custkey, c_custkey & 255 AS a, c_custkey | 1024 AS o, XOR_ AS x, ~c_custkey AS n, SHL_ AS l, SHR_ AS r FROM customer".replace("XOR_", "c_custkey ^ 85").replace("SHL_", "SHIFTLEFT(c_custkey, 3)").replace("SHR_", "SHIFTRIGHT(c_custkey, 2)"), "SELECT c_custkey, c_custkey & 255 AS a, c_custkey | 1024 AS o, xor(c_custkey, 85) AS x, ~c_custkey AS n, c_custkey << 3 AS l, c_custkey >> 2 AS r FROM customer")
sql("scalar_nullif_greatest", "SELECT p_partkey, NULLIF(p_type, 'SMALL') AS t, GREATEST(p_size, 20, NULLIF(p_size, 7)) AS g, LEAST(p_size, 20) AS l FROM part")
sql("scalar_text", "SELECT p_partkey, CAST(LENGTH(p_name) AS BIGINT) AS n, LOWER(p_brand) AS lo, UPPER(p_name) AS up, TRIM(CONCAT('  ', p_type, ' ')) AS t, MD5(p_name) AS h, REPEAT(p_type, 2) AS r, LPAD(CAST(p_size AS VARCHAR(12)), 5, '0') AS pad, p_name LIKE '%bolt%' AS bolt, p_brand || '-' || p_type AS both_ FROM part")
sql("scalar_date_parts", "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(MONTH(o_orderdate) AS BIGINT) AS m, CAST(DAY(o_orderdate) AS BIGINT) AS d, CAST(QUARTER(o_orderdate) AS BIGINT) AS q, CAST(DAYOFYEAR(o_orderdate) AS BIGINT) AS doy FROM orders")
sql("scalar_time_parts", "SELECT event_id, CAST(HOUR(ts) AS BIGINT) AS h, CAST(MINUTE(ts) AS BIGINT) AS m, CAST(DATE_TRUNC('hour', ts) AS VARCHAR(40)) AS hour, CAST(DATE_TRUNC('day', ts) AS VARCHAR(40)) AS day, CAST(DATE_TRUNC('month', ts) AS VARCHAR(40)) AS month FROM events", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, STRFTIME(DATE_TRUNC('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, STRFTIME(DATE_TRUNC('day', ts), '%Y-%m-%d %H:%M:%S') AS day, STRFTIME(DATE_TRUNC('month', ts), '%Y-%m-%d %H:%M:%S') AS month FROM events")


@query("scalar_date_semantics", "SELECT o_orderkey, DATE_PART('dow', o_orderdate) AS dow, DATE_PART('isodow', o_orderdate) AS isodow, EPOCH(o_orderdate) AS epoch, CAST(DATEDIFF('day', o_orderdate, TIMESTAMP '2002-03-31 00:00:00') AS BIGINT) AS days FROM orders")
def scalar_date_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", pg.dow(d).alias("dow"), pg.isodow(d).alias("isodow"), pg.epoch(d).alias("epoch"), F.datediff(F.lit("2002-03-31").cast("date"), d).cast("long").alias("days"))


@query("scalar_age", "SELECT o_orderkey, CAST(DATE_PART('year', i) * 12 + DATE_PART('month', i) AS INTEGER) AS months, CAST(DATE_PART('day', i) AS INTEGER) AS days FROM (SELECT o_orderkey, AGE(TIMESTAMP '2002-02-15 00:00:00', DATE_TRUNC('month', o_orderdate)) AS i FROM orders) t")
def scalar_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pg.age(F.to_timestamp(F.lit("2002-02-15 00:00:00")), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    return load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.months", "a.days")


@query("scalar_pg_math", "SELECT p_partkey, CAST(TRUNC((p_size - 25) / 7.0) AS BIGINT) AS q, SQRT(p_size) AS r, ROUND(LOG10(p_partkey + 1), 8) AS l, ROUND(POW(p_size, 2), 4) AS p, ROUND((p_size - 25) / 2.0) + 0.0 AS h FROM part")
def scalar_pg_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return load(spark, sf_dir, "part", "p_partkey", "p_size").select(
        "p_partkey", pg.int_div(n - 25, F.lit(7)).alias("q"), pg.sqrt(n.cast("double")).alias("r"), F.round(pg.log(F.col("p_partkey") + 1), 8).alias("l"), F.round(pg.power(n.cast("double"), F.lit(2.0)), 4).alias("p"), (pg.rounded((n - 25) / 2.0) + 0.0).alias("h")
    )


sql("json_extract", "SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("json_group", "SELECT CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) % 10", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1")
NESTED = "'{\"k\": ' || CAST(event_id % 7 AS VARCHAR(9)) || ', \"a\": {\"b\": [' || CAST(event_id % 5 AS VARCHAR(9)) || ', {\"c\": \"x' || CAST(event_id % 3 AS VARCHAR(9)) || '\", \"d\": null}, [1, ' || CAST(event_id % 4 AS VARCHAR(9)) || ']], \"e\": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}'"
WANTED = {"number": {"k": 3}, "nested": {"a": {"e": True}}, "inner": {"a": {"b": [{"c": "x1"}]}}, "several": {"k": 2, "a": {"b": [4, [3]]}}, "missing": {"z": 1}, "nothing": {}, "array": {"a": {"b": []}}, "missing_null": {"a": {"b": [{"d": None}]}}}
_checks = ", ".join(f"json_contains({NESTED}, '{json.dumps(w)}') AS {n}" for n, w in WANTED.items())


@query("json_contains", f"SELECT event_id, {_checks} FROM events")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of objects, arrays and scalars at any depth."""
    made = load(spark, sf_dir, "events", "event_id").withColumn("j", F.expr(NESTED.replace("VARCHAR(9)", "STRING")))
    return made.select("event_id", *[pg.json_contains(F.col("j"), w).alias(n) for n, w in WANTED.items()])




@query("json_typeof", "SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' ELSE 'other' END AS kind, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'number' ELSE 'other' END AS inner_kind FROM events")
def json_typeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_id", "props").select("event_id", pg.json_typeof(F.col("props")).alias("kind"), pg.json_typeof(F.get_json_object("props", "$.k")).alias("inner_kind"))


sql("array_functions", "SELECT p_partkey, CAST(SIZE(ARRAY(p_size, 1, 2)) AS BIGINT) AS n, ELEMENT_AT(ARRAY(p_size, p_size * 2), 2) AS second FROM part", "SELECT p_partkey, len([p_size, 1, 2]) AS n, [p_size, p_size * 2][2] AS second FROM part")
