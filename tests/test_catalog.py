"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from lodestar.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf_dir):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES.get(name)) == ""


@pytest.fixture
def soon(spark):
    """Cancels what runs after a minute, so that a quadratic plan fails."""
    from threading import Timer

    timer = Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def test_pairs_are_counted_before_the_join(spark, tmp_path, soon):
    """10^10 pairs, and a supplier given twice."""
    spark.range(100_000).selectExpr("id AS c_custkey", "3 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(100_000).selectExpr("IF(id = 7, 8, id) AS s_suppkey", "IF(id = 5, NULL, 3) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["join_many_to_many"](spark, str(tmp_path)).collect()] == [(3, 100_000 * 99_999, 99_998)]


@pytest.mark.parametrize("name", ["spatial_join", "spatial_join_polygons", "window_over_spatial_join"])
def test_points_on_one_place_and_shapes_of_one_form(name, spark, tmp_path, soon):
    """Some 9 * 10^9 pairs, as keys that differ by 4,000 lie on one place; some rows are given twice or have no key."""
    spark.range(100_000).selectExpr("IF(id % 1000 = 0, NULL, id * 4000) AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(100_000).selectExpr("id * 4000 AS c_custkey").union(spark.sql("SELECT 4000L UNION ALL SELECT NULL")).write.parquet(f"{tmp_path}/customer.parquet")
    few = tmp_path / "few"
    for t, k in (("events", "event_id"), ("customer", "c_custkey")):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where(f"{k} < 400000 OR {k} IS NULL").coalesce(1).write.parquet(f"{few}-{t}")
        (few / f"{t}.parquet").parent.mkdir(exist_ok=True)
        next((tmp_path / f"few-{t}").glob("part-*")).rename(few / f"{t}.parquet")
    assert compare(spark, str(few), QUERIES[name], ORACLES[name]) == ""
    got = QUERIES[name](spark, str(tmp_path)).agg({"n": "max", "*": "count"}).first()
    assert got["max(n)"] > 80_000 and got["count(1)"] >= 100_000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports where the llm folders and the pipeline are deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    # Nor does anything else need the libraries of the subpackage.
    code = "import sys; sys.modules.update(dict.fromkeys(('zstandard', 'tokenizers', 'public_tokenizers')))\n" + code
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_without_the_libraries(tmp_path):
    """The entry imports where a library that only the subpackage needs is missing."""
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e; assert 'tpch_q1' in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=top, check=True)
