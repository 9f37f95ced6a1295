"""Where queries are registered: a function of a session and a folder, and the same query in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import TABLES, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a DataFrame query, with its oracle where SQL expresses it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query in Spark's SQL over the tables it names; ``oracle`` is given where DuckDB's dialect differs."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(named(text, used), **{t: load(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = oracle or text


def named(text: str, tables: list[str]) -> str:
    """The text with each table as a parameter of the session's sql()."""
    text = text.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\b(FROM|JOIN|,)\s+({'|'.join(tables)})\b(?!\s*\()", r"\1 {\2}", text) if tables else text
