"""Compares a Spark query with its SQL in DuckDB, on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def kind(t: str) -> str:
    """Integers of any width are one kind, and so are floats."""
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "integer"
    if t in ("float", "double"):
        return "float"
    return {"varchar": "string", "boolean": "boolean"}.get(t, t)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        v = df[c]
        if v.dtype == object or str(v.dtype) in ("str", "string"):
            out[c] = v.map(lambda x: None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x) else str(x))
        elif v.dtype == bool or str(v.dtype) == "boolean":
            out[c] = v.astype(object).map(lambda x: None if x is None or x is pd.NA else str(bool(x)))
        else:
            out[c] = pd.to_numeric(v, errors="raise").astype("float64")
    df = pd.DataFrame(out)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df.columns) else df


def compare(spark, sf_dir: str, query, oracle: str | None) -> str:  # noqa: ANN001
    """What differs; empty if nothing does. Without SQL the query only has to run."""
    df = query(spark, sf_dir)
    got = df.toPandas()
    if oracle is None:
        return "" if len(got) else "no rows"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    rel = con.sql(oracle)
    want = rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    kinds = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    mine = {c: kind(t) for c, t in df.dtypes}
    if differ := {c: (mine[c], kinds[c]) for c in kinds if mine[c] != kinds[c]}:
        return f"types {differ}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if a[c].dtype == "float64" and b[c].dtype == "float64":
            ok = (a[c] == b[c]) | (a[c].isna() & b[c].isna()) | (np.abs(a[c] - b[c]) <= 1e-9 * np.abs(b[c]))
        else:
            ok = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not ok.all():
            i = int(np.argmin(ok.to_numpy()))
            return f"{c} differs in {int((~ok).sum())} rows: {a[c][i]!r}, not {b[c][i]!r}"
    return ""
