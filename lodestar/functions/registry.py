"""Functions by name for SQL, and what can be asked of a session: version, device, plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shipping import ship

VERSION = "2.0"


def functions() -> dict:
    """Name to vectorised function, for use in SQL."""
    from lodestar.functions import h3grid, shapes

    def one(kind, f):  # noqa: ANN001, ANN202
        def run(g: pd.Series) -> pd.Series:
            return pd.Series(shapes.once(lambda x: f(shapes.from_ewkb(bytes(x))), g), dtype=object)

        return F.pandas_udf(run, kind)

    def two(kind, f):  # noqa: ANN001, ANN202
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(shapes.once(lambda x, y: f(shapes.from_ewkb(bytes(x)), shapes.from_ewkb(bytes(y))), a, b), dtype=object)

        return F.pandas_udf(run, kind)

    def relation(i: int):  # noqa: ANN202
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(shapes.once(lambda x, y: shapes.related(bytes(x), bytes(y))[i], a, b), dtype=object)

        return F.pandas_udf(run, "boolean")

    def text(t: pd.Series) -> pd.Series:
        return pd.Series(shapes.once(lambda x: shapes.to_ewkb(shapes.from_wkt(x)), t), dtype=object)

    def latlng(lat: pd.Series, lng: pd.Series, res: pd.Series) -> pd.Series:
        known = (lat.notna() & lng.notna() & res.notna()).to_numpy()
        out = pd.array([None] * len(lat), dtype="Int64")
        for r in res[known].unique():
            some = known & (res == r).to_numpy()
            out[some] = h3grid.cells_of(lat[some].to_numpy(dtype="float64"), lng[some].to_numpy(dtype="float64"), int(r))
        return pd.Series(out)

    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = pd.array([None] * len(a), dtype="Int64")
        out[known] = pd.array(h3grid.distances(a[known].to_numpy(dtype="int64"), b[known].to_numpy(dtype="int64")), dtype="Int64")
        return pd.Series(out)

    def disk(cell: pd.Series, k: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(cell), dtype=object)
        for n in k.dropna().unique():
            some = np.nonzero((cell.notna() & (k == n)).to_numpy())[0]
            for i, found in zip(some, h3grid.disks(cell.iloc[some].astype("int64").tolist(), int(n)), strict=True):
                out.iat[i] = list(found)
        return out

    def center(cell: pd.Series) -> pd.DataFrame:
        known = cell.notna().to_numpy()
        out = np.full((len(cell), 2), np.nan)
        out[known] = np.stack(h3grid.degrees(h3grid.centers(cell[known].to_numpy(dtype="int64"))), axis=1)
        return pd.DataFrame(out, columns=["lat", "lng"])

    geometry = {
        "st_srid": ("int", lambda g: g.srid),
        "st_geometrytype": ("string", lambda g: g.kind),
        "st_npoints": ("int", lambda g: len(g.vertices)),
        "st_isempty": ("boolean", lambda g: g.empty),
        "st_isvalid": ("boolean", shapes.valid),
        "st_area": ("double", shapes.area),
        "st_length": ("double", shapes.length),
        "st_astext": ("string", shapes.to_wkt),
    }
    return {
        "st_geomfromtext": F.pandas_udf(text, "binary"),
        **{n: one(k, f) for n, (k, f) in geometry.items()},
        "st_distance": two("double", shapes.distance),
        **{f"st_{r}": relation(i) for i, r in enumerate(shapes.RELATIONS)},
        "h3_latlng_to_cell": F.pandas_udf(latlng, "long"),
        "h3_grid_distance": F.pandas_udf(steps, "long"),
        "h3_grid_disk": F.pandas_udf(disk, "array<long>"),
        "h3_cell_to_latlng": F.pandas_udf(center, "lat double, lng double"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL, as temporary functions; returns their names."""
    ship(spark.sparkContext)
    found = functions()
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)


def version() -> str:
    return VERSION


def device_info(spark: SparkSession) -> DataFrame:
    """What the session computes with: master, executors, cores, memory."""
    sc = spark.sparkContext
    executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - (0 if sc.master.startswith("local") else 1))
    rows = [("version", VERSION), ("spark", spark.version), ("master", sc.master), ("executors", str(executors)), ("cores", str(sc.defaultParallelism)), ("executor_memory", sc.getConf().get("spark.executor.memory", "1g"))]
    return spark.createDataFrame(rows, "name string, value string")


def plan_stats(df: DataFrame) -> DataFrame:
    """How often each physical operator occurs in a plan, and the optimizer's estimate of its output."""
    import re

    plan = df._jdf.queryExecution().sparkPlan().toString()
    names = re.findall(r"^[\s:+*()0-9-]*([A-Z][A-Za-z]+)", plan, flags=re.M)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    counts = sorted({n: names.count(n) for n in names}.items())
    return df.sparkSession.createDataFrame([(n, c, size) for n, c in counts], "operator string, times long, estimated_bytes decimal(38,0)" if size >= 1 << 63 else "operator string, times long, estimated_bytes long")
