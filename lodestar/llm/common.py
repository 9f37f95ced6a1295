"""What the operators of this subpackage share: reading, shared storage, batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shipping import ship

#: Rows of an Arrow batch; with long texts a batch must fit in a Python worker.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches and sends this package to the executors, once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark.sparkContext)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table; the path is only ever given to Spark's reader."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs in one process, as in tests."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set
        found = None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_lodestar_dir", None) or tempfile.mkdtemp(prefix="lodestar-shared-")
        spark.sparkContext._lodestar_dir = found
    return found


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing already written.

    The tables stay until ``dropped`` or the end of the session, as results read them when they are used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{what}-{uuid.uuid4().hex}"
    held(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> list[str]:
    """Paths of the tables stored in this session and not deleted yet; what is left at the driver's end is deleted then."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lodestar_held"):
        sc._lodestar_held = []
        atexit.register(ended, spark)
    return sc._lodestar_held


def ended(spark: SparkSession) -> None:
    """Deletes what is left, if the session still runs; a store that can't be reached any more keeps it."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            dropped(spark, 0)


def dropped(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes a range of the tables held, in the order they were stored."""
    own = held(spark)
    for path in own[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        own.remove(path)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches where their texts exceed so many bytes; a longer single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with the package on the executors whoever calls."""
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc_bucket(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
