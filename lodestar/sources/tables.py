"""Sources and sinks: Parquet tables with pruned columns, pinned columns, generated series, and writers."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns; Spark prunes the rest and pushes filters into the scan.

    Its schema is read from the files once for each state of them, as reading it takes a job of its own.
    """
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    state, known = (found.getModificationTime(), found.getLen()), _schemas(spark)
    if known.get(path, (None, None))[0] != state:
        known[path] = (state, spark.read.parquet(path).schema)
    df = spark.read.schema(known[path][1]).parquet(path)
    return df.select(*columns) if columns else df


def _schemas(spark: SparkSession) -> dict:
    """Schemas read in this application by path, each with the state of the files it is of."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lodestar_schemas"):
        sc._lodestar_schemas = {}
    return sc._lodestar_schemas


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small table dealt evenly to all cores, for work that is heavy by the row: a file with one row group is read by one task.

    Larger tables have files and row groups enough and stay as they are read.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """Numbers from start to stop, both included."""
    if not step:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, as the store lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], store.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass
class Pin:
    """A table's pinned columns."""

    df: DataFrame
    path: str
    columns: tuple[str, ...]
    rows: int
    size: int
    files: str
    hits: int = 0
    misses: int = 0
    loads: int = 1


@dataclass
class Pins:
    """Columns of tables kept in executors' storage; what does not fit in memory goes to disk.

    ``pin`` loads columns and returns the number of rows, ``refresh`` loads them again, ``unpin`` drops them and ``evict``
    drops the table that was used least recently. A pin whose files have changed is loaded again when it is next used. Columns
    that are asked for and missing are pinned too if ``auto_load`` is set and the budget allows it. ``budget`` bounds the
    estimated bytes; a table that would exceed it is refused and read from its files as before.
    """

    spark: SparkSession
    budget: int = 8 << 30
    auto_load: bool = True
    held: dict[str, Pin] = field(default_factory=dict)
    used: list[str] = field(default_factory=list)
    made: list[tuple[str, list[str], str]] = field(default_factory=list)

    def pin(self, name: str, path: str, columns: Iterable[str] | None = None) -> int:
        chosen = tuple(columns) if columns is not None else tuple(self.spark.read.parquet(path).columns)
        was = self.held.get(name)
        if was:
            chosen = tuple(dict.fromkeys([*was.columns, *chosen]))
        df = self.spark.read.parquet(path).select(*chosen)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        left = self.budget - self.live_bytes() + (was.size if was else 0)
        if size > left:
            raise MemoryError(f"{name} needs about {size} bytes; {left} are left")
        self.unpin(name)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        rows = df.count()
        self.held[name] = Pin(df, path, chosen, rows, size, fingerprint(self.spark, path), *((was.hits, was.misses, was.loads + 1) if was else ()))
        self.used.append(name)
        return rows

    def table(self, name: str, path: str, columns: Iterable[str]) -> DataFrame:
        """The columns, from storage where they are pinned and the files are as they were."""
        columns, pin = tuple(columns), self.held.get(name)
        decided = lambda what: self.made.append((name, list(columns), what))
        if pin:
            if pin.files != fingerprint(self.spark, path):
                self.refresh(name)
                pin = self.held[name]
                decided("loaded again: files changed")
            if not set(columns) <= set(pin.columns):
                pin.misses += 1
                if self.auto_load:
                    with contextlib.suppress(MemoryError):
                        self.pin(name, path, columns)
                        pin = self.held[name]
                        decided("loaded: columns were missing")
            if set(columns) <= set(pin.columns):
                pin.hits += 1
                self.used.remove(name)
                self.used.append(name)
                decided("served from storage")
                return pin.df.select(*columns)
        decided("read from files: not enough room" if pin and self.auto_load else "read from files: columns not pinned" if pin else "read from files: not pinned")
        return self.spark.read.parquet(path).select(*columns)

    def refresh(self, name: str) -> int:
        """Loads the files anew, after they have been changed."""
        pin = self.held[name]
        self.spark.catalog.refreshByPath(pin.path)
        return self.pin(name, pin.path, pin.columns)

    def unpin(self, name: str) -> bool:
        found = self.held.pop(name, None)
        if found:
            found.df.unpersist()
            self.used.remove(name)
        return found is not None

    def evict(self) -> str | None:
        """Drops the least recently used table and returns its name."""
        name = self.used[0] if self.used else None
        if name:
            self.unpin(name)
        return name

    def live_bytes(self) -> int:
        return sum(p.size for p in self.held.values())

    def status(self) -> DataFrame:
        """Each pinned table: columns, rows, estimated bytes."""
        return self.spark.createDataFrame([(n, list(p.columns), p.rows, p.size) for n, p in self.held.items()], "name string, columns array<string>, rows long, bytes long")

    def decisions(self) -> DataFrame:
        """What was done for each request, in order, and why."""
        return self.spark.createDataFrame([(i, *m) for i, m in enumerate(self.made)], "request long, name string, columns array<string>, decision string")

    def ingestion(self) -> DataFrame:
        """How often each table was loaded, and served from storage or not."""
        return self.spark.createDataFrame([(n, p.loads, p.hits, p.misses) for n, p in self.held.items()], "name string, loads long, hits long, misses long")

    def representation(self) -> DataFrame:
        """The type of each pinned column and where it is kept."""
        rows = [(n, c, t, str(p.df.storageLevel)) for n, p in self.held.items() for c, t in p.df.dtypes]
        return self.spark.createDataFrame(rows, "name string, column string, type string, storage string")

    def dependencies(self) -> DataFrame:
        """The files each pin was made from, and whether they are still the same."""
        rows = [(n, p.path, p.files, p.files == fingerprint(self.spark, p.path)) for n, p in self.held.items()]
        return self.spark.createDataFrame(rows, "name string, path string, files string, current boolean")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Iterable[str] = (), rows_per_file: int = 0) -> None:
    """Parquet with optional partition folders. Rows are dealt by the folders' keys and rebalanced, so that a large folder is written by several tasks."""
    keys = list(partition_by)
    if keys:
        df = df.hint("rebalance", *keys)
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def create_table_as(df: DataFrame, name: str, bucket_by: tuple[int, str] | None = None) -> None:
    """CREATE TABLE AS; bucketing by a join key lets later joins on it go without a shuffle."""
    writer = df.write.format("parquet").mode("errorifexists")
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
    writer.saveAsTable(name)


def insert_select(df: DataFrame, path: str) -> None:
    """INSERT ... SELECT: adds rows to a table of the same columns, cast to its types."""
    kinds = df.sparkSession.read.parquet(path).dtypes
    df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds]).write.mode("append").parquet(path)


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:  # noqa: ANN001
    """Rows with one key; the filter is pushed into the scan, where row groups are skipped by their statistics."""
    return df.where(F.col(column) == F.lit(value))


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replaces a Parquet table by what ``change`` makes of it; returns its number of rows.

    The new files are written beside the old ones, which are moved away only then: readers that began before a change may fail,
    but a job that dies leaves the old table or the new one, never a part.
    """
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    store.delete(at(new), True)
    change(spark.read.parquet(path)).write.parquet(new)
    store.delete(at(old), True)
    store.rename(at(path), at(old))
    store.rename(at(new), at(path))
    store.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path).count()


def delete_where(spark: SparkSession, path: str, condition: Column) -> int:
    """DELETE: rows for which the condition is not true stay, those where it is NULL too."""
    return rewrite(spark, path, lambda df: df.where(~F.coalesce(condition, F.lit(False))))


def update_where(spark: SparkSession, path: str, values: dict[str, Column], condition: Column) -> int:
    """UPDATE: new values of some columns where the condition is true, all from the old row; types stay."""

    def change(df: DataFrame) -> DataFrame:
        hit = F.coalesce(condition, F.lit(False))
        return df.select(*[F.when(hit, values[c].cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in df.dtypes])

    return rewrite(spark, path, change)


@dataclass
class Prepared:
    """A statement with named parameters (:name) over tables; it is run with values, which can't change its meaning."""

    text: str
    tables: dict[str, DataFrame]

    def __call__(self, **values) -> DataFrame:  # noqa: ANN003
        spark = next(iter(self.tables.values())).sparkSession
        return spark.sql(self.text, args=values, **self.tables)
