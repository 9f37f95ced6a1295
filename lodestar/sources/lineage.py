"""Cutting the lineage of tables that are used by several later steps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder's name below the checkpoint folder, for tables that a query writes and reads again; deleted at the session's end."""
    path = f"{checkpoint_folder(spark)}/lodestar-work-{uuid.uuid4().hex}"
    atexit.register(_deleted, spark, path)
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names; one of our own only where none is named and all runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the checkpoint folder; a lost executor costs nothing of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
