"""Rollups of event streams: partial aggregates per window and key that close when the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rollup(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum, least and greatest value of each key and window; events later than ``late`` are left out, state is dropped with them.

    The same plan serves a table and a stream.
    """
    at = events.withColumn(time, F.col(time).cast("timestamp"))
    at = at.withWatermark(time, late) if events.isStreaming else at
    groups = at.groupBy(F.window(time, window).alias("w"), key)
    out = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total", "lo", "hi")


def write_rollup(df: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Appends closed windows as Parquet; the checkpoint makes each of them appear once, also after a restart."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
