"""Incremental ingest: streams that drop what was seen, and batches that skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_rows(spark: SparkSession, path: str, schema: T.StructType, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """A stream of a folder's Parquet files without repeated keys within delay."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(spark: SparkSession, path: str, schema: T.StructType, key: str, time: str, out: str, checkpoint: str, delay: str = "1 day") -> None:
    """Append what is new in path to out and stop; the checkpoint remembers keys and files between calls."""
    query = new_rows(spark, path, schema, key, time, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def windowed_counts(rows: DataFrame, time: str, group: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums of value by time window and group; for batches and, with the watermark, for streams."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, window).alias("ventana"), group).agg(F.count("*").alias("n"), F.sum("value").alias("suma"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return rows.join(done.select(key), key, "left_anti")
