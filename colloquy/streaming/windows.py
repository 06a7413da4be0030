"""Streaming form of the tumbling-window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def window_totals(events: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each tumbling window; rows later than ``late`` are left out, and state is dropped with the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
