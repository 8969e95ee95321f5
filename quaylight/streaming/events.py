"""Streams, an extension: event-time windows and sessions over an event source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, schema: T.StructType | str, files: int = 100) -> DataFrame:
    """A stream of the parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy("event_type", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events less than a gap apart."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Starts the stream into a parquet folder, over what there is now."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder, format="parquet")
