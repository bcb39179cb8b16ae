"""Streaming jobs: densities, session islands and message appends. Jobs with state of their own are in ``state``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def note_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def density(events: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; a window is final once the watermark has passed it."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def session_islands(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """A user's events with no pause longer than ``gap`` between them as one session."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy("user_id", F.session_window("time", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_messages(messages: DataFrame, target: str, checkpoint: str):
    """Messages (conv_id, turn, writer, seq, text) of any number of writers, added to one table; nothing is read back or
    rewritten, so writers need no lock. ``stores.merged_messages`` reads the conversations."""
    kept = messages.select("conv_id", "turn", "writer", "seq", "text")
    return kept.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
