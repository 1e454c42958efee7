"""Structured Streaming over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_STREAM = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Events of Parquet files as they arrive, with their time as an instant and a watermark."""
    return spark.readStream.schema(EVENT_STREAM).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(event_type, start, stop, n): counts per type and window, of a batch or a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """Each event id once within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what there is and stop; the checkpoint remembers it."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
