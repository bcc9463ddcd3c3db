"""Failures with a time to live, as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL = "900 seconds"


def failure_counts(events: DataFrame, key: str, ts: str = "ts", failed: str = "event_type = 'error'", ttl: str = TTL) -> DataFrame:
    """Failures of each key in windows of the time to live; a batch or a stream.

    On a stream the watermark is the time to live: state older than it is dropped, and so are later arrivals.
    """
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__ts", ttl)
    counted = stamped.filter(failed).groupBy(F.window("__ts", ttl).alias("w"), key).agg(F.count("*").alias("failures"))
    return counted.select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "failures")
