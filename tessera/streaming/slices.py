"""An extension over event time: label counts and transitions between consecutive windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, label, n of each tumbling window; rows later than the watermark are dropped. For streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "label", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """Write all that is there to parquet, then stop."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
