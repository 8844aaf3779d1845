"""Counts over time windows of an event stream, in batch and in Structured Streaming.

The streaming form of the prevalence trend: tumbling windows with a watermark, so late events are
taken until the watermark passes and state stays bounded by the open windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_share(events: DataFrame, positive: Column, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, n, n_positive, share. The same code serves batch and stream; only a stream has a watermark."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_t", late)
    g = e.groupBy(F.window("_t", width)).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_positive"))
    return g.select(F.col("window.start").alias("window_start"), "n", "n_positive", (F.col("n_positive") / F.col("n")).alias("share"))


def start_windowed_share(events: DataFrame, positive: Column, sink: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append finished windows to Parquet; exactly once through the checkpoint."""
    return windowed_share(events, positive, **options).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
