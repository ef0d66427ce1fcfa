"""Event-time windows that give the same result in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; a stream needs a watermark."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
