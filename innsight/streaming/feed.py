"""A change feed: counts of significant changes in sliding windows, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_any
from ..operators.violations import SIGNIFICANT


def significant_changes(history: DataFrame, window: str = "90 days", slide: str = "30 days", late: str = "7 days") -> DataFrame:
    """(hotel_id, window, n) of a stream or table with hotel_id, event_type and event_date."""
    h = history.withColumn("event_date", F.col("event_date").cast("timestamp")).where(contains_any(F.col("event_type"), SIGNIFICANT))
    return h.withWatermark("event_date", late).groupBy("hotel_id", F.window("event_date", window, slide)).agg(F.count("*").alias("n"))
