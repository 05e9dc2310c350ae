"""Windows and de-duplication of event streams. Extras: the data platform itself has no streams. All take batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """window_start, event_type, n, total value."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """user_id, session_start, session_end, n."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events without later copies of the same keys; state is dropped behind the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
