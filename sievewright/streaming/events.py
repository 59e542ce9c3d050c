"""Native streaming windows over an event stream: an extension of the trace metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume(events: DataFrame, width: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Count and mean value per window and type; rows later than the watermark are left out."""
    kept = events.withWatermark(ts, late)
    return kept.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Sessions of a user: activity without a pause longer than the gap."""
    kept = events.withWatermark(ts, late)
    return kept.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source has now into parquet, exactly once."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
