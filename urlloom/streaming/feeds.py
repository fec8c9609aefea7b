"""The cleaning columns over a stream of feed rows, and event counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlloom.functions.urls import with_clean_urls


def cleaned_stream(spark: SparkSession, folder: str, schema: str, url: str = "url_raw", at: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """New Parquet files of a folder; each clean URL once within the watermark."""
    rows = with_clean_urls(spark.readStream.schema(schema).parquet(folder), url).filter("reason IS NULL")
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url_clean"])


def window_counts(events: DataFrame, at: str, kind: str, length: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Events by tumbling window and kind; a delay makes it a streaming aggregation with a watermark."""
    rows = events.withWatermark(at, delay) if delay else events
    made = rows.groupBy(F.window(at, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("events"))
    return made.select(F.col("w.start").alias("window_start"), kind, "events")
