"""Spark-native extras over arriving pages and events: deduplication, term counts, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblore.functions.text import clean


def read_pages(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet page files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_per_page(pages: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Each page_id once within the watermark."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark(["page_id"])


def arriving_term_frequency(strings: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, template, term, df) of (template, page_id, text, time): approximate distinct pages per day."""
    terms = strings.withColumn("term", clean(F.col("text"))).filter("term <> ''").withWatermark(time, late)
    return terms.groupBy(F.window(time, window).alias("w"), "template", "term").agg(F.approx_count_distinct("page_id").alias("df")).select(F.col("w.start").alias("day"), "template", "term", "df")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per type over tumbling windows, sliding ones with slide given."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events not further apart than the gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
