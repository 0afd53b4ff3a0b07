"""Counts over streams: document-term and event counts by window, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of each tumbling window; for a stream or a table of (ts, value, by)."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def term_counts(docs: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(start, term, frequency): documents (ts, terms) that hold each term, by window."""
    terms = docs.withWatermark("ts", late).select("ts", F.explode(F.array_distinct("terms")).alias("term"))
    return terms.groupBy(F.window("ts", window).alias("w"), "term").agg(F.count("*").alias("frequency")).select(F.col("w.start").alias("start"), "term", "frequency")
