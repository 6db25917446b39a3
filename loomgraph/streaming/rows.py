"""Row-local and windowed operators on streams. The reference has none of it; the same expressions serve both worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_filter(docs: DataFrame, low: int = 40, high: int = 512, banned: str = "(?i)licen[sc]e") -> DataFrame:
    """Length and pattern filter of a stream or table of documents."""
    return docs.filter(F.char_length("text").between(low, high) & ~F.col("text").rlike(banned))


def first_of_equal(docs: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """One of equal texts within the watermark; the state holds hashes only."""
    return docs.withWatermark(time, late).withColumn("_h", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by kind in tumbling windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
