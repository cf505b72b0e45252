"""Incremental forms of the mergeable statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_histogram(events: DataFrame, at: str, bucket: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each bucket in tumbling windows of a stream; rows later than `late` are left out. An extra: the batch histogram is operators.sequences.histogram."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), bucket).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), bucket, "n")
