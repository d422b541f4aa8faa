"""Streaming forms of order-bounded operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_islands(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Islands of events of one key, closed by a gap; late events join while the watermark allows."""
    e = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return e.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark: state is dropped with it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
