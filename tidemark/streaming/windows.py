"""Windowed counts that run on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type; on a stream late rows are waited for as long as ``late``.

    Amounts are added as whole cents, so the order of rows does not matter.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select(F.col("w.start").alias("day"), "event_type", "n", "cents")
