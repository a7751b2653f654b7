"""Findings that arrive as a stream: distinct ones, and severities by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.schema import severity_rank


def distinct_arrivals(stream: DataFrame, time: str = "loaded_at", late: str = "60 days") -> DataFrame:
    """Each finding once, though it is delivered again within the watermark. State holds the keys of that time only."""
    keys = ["scan_id", "target", "id", "layer", "category", "title"]
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def severity_windows(stream: DataFrame, time: str = "started_at", late: str = "30 days", size: str = "7 days") -> DataFrame:
    """Per window of time and layer: n_findings, n_critical and worst_rank. Rows later than the watermark are left out,
    as streams do."""
    rank = severity_rank(F.col("severity"))
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), "layer")
        .agg(F.count("*").alias("n_findings"), F.count(F.when(rank == 4, 1)).alias("n_critical"), F.max(rank).alias("worst_rank"))
        .select(F.col("w.start").alias("window_start"), "layer", "n_findings", "n_critical", "worst_rank")
    )
