"""Streaming forms of operators that need no second pass: contract counters over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_counts_by_window(stream: DataFrame, time: str, columns: list[str], window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and nulls per column in tumbling windows; late rows are dropped after ``late``."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("rows"), *counts)
