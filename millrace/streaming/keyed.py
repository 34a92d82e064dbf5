"""The keyed aggregates on unbounded input: the same expressions, by event-time window and with late rows bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_by_key(stream: DataFrame, keys: list[str], aggs: list[Column], time: str, window: str, late: str) -> DataFrame:
    """Aggregates per key and tumbling window; a window's state goes once it is ``late`` behind the newest row."""
    span = F.window(time, window)
    out = stream.withWatermark(time, late).groupBy(span, *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in out.columns if c != "window"))


def distinct(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
