"""Literal sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def from_items(spark: SparkSession, items: Iterable, schema: str | StructType = "value long", num_slices: int | None = None) -> DataFrame:
    """Items (scalars or tuples) in contiguous slices; exactly ``num_slices`` partitions, the default parallelism if None.

    Order within and across slices is that of the items; an empty list gives an empty table.
    """
    n = num_slices or spark.sparkContext.defaultParallelism
    if n < 1:
        raise ValueError("num_slices must be positive")
    rows = [x if isinstance(x, (tuple, list, dict)) else (x,) for x in items]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, n), schema)


def from_chunks(spark: SparkSession, chunks: Sequence[Sequence], schema: str | StructType = "value long") -> DataFrame:
    """User-made slices: one partition for each chunk, in order."""
    if not chunks:
        return spark.createDataFrame([], schema)
    flat = spark.sparkContext.parallelize(list(chunks), len(chunks)).flatMap(lambda c: [x if isinstance(x, (tuple, list, dict)) else (x,) for x in c])
    return spark.createDataFrame(flat, schema)


def int_range(spark: SparkSession, start: int, end: int, step: int = 1, num_slices: int | None = None) -> DataFrame:
    """``id`` from ``start`` up to and including ``end``."""
    if step < 1:
        raise ValueError("step must be positive")
    return spark.range(start, end + 1, step, num_slices)


def chunked(df: DataFrame, num_slices: int) -> DataFrame:
    """One row for each slice of ``df``'s rows, as an array of structs."""
    return df.repartition(num_slices).groupBy(F.spark_partition_id().alias("slice")).agg(F.collect_list(F.struct("*")).alias("items"))
