"""Numbers of partitions and where rows go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce(df: DataFrame, n: int, shuffle: bool = False) -> DataFrame:
    """Without a shuffle: neighbouring partitions are put together, never more than there are."""
    return df.repartition(n) if shuffle else df.coalesce(n)


def repartition(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    return df.repartition(n, *keys)


def number_of_splits(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, n) of each non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
