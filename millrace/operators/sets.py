"""Set operations: union keeps duplicates, intersection and subtraction have distinct results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left's rows, then right's; partitions are put together, and a partitioning that both share is kept."""
    return left.union(right)


def union_many(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("at least one table is needed")
    return reduce(DataFrame.unionByName, frames)


def distinct(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    out = df.distinct()
    return out.coalesce(num_partitions) if num_partitions else out


def intersection(left: DataFrame, right: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Distinct rows of both; nulls are equal to each other."""
    out = left.intersect(right)
    return out.coalesce(num_partitions) if num_partitions else out


def subtract(left: DataFrame, right: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Distinct rows of left that right has not; nulls are equal to each other."""
    out = left.subtract(right)
    return out.coalesce(num_partitions) if num_partitions else out
