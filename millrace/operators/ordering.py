"""Limits and top-k.  Nulls are the lowest values, as in the engine's own order of optional values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def take(df: DataFrame, n: int) -> list[Row]:
    """The first rows in partition order; scans one partition, then more as needed."""
    return df.take(n) if n > 0 else []


def first(df: DataFrame) -> Row:
    row = df.first()
    if row is None:
        raise ValueError("empty collection")
    return row


def take_df(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(0, n))


def _order(df: DataFrame, by: tuple, descending: bool) -> list[Column]:
    cols = [F.col(c) if isinstance(c, str) else c for c in (by or df.columns)]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def top_df(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """The n largest rows by ``by`` (or all columns), largest first: a heap per task, then one merge."""
    return df.orderBy(*_order(df, by, True)).limit(n)


def take_ordered_df(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """The n smallest rows, smallest first."""
    return df.orderBy(*_order(df, by, False)).limit(n)


def top(df: DataFrame, n: int, *by: str | Column) -> list[Row]:
    return top_df(df, n, *by).collect() if n > 0 else []


def take_ordered(df: DataFrame, n: int, *by: str | Column) -> list[Row]:
    return take_ordered_df(df, n, *by).collect() if n > 0 else []


def collect(df: DataFrame) -> list[Row]:
    """All rows in partition order, on the driver."""
    return df.collect()
