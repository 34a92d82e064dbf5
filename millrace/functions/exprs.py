"""Column expressions that several operators and queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """A sum that does not depend on the order of rows, as a double."""
    return F.sum(F.col(column).cast(f"decimal({precision},{scale})") if isinstance(column, str) else column.cast(f"decimal({precision},{scale})")).cast("double")


def hour_of(ts: str | Column) -> Column:
    return F.hour(ts).cast("bigint")


def words(text: str | Column) -> Column:
    return F.split(text, " ")


def sign_name(value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v < 0, "neg").when(v > 0, "pos").otherwise("zero")
