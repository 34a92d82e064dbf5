"""Whole-table aggregates: actions with Python results, and ``*_df`` twins of one row."""

from __future__ import annotations

import copy
import functools
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: What leaves a value as it is, by aggregate; others have no neutral element.
NEUTRAL = {"sum": 0, "bool_and": True, "bool_or": False, "bit_or": 0, "bit_xor": 0}


def count(df: DataFrame) -> int:
    return df.count()


def count_df(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def reduce_df(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates of all rows; null (where SQL has it so) for an empty table."""
    return df.agg(*aggs)


def reduce(df: DataFrame, agg: Column) -> Any:
    """One aggregate's value; None for an empty table."""
    return df.agg(agg).first()[0]


def fold_df(df: DataFrame, column: str, how: str = "sum", init: Any = None, name: str | None = None) -> DataFrame:
    """A fold with a neutral start, for which the number of partitions can't matter."""
    if how not in NEUTRAL:
        raise ValueError(f"{how} has no neutral element; use fold_py")
    if init is not None and init != NEUTRAL[how]:
        raise ValueError("a start that is not neutral counts once per partition and once more; use fold_py")
    return df.agg(F.coalesce(getattr(F, how)(column), F.lit(NEUTRAL[how])).alias(name or column))


def fold(df: DataFrame, column: str, how: str = "sum", init: Any = None) -> Any:
    return fold_df(df, column, how, init).first()[0]


def aggregate_df(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.agg(*aggs)


def _partials(df: DataFrame, f: Callable[[Iterator[Row]], Any]) -> list:
    """``f`` of each partition in order: as many small results as partitions come to the driver."""
    from ..sources.sinks import run_job

    return run_job(df, f)


def reduce_py(df: DataFrame, f: Callable[[Any, Any], Any]) -> Any:
    """A closure over rows; partition results are combined in the order of partitions.  None if empty."""

    def part(rows: Iterator[Row]) -> list:
        first = next(rows, None)
        return [] if first is None else [functools.reduce(f, rows, first)]

    got = [x for p in _partials(df, part) for x in p]
    return functools.reduce(f, got) if got else None


def fold_py(df: DataFrame, init: Any, f: Callable[[Any, Any], Any]) -> Any:
    """As ``reduce_py`` with a start that counts once per partition and once on the driver."""
    return aggregate_py(df, init, f, f)


def aggregate_py(df: DataFrame, init: Any, seq: Callable[[Any, Any], Any], comb: Callable[[Any, Any], Any]) -> Any:
    start = pickle.dumps(init)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make = Row(*names)
        rows = (r if len(names) > 1 else r[0] for r in (make(*x.values()) for b in batches for x in b.to_pylist()))
        out = functools.reduce(seq, rows, pickle.loads(start))
        yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "out": pa.array([pickle.dumps(out)], pa.binary())})

    names = df.columns
    got = sorted((r["p"], r["out"]) for r in df.mapInArrow(run, "p int, out binary").collect())
    return functools.reduce(comb, (pickle.loads(x) for _, x in got), copy.deepcopy(init))


def _extreme(df: DataFrame, columns: tuple[str, ...], nulls: str, largest: bool) -> DataFrame:
    cols = columns or tuple(df.columns)
    key = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
    if nulls == "lowest":  # nulls take part and are below all values
        boxed = F.struct(key.alias("v"))
        return df.agg((F.max(boxed) if largest else F.min(boxed)).alias("b")).select(F.col("b.v").alias("value"))
    return df.agg((F.max(key) if largest else F.min(key)).alias("value"))


def max_df(df: DataFrame, *columns: str, nulls: str = "skip") -> DataFrame:
    """The largest value, or row by the order of its columns; nulls are skipped, or ``lowest``."""
    return _extreme(df, columns, nulls, True)


def min_df(df: DataFrame, *columns: str, nulls: str = "skip") -> DataFrame:
    return _extreme(df, columns, nulls, False)


def max_of(df: DataFrame, *columns: str, nulls: str = "skip") -> Any:
    """None for an empty table."""
    return max_df(df, *columns, nulls=nulls).first()[0]


def min_of(df: DataFrame, *columns: str, nulls: str = "skip") -> Any:
    return min_df(df, *columns, nulls=nulls).first()[0]


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def is_empty_df(df: DataFrame, name: str = "is_empty") -> DataFrame:
    """One row; reads one row of the table at most."""
    return df.limit(1).agg((F.count("*") == 0).alias(name))
