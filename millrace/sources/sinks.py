"""Sinks and jobs with side effects."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def as_text(df: DataFrame) -> Column:
    """One string per row: a lone string column as it is, all else as JSON."""
    if len(df.columns) == 1 and df.dtypes[0][1] == "string":
        return F.col(df.columns[0])
    if len(df.columns) == 1:
        return F.col(df.columns[0]).cast("string") if not df.dtypes[0][1].startswith(("struct", "array", "map")) else F.to_json(df.columns[0])
    return F.to_json(F.struct("*"))


def save_as_text_file(df: DataFrame, path: str, text: Column | None = None) -> None:
    """A line per row, a part file per partition; files that are there are replaced.  Nulls become empty lines."""
    df.select(F.coalesce(as_text(df) if text is None else text, F.lit("")).alias("value")).write.mode("overwrite").text(path)


def for_each(df: DataFrame, f: Callable[[Row], None]) -> None:
    df.foreach(f)


def for_each_partition(df: DataFrame, f: Callable[[Iterator[Row]], None]) -> None:
    df.foreachPartition(f)


def run_job_with_context(df: DataFrame, f: Callable[[TaskContext, Iterator[Row]], object], partitions: Sequence[int] | None = None) -> list:
    """``f`` of every partition (or of those asked for), in the order of partitions; results come to the driver."""
    names = df.columns
    # the partition numbers are those of ``df`` itself, as nothing stands between it and the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        make = Row(*names)
        rows = (make(*r.values()) for b in batches for r in b.to_pylist())
        out = pickle.dumps(f(context, rows))
        yield pa.RecordBatch.from_pydict({"p": pa.array([context.partitionId()], pa.int32()), "out": pa.array([out], pa.binary())})

    out = df.mapInArrow(run, "p int, out binary")
    if partitions is None:
        rows = out.collect()
    else:  # tasks of those partitions only
        rdd = out.rdd
        there = sorted({p for p in partitions if 0 <= p < rdd.getNumPartitions()})
        rows = df.sparkSession.sparkContext.runJob(rdd, list, there) if there else []
    got = {r["p"]: pickle.loads(r["out"]) for r in rows}
    return [got[p] for p in (sorted(got) if partitions is None else partitions) if p in got]


def run_job(df: DataFrame, f: Callable[[Iterator[Row]], object]) -> list:
    return run_job_with_context(df, lambda _, rows: f(rows))


def run_job_with_partitions(df: DataFrame, f: Callable[[Iterator[Row]], object], partitions: Iterable[int]) -> list:
    return run_job_with_context(df, lambda _, rows: f(rows), list(partitions))
