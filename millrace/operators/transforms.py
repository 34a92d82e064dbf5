"""Narrow operators: nothing here moves a row to another partition, but ``zip_ordered``."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import Workspace

Expr = str | Column


def _column(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


def project(df: DataFrame, *columns: Expr) -> DataFrame:
    """map: one row for each row."""
    return df.select(*columns)


def where(df: DataFrame, condition: Expr) -> DataFrame:
    """filter: keeps order; a null condition drops the row."""
    return df.where(condition)


def flat_map(df: DataFrame, array: Expr, name: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """flat_map: a row for each element of an array expression, in order; null or empty arrays give none."""
    return df.select(*keep, F.explode(_column(array)).alias(name))


def _target(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows as named tuples: made column by column, and with attributes at the speed of tuples."""
    make = namedtuple("Row", names, rename=True)._make
    for b in batches:
        yield from map(make, zip(*(c.to_pylist() for c in b.columns), strict=True)) if b.columns else (make(()) for _ in range(b.num_rows))


def _emit(rows: Iterable, target: T.StructType, size: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, rows = to_arrow_schema(target), iter(rows)
    while held := list(islice(rows, size)):
        columns = zip(*(r if isinstance(r, (tuple, list)) else (r,) for r in held), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)


def map_partitions_with_index(df: DataFrame, f: Callable[[int, Iterator[tuple]], Iterable], schema: str | T.StructType) -> DataFrame:
    """A closure from a partition's number and rows (named tuples) to rows of ``schema``; rows stream through in batches."""
    target, names = _target(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(f(TaskContext.get().partitionId(), _rows(batches, names)), target)

    return df.mapInArrow(run, target)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType | None = None) -> DataFrame:
    """map_partitions with a closure over a partition's Arrow batches: no Python object per row."""
    return df.mapInArrow(f, df.schema if schema is None else _target(schema))


def map_partitions(df: DataFrame, f: Callable[[Iterator[tuple]], Iterable], schema: str | T.StructType) -> DataFrame:
    """A closure over rows; prefer ``map_batches`` where Arrow's own functions can say it."""
    return map_partitions_with_index(df, lambda _, rows: f(rows), schema)


def map_py(df: DataFrame, f: Callable[[tuple], object], schema: str | T.StructType) -> DataFrame:
    """map with a closure; prefer ``project``."""
    return map_partitions(df, lambda rows: map(f, rows), schema)


def filter_py(df: DataFrame, f: Callable[[tuple], bool]) -> DataFrame:
    """filter with a closure; prefer ``where``, which reaches the scan."""
    return map_partitions(df, lambda rows: filter(f, rows), df.schema)


def flat_map_py(df: DataFrame, f: Callable[[tuple], Iterable], schema: str | T.StructType) -> DataFrame:
    """flat_map with a closure; prefer ``flat_map``."""
    return map_partitions(df, lambda rows: (y for x in rows for y in f(x)), schema)


def aggregate_partitions(df: DataFrame, *aggs: Column) -> DataFrame:
    """map_partitions for what an aggregate can say: a row per non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(*aggs)


def glom(df: DataFrame, name: str = "items", empty: bool = False) -> DataFrame:
    """A row (partition, array of its rows) per partition; empty partitions too, if ``empty`` is set."""
    item = F.col(df.columns[0]) if len(df.columns) == 1 else F.struct("*")
    out = aggregate_partitions(df, F.collect_list(item).alias(name))
    if not empty:
        return out
    n = df.rdd.getNumPartitions()
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    kind = out.schema[name].dataType
    return every.join(out, "partition", "left").select("partition", F.coalesce(name, F.array().cast(kind)).alias(name))


def key_by(df: DataFrame, key: Expr, name: str = "key") -> DataFrame:
    """The element's columns, then its key."""
    return df.select("*", _column(key).alias(name))


def map_values(df: DataFrame, value: str, expr: Expr) -> DataFrame:
    """Changes a value column; keys stay."""
    return df.withColumn(value, _column(expr))


def flat_map_values(df: DataFrame, keys: list[str], array: Expr, name: str = "value") -> DataFrame:
    """A row per produced value, the keys repeated."""
    return df.select(*keys, F.explode(_column(array)).alias(name))


def zip_partitions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Element j of partition i of both sides; each partition is cut to the shorter.

    Narrow: partition i of both sides is read by one task, packed as Arrow streams, and nothing is shuffled.  Both
    sides need the same number of partitions, and a partition has to fit a task (a packed one has 2 GB at most).
    """
    schema = T.StructType([*left.schema.fields, *right.schema.fields])
    packs = left.mapInArrow(_packed, "rows binary").rdd.zip(right.mapInArrow(_packed, "rows binary").rdd)
    pairs = df_of(left.sparkSession, packs.map(lambda p: (bytes(p[0][0]), bytes(p[1][0]))), "a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                sides = [pa.ipc.open_stream(x.as_py()).read_all() if len(x.as_py()) else None for x in (a, b)]
                if None not in sides:
                    n = min(map(len, sides))
                    columns = [c for side in sides for c in side.slice(0, n).columns]
                    yield from pa.Table.from_arrays(columns, names=[str(k) for k in range(len(columns))]).rename_columns(target.names).cast(target).to_batches()

    return pairs.mapInArrow(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the partition as an Arrow stream, or nothing of it where it is empty."""
    sink, writer = pa.BufferOutputStream(), None
    for batch in batches:
        writer = writer or pa.ipc.new_stream(sink, batch.schema)
        writer.write_batch(batch)
    if writer:
        writer.close()
    yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes() if writer else b""], pa.binary())})


def df_of(spark, rdd, schema: str) -> DataFrame:
    """A table of an RDD of tuples that are known to fit ``schema``."""
    return spark.createDataFrame(rdd, schema, verifySchema=False)


def zip_ordered(left: DataFrame, right: DataFrame, left_order: list[Expr], right_order: list[Expr]) -> DataFrame:
    """The i-th row of both sides by explicit orders, cut to the shorter.

    Ranks come from a range sort and per-partition counts, so no side passes through one task.
    """
    return ranked(left, left_order, "_rank").join(ranked(right, right_order, "_rank"), "_rank").drop("_rank")


def ranked(df: DataFrame, order: list[Expr], name: str) -> DataFrame:
    """``df`` with 0-based ranks by ``order``, without a global window; of equal ranks, all columns decide.

    The sorted rows are written to the shared folder, as both uses must see the same partition numbers.
    """
    spark = df.sparkSession
    parts = "_part"
    ties = [F.xxhash64(*df.columns), *(c for c, t in df.dtypes if not re.search("map<|variant", t))]
    placed = df.orderBy(*order, *ties).withColumns({parts: F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    placed = Workspace(spark, "ranked").keep(placed, "sorted")
    counts = placed.groupBy(parts).agg(F.count("*").alias("n"))
    # one row per partition: bounded by the number of partitions
    offset = counts.select(parts, (F.sum("n").over(Window.orderBy(parts)) - F.col("n")).alias("_offset"))
    offsets = spark.createDataFrame(offset.collect(), f"{parts} int, _offset long")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), parts).withColumn(name, F.col("_offset") + within).drop(parts, "_id", "_offset")
