"""File sources: whole files as bytes, their paths, decoded files, delimited text and Parquet columns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


@dataclass(frozen=True)
class FileReaderConfig:
    """What to read: the files directly in a folder (not below it), or one file, of any file system of Spark.

    As in all of Spark's readers, names that begin with ``_`` or ``.`` are left out.
    """

    path: str
    extension: str | None = None
    directory: bool | None = None
    partitions_per_executor: int | None = None

    def filter_extension(self, extension: str) -> FileReaderConfig:
        return replace(self, extension=extension.lstrip("."))

    def expect_directory(self, expected: bool) -> FileReaderConfig:
        return replace(self, directory=expected)

    def num_partitions_per_executor(self, n: int) -> FileReaderConfig:
        if n < 1:
            raise ValueError("the number of partitions must be positive")
        return replace(self, partitions_per_executor=n)


def _status(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.getFileStatus(p)


def _files(spark: SparkSession, config: FileReaderConfig) -> DataFrame:
    found = _status(spark, config.path)
    if config.directory is not None and found.isDirectory() != config.directory:
        raise NotADirectoryError(config.path) if config.directory else IsADirectoryError(config.path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if config.extension is not None:
        reader = reader.option("pathGlobFilter", f"*.{config.extension}")
    return reader.load(config.path)


def _tasks(spark: SparkSession, config: FileReaderConfig) -> int | None:
    """How many partitions are asked for; None leaves it to Spark, which packs files by size itself."""
    if config.partitions_per_executor is None:
        return None
    try:
        executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    except Exception:  # not every cluster manager tells
        executors = 1
    return config.partitions_per_executor * executors


#: Schemes that executors can read by themselves.
_OPENED = {"file", "hdfs", "s3", "s3a", "gs"}


def _listed(spark: SparkSession, config: FileReaderConfig) -> DataFrame:
    """(path, modificationTime, length) of the files; FileNotFoundError where none matches."""
    df = _files(spark, config).select("path", "modificationTime", "length")
    if df.limit(1).isEmpty():
        raise FileNotFoundError(f"no files match in {config.path}")
    return df


def _dealt(spark: SparkSession, listed: DataFrame, n: int) -> DataFrame:
    """The listed files in ``n`` partitions of balanced sizes at most.

    The driver packs names and sizes, which the scan has listed there already; only those are dealt out.
    """
    rows = sorted(listed.collect())
    order: dict[int, list] = {}
    for r in rows:
        order.setdefault(r["length"], []).append(r)
    groups = [[order[size].pop(0) for size in group] for group in packed([r["length"] for r in rows], n)]
    flat = [(k, *r) for k, group in enumerate(groups) for r in group]
    dealt = spark.createDataFrame(flat, "_group int, path string, modificationTime timestamp, length long")
    return dealt.repartitionById(len(groups), F.col("_group")).drop("_group")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for k, path in enumerate(batch.column(0).to_pylist()):
            scheme, _, rest = path.partition(":")
            if scheme == "file":
                system, name = fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")
            else:
                system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            with system.open_input_file(name) as f:
                content = f.read()
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], names=[*one.schema.names, "content"])


def read_bytes(spark: SparkSession, config: FileReaderConfig) -> DataFrame:
    """(path, modificationTime, length, content), one row per file; FileNotFoundError where no file matches.

    With a number of partitions asked for, names are packed by size and dealt out first, and contents are read where
    they are used, without a shuffle (on other file systems than ``_OPENED``: Spark's own packing, put together).
    """
    listed, n = _listed(spark, config), _tasks(spark, config)
    if n is None:
        return _files(spark, config)
    scheme = listed.first()["path"].partition(":")[0]
    if scheme not in _OPENED:
        return _files(spark, config).coalesce(n)
    dealt = _dealt(spark, listed, n)
    return dealt.mapInArrow(_opened, StructType([*dealt.schema.fields, StructField("content", BinaryType())]))


def read_paths(spark: SparkSession, config: FileReaderConfig) -> DataFrame:
    """(path), one row per file; contents are not read."""
    listed, n = _listed(spark, config), _tasks(spark, config)
    return (listed if n is None else _dealt(spark, listed, n)).select("path")


def read_source(spark: SparkSession, config: FileReaderConfig, decoder: Callable[[bytes], Iterable] | Column, schema: str | StructType | None = None) -> DataFrame:
    """Files run through a decoder: a Column over (path, content), or a closure from bytes to rows with a schema."""
    files = read_bytes(spark, config)
    if isinstance(decoder, Column):
        return files.select(decoder)
    if schema is None:
        raise ValueError("a closure needs a schema")
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for content in batch.column(0):
                rows = [r if isinstance(r, tuple) else (r,) for r in decoder(content.as_py())]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    return files.select("content").mapInArrow(run, target)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value), one row per line; the scan splits large files."""
    return spark.read.text(path)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Delimited text with a declared schema; no pass to infer it."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, only the columns that are asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def packed(sizes: list[int], partitions: int) -> list[list[int]]:
    """File sizes in at most ``partitions`` groups of balanced total size, largest first to the lightest group."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    groups: list[list[int]] = [[] for _ in range(min(partitions, max(1, len(sizes))))]
    heap = [(0, 0, k) for k in range(len(groups))]
    for s in sorted(sizes, reverse=True):
        total, n, k = heapq.heappop(heap)
        groups[k].append(s)
        heapq.heappush(heap, (total + s, n + 1, k))
    return [g for g in groups if g]
