"""What a plan looks like: operators, dependencies, exchanges, pushed filters."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def formatted(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def _plan(df: DataFrame) -> str:
    """The physical plan; of an adaptive one that has run, only the final plan."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles and broadcasts of the physical plan."""
    return re.findall(r"\b(?:Broadcast)?Exchange [^\n]*", _plan(df))


def shuffles(df: DataFrame) -> int:
    return sum(not e.startswith("Broadcast") for e in exchanges(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", _plan(df))


def read_schema(df: DataFrame) -> list[str]:
    """The columns that each scan reads."""
    return re.findall(r"ReadSchema: struct<([^>]*)>", _plan(df))


def lineage(df: DataFrame) -> str:
    text = df.rdd.toDebugString()
    return text.decode() if isinstance(text, bytes) else text


def preferred_locations(df: DataFrame) -> list[list[str]]:
    """The hosts that hold each partition's input, where the source tells."""
    jrdd = df._jdf.queryExecution().toRdd()
    return [list(_seq(jrdd.preferredLocations(p))) for p in jrdd.partitions()]


def _seq(s):
    return (s.apply(i) for i in range(s.size()))


def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keeps results for later uses; partitions that are lost or do not fit are computed or read again."""
    return df.persist(level)


def named(df: DataFrame, description: str) -> DataFrame:
    """Names the jobs that follow in this thread."""
    df.sparkSession.sparkContext.setJobDescription(description)
    return df
