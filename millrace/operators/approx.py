"""Counts within a time limit: what is known at the limit, and the exact value later.

Built on the JVM's approximate jobs, so a classic (not a Connect) session is needed.
"""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounded:
    """An estimate with an interval that holds the true value with probability ``confidence``."""

    mean: float
    confidence: float
    low: float
    high: float


def _bounded(j) -> Bounded:
    return Bounded(j.mean(), j.confidence(), j.low(), j.high())


class PartialResult:
    """An answer that may still be partial; ``get_final_value`` waits for the exact one, or raises if its job fails.

    The JVM's own object waits for ever where a job fails after the time limit, so the job's state is asked for.
    """

    def __init__(self, df: DataFrame, start: Callable, convert: Callable):
        sc = df.sparkSession.sparkContext
        self._status, self._group, self._convert = sc.statusTracker(), f"approx-{uuid.uuid4().hex}", convert
        held = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        sc.setJobGroup(self._group, "approximate count")
        try:
            self._jvm = start(df._jdf.toJavaRDD())
        finally:
            for k, v in held.items():
                sc.setLocalProperty(k, v)

    @property
    def initial_value(self):
        return self._convert(self._jvm.initialValue())

    @property
    def is_final(self) -> bool:
        return bool(self._jvm.isInitialValueFinal())

    def _failed(self) -> bool:
        """Waits for the end of the job."""
        while not self.is_final:
            states = [j.status for i in self._status.getJobIdsForGroup(self._group) if (j := self._status.getJobInfo(i))]
            if "FAILED" in states:
                return True
            if states and all(x == "SUCCEEDED" for x in states):
                return False
            time.sleep(0.02)
        return False

    def get_final_value(self):
        if self._failed():
            raise RuntimeError("the job of an approximate count failed")
        return self._convert(self._jvm.getFinalValue())

    def on_complete(self, handler: Callable) -> PartialResult:
        """Call ``handler`` with the exact value, on a thread of its own."""
        return self._then(handler, None)

    def on_fail(self, handler: Callable) -> PartialResult:
        """Call ``handler`` with the error of a job that failed, on a thread of its own."""
        return self._then(None, handler)

    def _then(self, complete: Callable | None, fail: Callable | None) -> PartialResult:
        def run() -> None:
            try:
                value = self.get_final_value()
            except Exception as e:  # whatever it is, it is the handler's
                if fail:
                    fail(e)
            else:
                if complete:
                    complete(value)

        threading.Thread(target=run, daemon=True).start()
        return self


def _check(confidence: float) -> None:
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must be in [0, 1]")


def count_approx(df: DataFrame, timeout_ms: int, confidence: float = 0.95, unknown_when_zero: bool = True) -> PartialResult:
    """The number of rows.  With ``unknown_when_zero`` a count of 0 is (0, 0, 0, largest float), known or not."""
    _check(confidence)

    def convert(j) -> Bounded:
        b = _bounded(j)
        return Bounded(0.0, 0.0, 0.0, sys.float_info.max) if unknown_when_zero and b.mean == 0 else b

    return PartialResult(df, lambda rdd: rdd.countApprox(timeout_ms, confidence), convert)


def count_by_value_approx(df: DataFrame, timeout_ms: int, confidence: float = 0.95) -> PartialResult:
    """The number of each distinct row: {tuple of values: Bounded}.

    The result is a map on the driver; for many distinct rows use ``count_by_value``.
    """
    _check(confidence)

    def convert(j) -> dict:
        out = {}
        for entry in j.entrySet():
            row = entry.getKey()
            out[tuple(row.get(i) for i in range(row.size()))] = _bounded(entry.getValue())
        return out

    return PartialResult(df, lambda rdd: rdd.countByValueApprox(timeout_ms, confidence), convert)


def count_approx_df(df: DataFrame, timeout_ms: int = 1000, confidence: float = 0.95) -> DataFrame:
    """The exact value that the approximate count ends with, as a row."""
    b = count_approx(df, timeout_ms, confidence).get_final_value()
    return df.sparkSession.createDataFrame([(b.mean, b.confidence, b.low, b.high)], "mean double, confidence double, low double, high double")


def count_by_value_approx_df(df: DataFrame, timeout_ms: int = 1000, confidence: float = 0.95, most: int = 100_000) -> DataFrame:
    """The exact values that the approximate counts end with.

    They pass through the driver, so a table of more than about ``most`` distinct rows is refused; those are for
    ``keyed.count_by_value``.
    """
    found = df.agg(F.approx_count_distinct(F.struct(*df.columns))).first()[0]
    if found > 1.2 * most:
        raise ValueError(f"about {found} distinct rows; use count_by_value")
    got = count_by_value_approx(df, timeout_ms, confidence).get_final_value()
    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    rows = [(*k, b.mean, b.confidence, b.low, b.high) for k, b in got.items()]
    return df.sparkSession.createDataFrame(rows, f"{fields}, mean double, confidence double, low double, high double")
