"""Random samples and splits.  Samplers are unbiased, and a seed fixes them for a given partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def sample(df: DataFrame, with_replacement: bool, fraction: float, seed: int | None = None) -> DataFrame:
    if fraction < 0 or (fraction > 1 and not with_replacement):
        raise ValueError("fraction must be in [0, 1], or not negative with replacement")
    return df.sample(withReplacement=with_replacement, fraction=fraction, seed=seed)


def sample_rate(n: int, total: int, miss: float = 1e-4) -> float:
    """A rate at which drawing ``total`` rows with replacement gives ``n`` or more but for a chance of ``miss``.

    The number drawn is a Poisson count, which is below n with at most exp(n - mean - n log(n / mean)); the mean is
    the least for which that is ``miss``.
    """
    low, high = float(n), 2.0 * n + 40
    for _ in range(60):
        mean = (low + high) / 2
        low, high = (mean, high) if mean - n + n * math.log(n / mean) < -math.log(miss) else (low, mean)
    return high / total


def take_sample_df(df: DataFrame, with_replacement: bool, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows in random order (all of them, if there are fewer and none may repeat)."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    if not with_replacement:
        return df.orderBy(F.rand(seed)).limit(n)  # a heap of n rows per task, no full sort
    total = df.count()
    if total == 0:
        return df.limit(0)
    rate = sample_rate(n, total)
    for k in range(100):  # each try falls short with a chance of 1e-4
        got = df.sample(withReplacement=True, fraction=rate, seed=seed + k)
        if got.limit(n).count() >= n:
            return got.orderBy(F.rand(seed)).limit(n)
    raise RuntimeError("no sample was large enough")


def take_sample(df: DataFrame, with_replacement: bool, n: int, seed: int = 0) -> list[Row]:
    return take_sample_df(df, with_replacement, n, seed).collect()


def random_split(df: DataFrame, weights: list[float], seed: int | None = None) -> list[DataFrame]:
    """Disjoint parts that together are the whole, in sizes after ``weights``."""
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and their sum must be positive")
    return df.randomSplit([float(w) for w in weights], seed)


def shuffled(df: DataFrame, seed: int | None = None) -> DataFrame:
    """All rows in random order."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())
