"""A table with the engine's operators as methods."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import DataFrame

from .operators import aggregates, approx, keyed, ordering, partitioning, sampling, sets, transforms
from .sources import sinks


class Collection:
    """Wraps a DataFrame; every operator whose first argument is a table is a method of the same name.

    Tables among the other arguments may be Collections, and results that are tables are Collections again.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def __repr__(self) -> str:
        return f"Collection[{self.df.schema.simpleString()}]"

    @property
    def columns(self) -> list[str]:
        return self.df.columns


def _bare(x):
    if isinstance(x, Collection):
        return x.df
    return [_bare(y) for y in x] if isinstance(x, list) else x


def _boxed(x):
    if isinstance(x, DataFrame):
        return Collection(x)
    return [_boxed(y) for y in x] if isinstance(x, list) and x and isinstance(x[0], DataFrame) else x


def _method(f):
    @functools.wraps(f)
    def call(self, *args, **kwargs):
        return _boxed(f(self.df, *map(_bare, args), **{k: _bare(v) for k, v in kwargs.items()}))

    return call


for _module in (transforms, keyed, aggregates, sets, ordering, partitioning, sampling, approx, sinks):
    for _name, _f in inspect.getmembers(_module, inspect.isfunction):
        _first = next(iter(inspect.signature(_f).parameters), None)
        if not _name.startswith("_") and _f.__module__ == _module.__name__ and _first in ("df", "left"):
            setattr(Collection, _name, _method(_f))
