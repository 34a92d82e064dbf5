"""A collection engine on Spark DataFrames: sources, operators, plans and sinks.

Operators are functions from DataFrames and Column expressions to DataFrames, so Catalyst plans all of them;
``Collection`` offers the same functions as methods.  Variants that end in ``_py`` take Python closures and a
schema.
"""

from .collection import Collection
from .session import get_spark

__all__ = ["Collection", "get_spark"]
