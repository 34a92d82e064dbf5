"""Operators by key: aggregation, grouping, joins and co-grouping.

Keys are column names.  Nulls in keys are equal to each other, as in grouping; ``null_safe=False`` gives SQL's
join, where they match nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grouped(df: DataFrame, keys: list[str], aggs: list[Column], num_splits: int | None, partitioner: Column | None) -> DataFrame:
    """Aggregates per key in ``num_splits`` partitions, or in those that ``partitioner`` (an integer of the keys) names.

    One shuffle in each case.  A number up to the session's takes that many neighbouring partitions of the partial
    aggregates; more of them, or a partitioner, deal the rows out, and each partition is aggregated where it is.
    """
    if partitioner is not None:
        if not num_splits:
            raise ValueError("a partitioner needs the number of partitions")
        p = "_partition"
        dealt = df.withColumn(p, F.pmod(partitioner, F.lit(num_splits)).cast("int"))
        return dealt.repartitionById(num_splits, F.col(p)).groupBy(p, *keys).agg(*aggs).drop(p)
    if not num_splits:
        return df.groupBy(*keys).agg(*aggs)
    if num_splits <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.groupBy(*keys).agg(*aggs).coalesce(num_splits)
    return df.repartition(num_splits, *keys).groupBy(*keys).agg(*aggs)


def combine_by_key(df: DataFrame, keys: list[str], aggs: list[Column], num_splits: int | None = None, partitioner: Column | None = None) -> DataFrame:
    """Any aggregates per key, with partial aggregation before the shuffle (but see ``_grouped``)."""
    return _grouped(df, keys, aggs, num_splits, partitioner)


def reduce_by_key(df: DataFrame, keys: list[str], aggs: dict[str, str] | list[Column], num_splits: int | None = None, partitioner: Column | None = None) -> DataFrame:
    """``aggs``: column -> sum, min, max, ... (named after the column), or aggregate columns."""
    cols = [getattr(F, f)(c).alias(c) for c, f in aggs.items()] if isinstance(aggs, dict) else aggs
    return combine_by_key(df, keys, cols, num_splits, partitioner)


def reduce_by_key_py(df: DataFrame, key: str, value: str, f: Callable, num_splits: int | None = None) -> DataFrame:
    """An associative closure per key, combined before the shuffle; prefer ``reduce_by_key``."""
    pairs = df.select(key, value).rdd.map(tuple).reduceByKey(f, num_splits)
    return df.sparkSession.createDataFrame(pairs, df.select(key, value).schema)


def combine_by_key_py(df: DataFrame, key: str, value: str, create: Callable, merge_value: Callable, merge_combiners: Callable, schema: str, num_splits: int | None = None) -> DataFrame:
    """The create, merge-value and merge-combiners triple as closures; prefer ``combine_by_key``."""
    pairs = df.select(key, value).rdd.map(tuple).combineByKey(create, merge_value, merge_combiners, num_splits)
    return df.sparkSession.createDataFrame(pairs, schema)


def group_by_key(df: DataFrame, keys: list[str], value: str | Column, name: str = "values", ordered: bool = False, num_splits: int | None = None, partitioner: Column | None = None) -> DataFrame:
    """All values per key, in no order unless ``ordered``; nulls are kept.

    A key's values become one row, so this is for groups that fit a task; ``reduce_by_key`` is for the rest.
    """
    v = F.col(value) if isinstance(value, str) else value
    boxed = F.collect_list(F.struct(v.alias("v")))  # a struct, for collect_list leaves nulls out
    values = F.transform(F.array_sort(boxed) if ordered else boxed, lambda x: x["v"])
    return _grouped(df, keys, [values.alias(name)], num_splits, partitioner)


def group_by(df: DataFrame, key: str | Column, name: str = "key", items: str = "items", num_splits: int | None = None, partitioner: Column | None = None) -> DataFrame:
    """Rows grouped by a derived key: (key, array of rows); ``partitioner`` is an integer of the column ``name``."""
    k = (F.col(key) if isinstance(key, str) else key).alias(name)
    row = F.struct(*df.columns) if len(df.columns) > 1 else F.col(df.columns[0])
    keyed = df.select(k, row.alias(items))
    return _grouped(keyed, [name], [F.collect_list(items).alias(items)], num_splits, partitioner)


def count_by_value(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    """How often each row (or each value of ``columns``) stands; stays distributed."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias(name))


def average_by_key(df: DataFrame, keys: list[str | Column], value: Column, name: str) -> DataFrame:
    """Sum over count, in one partial and one final aggregation."""
    return df.groupBy(*keys).agg((F.sum(value).cast("double") / F.count("*")).alias(name))


# ------------------------------------------------------------------------------ joins
def join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = True, hint: str | None = None) -> DataFrame:
    """Equi-join: keys, left columns, right columns.  Strategy and skew are left to adaptive execution.

    Where neither side can hold a null key, ``null_safe`` plans the same as a plain join.
    """
    right = right.hint(hint) if hint else right
    nullable = any(left.schema[k].nullable and right.schema[k].nullable for k in keys)
    if not null_safe or not nullable:
        return left.join(right, keys, how)
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys))
    joined = left.join(r, on, how)
    if how in ("leftsemi", "left_semi", "semi", "leftanti", "left_anti", "anti"):
        return joined
    if how in ("full", "outer", "fullouter", "full_outer", "right", "rightouter", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    rest = [c for c in left.columns if c not in keys]
    return joined.select(*keys, *rest, *(c for c in right.columns if c not in keys))


def cogroup_many(frames: list[DataFrame], keys: list[str], values: list[str | Column], names: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Per key one array of values from each of n sides; a missing side is an empty array.

    All sides are shuffled once, together: they are tagged, united and grouped, and no join is needed.
    """
    names = names or [f"values_{i}" for i in range(len(frames))]
    tagged = []
    for i, (df, v) in enumerate(zip(frames, values, strict=True)):
        own = F.col(v) if isinstance(v, str) else v
        sides = [F.struct(own.alias("v")) if j == i else F.lit(None) for j in range(len(frames))]
        tagged.append(df.select(*keys, *(s.alias(f"_s{j}") for j, s in enumerate(sides))))
    # a typed null in each other side
    kinds = [t.schema[f"_s{i}"].dataType for i, t in enumerate(tagged)]
    tagged = [t.select(*keys, *(F.col(f"_s{j}").cast(kinds[j]).alias(f"_s{j}") for j in range(len(frames)))) for t in tagged]
    both = reduce(DataFrame.unionByName, tagged)

    def listed(j: int) -> Column:
        boxed = F.collect_list(f"_s{j}")
        return F.transform(F.array_sort(boxed) if ordered else boxed, lambda x: x["v"]).alias(names[j])

    return both.groupBy(*keys).agg(*(listed(j) for j in range(len(frames))))


def cogroup(left: DataFrame, right: DataFrame, keys: list[str], left_value: str | Column, right_value: str | Column, names: tuple[str, str] = ("left_values", "right_values")) -> DataFrame:
    return cogroup_many([left, right], keys, [left_value, right_value], list(names))


def cogroup_py(left: DataFrame, right: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """A closure over both sides' rows of a key, as pandas frames."""
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(f, schema)


def cartesian(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows.  The number of rows is the product, whatever plan is chosen."""
    return left.crossJoin(right)


def partition_by_key(df: DataFrame, keys: list[str], num_splits: int, drop_key: bool = True) -> DataFrame:
    """Rows of a key in one partition; the key itself goes, as only values are asked for."""
    out = df.repartition(num_splits, *keys)
    return out.drop(*keys) if drop_key else out


def partition_by_id(df: DataFrame, partition: str | Column, num_splits: int) -> DataFrame:
    """A user's own partitioner: an integer expression, taken modulo ``num_splits``."""
    e = F.col(partition) if isinstance(partition, str) else partition
    return df.repartitionById(num_splits, e.cast("int"))
