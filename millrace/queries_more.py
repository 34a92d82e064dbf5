"""Named queries of closures, partitioners, samplers, partial results and errors."""

from __future__ import annotations

import time

import pyarrow.compute as pc
from pyspark.sql import functions as F

from .operators import aggregates, approx, keyed, ordering, partitioning, sampling, sets, transforms
from .queries import _t, query
from .sources import collections


# ------------------------------------------------------------------------------ closures
@query("select n_nationkey * 2 + 1 as x, reverse(n_name) as name from nation")
def map_py(spark, d):
    return transforms.map_py(_t(spark, d, "nation"), lambda r: (r.n_nationkey * 2 + 1, r.n_name[::-1]), "x int, name string")


@query("select n_nationkey, n_name from nation where length(n_name) % 2 = 1")
def filter_py(spark, d):
    return transforms.filter_py(_t(spark, d, "nation", "n_nationkey", "n_name"), lambda r: len(r.n_name) % 2 == 1)


@query("select unnest(range(1, n_nationkey % 4 + 1)) as x, n_name from nation")
def flat_map_py(spark, d):
    return transforms.flat_map_py(_t(spark, d, "nation"), lambda r: [(x, r.n_name) for x in range(1, r.n_nationkey % 4 + 1)], "x long, n_name string")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000")
def map_batches(spark, d):
    """A closure over Arrow batches."""
    df = _t(spark, d, "orders", "o_orderkey", "o_totalprice")

    def large(batches):
        return (b.filter(pc.greater(b.column("o_totalprice"), 200000.0)) for b in batches)

    return transforms.map_batches(df, large)


@query("select max(n_nationkey) as high, string_agg(n_name, '' order by n_name) as names from nation")
def reduce_py(spark, d):
    df = _t(spark, d, "nation", "n_nationkey", "n_name")
    high = aggregates.reduce_py(df, lambda a, b: a if a.n_nationkey > b.n_nationkey else b).n_nationkey
    names = aggregates.reduce_py(df.select("n_name").orderBy("n_name"), lambda a, b: (a[0] + b[0],))[0]
    return collections.from_items(spark, [(high, names)], "high int, names string", 1)


@query("select (select cast(sum(n_nationkey) as bigint) from nation) as neutral, 10 + 3 * 5::bigint as counted")
def fold_py(spark, d):
    """A start that is not neutral counts once per partition and once more."""
    neutral = aggregates.fold_py(_t(spark, d, "nation", "n_nationkey"), 0, lambda a, x: a + x)
    counted = aggregates.fold_py(collections.int_range(spark, 1, 4, 1, 2), 5, lambda a, x: a + x)
    return collections.from_items(spark, [(neutral, counted)], "neutral long, counted long", 1)


@query("select n_regionkey, count(*) n from nation group by 1")
def aggregate_py(spark, d):
    """A map of counts, merged over partitions."""

    def add(counts, row):
        counts[row.n_regionkey] = counts.get(row.n_regionkey, 0) + 1
        return counts

    def merge(a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    got = aggregates.aggregate_py(_t(spark, d, "nation", "n_regionkey", "n_name").repartition(3), {}, add, merge)
    return collections.from_items(spark, sorted(got.items()), "n_regionkey int, n long", 1)


@query("select c_nationkey k, max(c_custkey) v from customer group by 1")
def reduce_by_key_py(spark, d):
    return keyed.reduce_by_key_py(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")), "k", "v", max)


@query("select c_nationkey k, count(*) n, min(c_custkey) low from customer group by 1")
def combine_by_key_py(spark, d):
    df = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    pairs = keyed.combine_by_key_py(df, "k", "v", lambda v: (1, v), lambda a, v: (a[0] + 1, min(a[1], v)), lambda a, b: (a[0] + b[0], min(a[1], b[1])), "k int, c struct<n: bigint, low: bigint>")
    return pairs.select("k", "c.n", "c.low")


@query("""select coalesce(a.k, b.k) k, coalesce(a.n, 0) customers, coalesce(b.n, 0) suppliers from (select c_nationkey k, count(*) n from customer group by 1) a
full join (select s_nationkey k, count(*) n from supplier group by 1) b on a.k = b.k""")
def cogroup_py(spark, d):
    import pandas as pd

    a = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))

    def both(left, right):
        return pd.DataFrame({"k": [(left if len(left) else right)["k"].iloc[0]], "customers": [len(left)], "suppliers": [len(right)]})

    return keyed.cogroup_py(a, b, ["k"], both, "k int, customers long, suppliers long")


# --------------------------------------------------------------------------- partitioners
_BY_FIVE = "select n_regionkey % 2 as partition, count(*) n from (select distinct n_regionkey from nation) group by 1"


@query(_BY_FIVE)
def reduce_by_key_partitioner(spark, d):
    """Where the user's partitioner puts each key."""
    out = keyed.reduce_by_key(_t(spark, d, "nation"), ["n_regionkey"], [F.count("*").alias("c")], 2, F.col("n_regionkey"))
    return partitioning.partition_sizes(out)


@query(_BY_FIVE)
def group_by_key_partitioner(spark, d):
    return partitioning.partition_sizes(keyed.group_by_key(_t(spark, d, "nation"), ["n_regionkey"], "n_name", num_splits=2, partitioner=F.col("n_regionkey")))


@query("select ascii(k) % 3 as partition, count(*) n from (select distinct substr(n_name, 1, 1) k from nation) group by 1")
def group_by_with_partitioner(spark, d):
    return partitioning.partition_sizes(keyed.group_by(_t(spark, d, "nation"), F.substring("n_name", 1, 1), num_splits=3, partitioner=F.ascii("key")))


@query("select 5 partitions, 101::bigint n")
def coalesce_with_shuffle(spark, d):
    df = partitioning.coalesce(spark.range(0, 101, 1, 2), 5, shuffle=True)
    return df.agg(F.count("*").alias("n")).select(F.lit(partitioning.number_of_splits(df)).alias("partitions"), "n")


# ---------------------------------------------------------------------------- set operations
@query("select c_nationkey k, c_mktsegment s from customer except select s_nationkey, 'BUILDING' from supplier")
def subtract_some(spark, d):
    right = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("BUILDING").alias("s"))
    return sets.subtract(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")), right)


@query("select unnest([0, 1, 2, 10, 12, 19]::bigint[]) as value, true as few")
def subtract_with_num_partitions(spark, d):
    a, b = ([1, 2, 3, 4, 5, 10, 12, 13, 19, 0], [3, 4, 5, 6, 7, 8, 11, 13])
    out = sets.subtract(collections.from_items(spark, a, num_slices=3), collections.from_items(spark, b, num_slices=2), 2)
    return out.withColumn("few", F.lit(partitioning.number_of_splits(out) <= 2))


@query("select unnest([3, 4, 5, 13]::bigint[]) as value, true as few")
def intersection_with_num_partitions(spark, d):
    a, b = ([1, 2, 3, 4, 5, 10, 12, 13, 19, 0, 3], [3, 4, 5, 6, 7, 8, 11, 13, 13])
    out = sets.intersection(collections.from_items(spark, a, num_slices=3), collections.from_items(spark, b, num_slices=2), 2)
    return out.withColumn("few", F.lit(partitioning.number_of_splits(out) <= 2))


# --------------------------------------------------------------------------------- samples
@query("select true as within, 0::bigint as repeated, 0::bigint as foreign_rows")
def sample_bernoulli(spark, d):
    """A tenth of the orders, each once at most, as many as chance allows (6 standard deviations)."""
    df = _t(spark, d, "orders", "o_orderkey")
    n = df.count()
    got = sampling.sample(df, False, 0.1, 11)
    out = got.agg((F.abs(F.count("*") - 0.1 * n) < 6 * (0.09 * n) ** 0.5).alias("within"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"))
    return out.withColumn("foreign_rows", F.lit(got.join(df, "o_orderkey", "left_anti").count()))


@query("select true as within, true as repeats, true as spread")
def sample_poisson(spark, d):
    """Twice as many rows, drawn with replacement; a share of exp(-2) is never drawn."""
    df = _t(spark, d, "orders", "o_orderkey")
    n = df.count()
    got = keyed.count_by_value(sampling.sample(df, True, 2.0, 7), name="c")
    drawn, rows = F.sum("c"), F.count("*")
    missed = 0.1353352832
    return got.agg(
        (F.abs(drawn - 2 * n) < 6 * (2 * n) ** 0.5).alias("within"), (F.max("c") > 1).alias("repeats"), (F.abs(n - rows - missed * n) < 6 * (missed * n) ** 0.5).alias("spread")
    )


@query("select true as within, count(*) n from orders")
def random_split_sizes(spark, d):
    """Parts in sizes after their weights."""
    df = _t(spark, d, "orders", "o_orderkey")
    n = df.count()
    sizes = [g.count() for g in sampling.random_split(df, [1, 2, 3], 5)]
    within = all(abs(s - n * w / 6) < 6 * (n * w / 6) ** 0.5 for s, w in zip(sizes, (1, 2, 3), strict=True))
    return collections.from_items(spark, [(within, sum(sizes))], "within boolean, n long", 1)


@query("select o_orderkey, true as moved from orders")
def shuffle_rows(spark, d):
    """All rows in another order."""
    df = _t(spark, d, "orders", "o_orderkey")
    before, after = ([r[0] for r in ordering.take(x, 50)] for x in (df, sampling.shuffled(df, 3)))
    return sampling.shuffled(df, 3).withColumn("moved", F.lit(before != after))


# ------------------------------------------------------------------------- partial results
@query("select true as early, true as held, count(*) as final from nation")
def partial_count(spark, d):
    """At the limit only some partitions have counted: not final, with an interval that holds the count."""
    df = transforms.map_batches(_t(spark, d, "nation", "n_nationkey").repartition(8), _slowly)
    got = approx.count_approx(df, 1, 0.9)
    early, initial, final = not got.is_final, got.initial_value, got.get_final_value()
    return collections.from_items(spark, [(early, initial.low <= final.mean <= initial.high, int(final.mean))], "early boolean, held boolean, final long", 1)


def _slowly(batches):
    time.sleep(0.2)
    yield from batches


@query("select 'complete' as what, cast(count(*) as varchar) as got from nation union all select 'fail', 'true'")
def partial_result_handlers(spark, d):
    """The handlers of a job that ends and of one that fails."""
    held: dict[str, str] = {}
    approx.count_approx(_t(spark, d, "nation"), 1).on_complete(lambda b: held.update(complete=str(int(b.mean))))

    def broken(batches):
        time.sleep(1)
        raise ValueError("broken on purpose")

    approx.count_approx(transforms.map_batches(_t(spark, d, "region"), broken), 1).on_fail(lambda e: held.update(fail=str(isinstance(e, RuntimeError)).lower()))
    for _ in range(600):
        if len(held) == 2:
            break
        time.sleep(0.1)
    return collections.from_items(spark, sorted(held.items()), "what string, got string", 1)


# ---------------------------------------------------------------------------------- errors
@query("""select * from (values ('first of nothing', 'ValueError'), ('fold with a start', 'ValueError'), ('fraction above 1', 'ValueError'), ('no weights', 'ValueError'),
('negative weight', 'ValueError'), ('confidence above 1', 'ValueError'), ('no tables', 'ValueError'), ('step of 0', 'ValueError'), ('too many values', 'ValueError')) t(what, raised)""")
def errors(spark, d):
    from .queries_io import _raised

    df = _t(spark, d, "nation", "n_nationkey")
    cases = {
        "first of nothing": lambda: ordering.first(df.limit(0)),
        "fold with a start": lambda: aggregates.fold_df(df, "n_nationkey", "sum", 1),
        "fraction above 1": lambda: sampling.sample(df, False, 1.5),
        "no weights": lambda: sampling.random_split(df, []),
        "negative weight": lambda: sampling.random_split(df, [1, -1]),
        "confidence above 1": lambda: approx.count_approx(df, 1, 2.0),
        "no tables": lambda: sets.union_many([]),
        "step of 0": lambda: collections.int_range(spark, 1, 2, 0),
        "too many values": lambda: approx.count_by_value_approx_df(df, most=5),
    }
    return collections.from_items(spark, [(k, _raised(f)) for k, f in cases.items()], "what string, raised string", 1)
