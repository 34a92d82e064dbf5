"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import aggregates, approx, keyed, ordering, partitioning, sampling, sets, transforms
from .sources import collections, files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return files.read_parquet(spark, f"{d}/{name}.parquet", *columns)


# ------------------------------------------------------------------------ projections
@query("select event_type, hour(ts) h, cast(sum(cast(value as decimal(18,2))) as double)/count(*) avg_value from events group by 1,2")
def avg_by_key_hour(spark, d):
    df = transforms.project(_t(spark, d, "events"), "event_type", exprs.hour_of("ts").alias("h"), F.col("value").cast("decimal(18,2)").alias("v"))
    return keyed.average_by_key(df, ["event_type", "h"], F.col("v"), "avg_value")


@query("select l_orderkey, l_linenumber, l_linenumber * 2 as doubled from lineitem")
def map_(spark, d):
    return transforms.project(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2).alias("doubled"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45")
def filter_(spark, d):
    return transforms.where(_t(spark, d, "lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select word, count(*) n from (select unnest(string_split(text, ' ')) word from documents) group by 1")
def flat_map(spark, d):
    return keyed.count_by_value(transforms.flat_map(_t(spark, d, "documents"), exprs.words("text"), "word"), "word", name="n")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45")
def map_partitions(spark, d):
    df = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return transforms.map_batches(df, lambda batches: (b.filter(pc.greater(b.column("l_quantity"), 45.0)) for b in batches))


@query("select n_regionkey % 3 as k, n_name from nation where n_nationkey > 4")
def map_partitions_rows(spark, d):
    """A closure over named tuples."""
    df = _t(spark, d, "nation")
    return transforms.map_partitions(df, lambda rows: ((r.n_regionkey % 3, r.n_name) for r in rows if r.n_nationkey > 4), "k int, n_name string")


@query("select * from (values (0, 3::bigint), (1, 7::bigint)) t(partition, total)")
def map_partitions_with_index(spark, d):
    return transforms.map_partitions_with_index(collections.int_range(spark, 1, 4, 1, 2), lambda i, rows: [(i, sum(r.id for r in rows))], "partition int, total long")


@query("select * from (values (0, 3::bigint), (1, 7::bigint)) t(partition, total)")
def aggregate_partitions(spark, d):
    return transforms.aggregate_partitions(collections.int_range(spark, 1, 4, 1, 2), F.sum("id").alias("total"))


@query("select * from (values (0, [1,2]::bigint[]), (1, [3,4]::bigint[])) t(partition, items)")
def glom(spark, d):
    return transforms.glom(collections.int_range(spark, 1, 4, 1, 2))


@query("select n_nationkey, n_name, n_nationkey * 10 as key from nation")
def key_by(spark, d):
    return transforms.key_by(_t(spark, d, "nation", "n_nationkey", "n_name"), F.col("n_nationkey") * 10)


@query("select o_custkey, lower(o_orderstatus) o_orderstatus from orders")
def map_values(spark, d):
    return transforms.map_values(_t(spark, d, "orders", "o_custkey", "o_orderstatus"), "o_orderstatus", F.lower("o_orderstatus"))


@query("select p_partkey, unnest(range(1, p_size % 5 + 2)) x from part")
def flat_map_values(spark, d):
    array = F.sequence(F.lit(1).cast("bigint"), (F.col("p_size") % 5 + 1).cast("bigint"))
    return transforms.flat_map_values(_t(spark, d, "part"), ["p_partkey"], array, "x")


@query("""select n.n_name, s.s_name from (select n_name, row_number() over (order by n_nationkey) k from nation) n
join (select s_name, row_number() over (order by s_suppkey) k from supplier) s using (k)""")
def zip_(spark, d):
    return transforms.zip_ordered(_t(spark, d, "nation", "n_name", "n_nationkey"), _t(spark, d, "supplier", "s_name", "s_suppkey"), ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


@query("select * from (values (1::bigint, 101::bigint), (2, 102), (4, 103)) t(a, b)")
def zip_partitions(spark, d):
    left = collections.int_range(spark, 1, 5, 1, 3).withColumnRenamed("id", "a")
    right = collections.int_range(spark, 101, 103, 1, 3).withColumnRenamed("id", "b")
    # partitions of 1, 2, 2 and 1, 1, 1 elements
    return transforms.zip_partitions(left, right)


# ------------------------------------------------------------------------------ joins
@query("select c_custkey, c_name, o_orderkey, o_totalprice from customer join orders on c_custkey = o_custkey")
def join(spark, d):
    right = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return keyed.join(_t(spark, d, "customer", "c_custkey", "c_name"), right, ["c_custkey"], null_safe=False)


@query("""select a.k, a.n_name, b.r_name from (select nullif(n_regionkey, 2) k, n_name from nation) a
join (select nullif(r_regionkey, 2) k, r_name from region) b on a.k is not distinct from b.k""")
def join_null_safe(spark, d):
    a = _t(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k"), "n_name")
    b = _t(spark, d, "region").select(F.nullif("r_regionkey", F.lit(2)).alias("k"), "r_name")
    return keyed.join(a, b, ["k"])


@query("""select k, coalesce(a, []::bigint[]) customers, coalesce(b, []::bigint[]) suppliers from
(select c_nationkey k, list(c_custkey order by c_custkey) a from customer group by 1)
full join (select s_nationkey k, list(s_suppkey order by s_suppkey) b from supplier group by 1) using (k)""")
def cogroup(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return keyed.cogroup(a, b, ["k"], "c_custkey", "s_suppkey", ("customers", "suppliers"))


@query("""select k, coalesce(list(v order by v) filter (side = 0), []::varchar[]) regions,
coalesce(list(v order by v) filter (side = 1), []::varchar[]) nations, coalesce(list(v order by v) filter (side = 2), []::varchar[]) suppliers
from (select r_regionkey k, r_name v, 0 side from region union all select n_regionkey, n_name, 1 from nation
union all select s_nationkey, s_name, 2 from supplier) group by k""")
def cogroup_3way(spark, d):
    r = _t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"))
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"))
    return keyed.cogroup_many([r, n, s], ["k"], ["v", "v", "v"], ["regions", "nations", "suppliers"])


@query("select n_name, r_name from nation cross join region")
def cartesian(spark, d):
    return keyed.cartesian(_t(spark, d, "nation", "n_name"), _t(spark, d, "region", "r_name"))


# ------------------------------------------------------------------------- aggregates
@query("select l_returnflag, cast(sum(l_linenumber) as bigint) total, count(*) n from lineitem group by 1")
def reduce_by_key(spark, d):
    return keyed.reduce_by_key(_t(spark, d, "lineitem"), ["l_returnflag"], [F.sum("l_linenumber").alias("total"), F.count("*").alias("n")])


@query("""select l_suppkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) total, count(*) n, min(l_quantity) low, max(l_quantity) high
from lineitem group by 1""")
def combine_by_key(spark, d):
    aggs = [exprs.exact_sum("l_quantity").alias("total"), F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")]
    return keyed.combine_by_key(_t(spark, d, "lineitem"), ["l_suppkey"], aggs)


@query("select n_regionkey, list(n_name order by n_name) names from nation group by 1")
def group_by_key(spark, d):
    return keyed.group_by_key(_t(spark, d, "nation"), ["n_regionkey"], "n_name", "names", ordered=True)


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) total from lineitem group by 1")
def reduce_by_key_using_partitioner(spark, d):
    return keyed.reduce_by_key(_t(spark, d, "lineitem"), ["l_returnflag"], [F.sum("l_linenumber").alias("total")], num_splits=4)


@query("select n_regionkey, list(n_name order by n_name) names from nation group by 1")
def group_by_key_using_partitioner(spark, d):
    return keyed.group_by_key(_t(spark, d, "nation"), ["n_regionkey"], "n_name", "names", ordered=True, num_splits=3)


@query("select substr(n_name, 1, 1) initial, list(n_name order by n_name) names from nation group by 1")
def group_by(spark, d):
    out = keyed.group_by(_t(spark, d, "nation", "n_name"), F.substring("n_name", 1, 1), "initial", "names")
    return out.select("initial", F.array_sort("names").alias("names"))


@query("select n_regionkey % 2 parity, list(n_nationkey order by n_nationkey) ids from nation group by 1")
def group_by_with_num_partitions(spark, d):
    out = keyed.group_by(_t(spark, d, "nation"), F.col("n_regionkey") % 2, "parity", "rows", num_splits=4)
    return out.select("parity", F.array_sort(F.col("rows")["n_nationkey"]).alias("ids"))


@query("select event_type, count(*) n from events group by 1")
def count_by_value(spark, d):
    return keyed.count_by_value(_t(spark, d, "events"), "event_type", name="n")


@query("select count(*) n from lineitem")
def count(spark, d):
    return aggregates.count_df(_t(spark, d, "lineitem"), "n")


@query("select cast(sum(l_linenumber) as bigint) total from lineitem")
def reduce(spark, d):
    return aggregates.reduce_df(_t(spark, d, "lineitem"), F.sum("l_linenumber").alias("total"))


@query("select cast(coalesce(sum(l_linenumber), 0) as bigint) total from lineitem")
def fold(spark, d):
    return aggregates.fold_df(_t(spark, d, "lineitem"), "l_linenumber", "sum", 0, "total")


@query("select count(*) n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) total, max(o_totalprice) high from orders")
def aggregate(spark, d):
    return aggregates.aggregate_df(_t(spark, d, "orders"), F.count("*").alias("n"), exprs.exact_sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("high"))


@query("select o_totalprice, o_orderkey from orders order by 1 desc, 2 desc limit 1")
def max_(spark, d):
    return aggregates.max_df(_t(spark, d, "orders"), "o_totalprice", "o_orderkey").select("value.*")


@query("select o_totalprice, o_orderkey from orders order by 1, 2 limit 1")
def min_(spark, d):
    return aggregates.min_df(_t(spark, d, "orders"), "o_totalprice", "o_orderkey").select("value.*")


@query("select count(*) = 0 is_empty from orders where o_totalprice < 0")
def is_empty(spark, d):
    return aggregates.is_empty_df(_t(spark, d, "orders").where("o_totalprice < 0"))


# ----------------------------------------------------------------------- set operations
@query("select c_nationkey k from customer union all select s_nationkey from supplier")
def union(spark, d):
    return sets.union(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey k from customer union all select s_nationkey from supplier union all select n_nationkey from nation")
def union_many(spark, d):
    return sets.union_many([_t(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))])


@query("select k, count(*) n from (select o_custkey k from orders union all select c_custkey from customer) group by 1")
def union_partitioned(spark, d):
    a = _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).repartition(8, "k")
    b = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).repartition(8, "k")
    return keyed.count_by_value(sets.union(a, b), name="n")


@query("select distinct l_partkey, l_suppkey from lineitem")
def distinct(spark, d):
    return sets.distinct(_t(spark, d, "lineitem", "l_partkey", "l_suppkey"))


@query("select distinct l_suppkey from lineitem")
def distinct_with_num_partitions(spark, d):
    return sets.distinct(_t(spark, d, "lineitem", "l_suppkey"), 2)


@query("select c_nationkey k from customer intersect select s_nationkey from supplier")
def intersection(spark, d):
    return sets.intersection(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey"))


@query("select c_custkey k from customer except select o_custkey from orders")
def subtract(spark, d):
    return sets.subtract(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select("o_custkey"))


# --------------------------------------------------------------------- order and limits
@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10")
def top(spark, d):
    return ordering.top_df(_t(spark, d, "orders", "o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10")
def take_ordered(spark, d):
    return ordering.take_ordered_df(_t(spark, d, "orders", "o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey")


@query("select event_id, event_type from events order by event_id limit 7")
def take(spark, d):
    return ordering.take_df(_t(spark, d, "events", "event_id", "event_type").orderBy("event_id"), 7)


@query("select event_id, event_type from events order by event_id limit 1")
def first(spark, d):
    return spark.createDataFrame([ordering.first(_t(spark, d, "events", "event_id", "event_type").orderBy("event_id"))], "event_id long, event_type string")


@query("select n_nationkey, n_name from nation")
def collect(spark, d):
    return spark.createDataFrame(ordering.collect(_t(spark, d, "nation", "n_nationkey", "n_name")), "n_nationkey int, n_name string")


# ------------------------------------------------------------------------- partitioning
@query("select range id from range(1, 13)")
def range_(spark, d):
    return collections.int_range(spark, 1, 12, 1, 3)


@query("select unnest([1, 2, 3, 4]::bigint[]) as value")
def make_rdd(spark, d):
    return collections.from_items(spark, [1, 2, 3, 4], "value long", 2)


@query("select * from (values (0, 20::bigint), (1, 20), (2, 20), (3, 20), (4, 21)) t(partition, n)")
def coalesce(spark, d):
    return partitioning.partition_sizes(partitioning.coalesce(spark.range(0, 101, 1, 101), 5))


@query("select 100 partitions, count(*) n from nation")
def repartition(spark, d):
    df = partitioning.repartition(_t(spark, d, "nation"), 100)
    return df.agg(F.count("*").alias("n")).select(F.lit(partitioning.number_of_splits(df)).alias("partitions"), "n")


@query("select o_orderkey from orders")
def partition_by_key(spark, d):
    return keyed.partition_by_key(_t(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], 8)


@query("select n_nationkey % 3 partition, count(*) n from nation group by 1")
def partition_by_id(spark, d):
    return partitioning.partition_sizes(keyed.partition_by_id(_t(spark, d, "nation"), "n_nationkey", 3))


# ------------------------------------------------------------------------------ samples
@query("select o_orderkey from orders")
def sample_invariant(spark, d):
    return sampling.sample(_t(spark, d, "orders", "o_orderkey"), False, 1.0, 1)


@query("select 80 n, 80 n_distinct, 80::bigint n_repeated")
def take_sample_size(spark, d):
    df = _t(spark, d, "orders", "o_orderkey")
    once = sampling.take_sample_df(df, False, 80, 1).agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("n_distinct"))
    return once.crossJoin(sampling.take_sample_df(df, True, 80, 1).agg(F.count("*").alias("n_repeated")))


@query("select o_orderkey, 1::bigint n from orders")
def random_split_invariant(spark, d):
    return keyed.count_by_value(sets.union_many(sampling.random_split(_t(spark, d, "orders", "o_orderkey"), [1, 2, 3], 5)), name="n")


# ------------------------------------------------------------------- approximate counts
@query("select cast(count(*) as double) mean, 1::double confidence, cast(count(*) as double) low, cast(count(*) as double) high from events")
def count_approx(spark, d):
    return approx.count_approx_df(_t(spark, d, "events", "event_id"))


@query("""select event_type, cast(count(*) as double) mean, 1::double confidence, cast(count(*) as double) low, cast(count(*) as double) high
from events group by 1""")
def count_by_value_approx(spark, d):
    return approx.count_by_value_approx_df(_t(spark, d, "events", "event_type"))


@query(f"select 0::double mean, 0::double confidence, 0::double low, {sys.float_info.max!r}::double high")
def count_approx_empty(spark, d):
    return approx.count_approx_df(_t(spark, d, "events", "event_id").limit(0))


# -------------------------------------------------------------------------------- files
@query("select c_custkey, c_acctbal from customer")
def parquet_columns(spark, d):
    return files.read_parquet(spark, f"{d}/customer.parquet", "c_custkey", "c_acctbal")


# ------------------------------------------------------------------- further catalogues
from . import queries_io, queries_more  # noqa: E402, F401  (they register their queries)
