import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace import Collection
from millrace.operators import aggregates, approx, keyed, ordering, partitioning, sampling, sets, transforms
from millrace.plans import inspect
from millrace.sources.collections import from_items, int_range

A, B = [1, 2, 3, 4, 5, 10, 12, 13, 19, 0], [3, 4, 5, 6, 7, 8, 11, 13]


def items(spark, xs, n=2, kind="value long"):
    return from_items(spark, xs, kind, n)


def values(df):
    return [r[0] for r in df.collect()]


# ------------------------------------------------------------------------ narrow operators
def test_map_filter_flat_map(spark):
    nums = items(spark, [13, 28, 3, 4, 51, 103, 12, 113, 19])
    assert values(transforms.where(nums, F.col("value") > 100)) == [103, 113]
    assert values(transforms.filter_py(nums, lambda r: r.value > 100)) == [103, 113]
    small = items(spark, [1, 2, 3, 4])
    assert values(transforms.project(small, F.col("value") * 2)) == [2, 4, 6, 8]
    assert values(transforms.map_py(small, lambda r: r.value * 2, "v long")) == [2, 4, 6, 8]
    want = [1, 1, 2, 1, 2, 3, 1, 2, 3, 4]
    assert values(transforms.flat_map(small, F.sequence(F.lit(1), F.col("value")))) == want
    assert values(transforms.flat_map_py(small, lambda r: range(1, r.value + 1), "v long")) == want


def test_partitions(spark):
    df = items(spark, [1, 2, 3, 4])
    assert values(transforms.map_partitions(df, lambda rows: [sum(r.value for r in rows)], "v long")) == [3, 7]
    assert [tuple(r) for r in transforms.map_partitions_with_index(df, lambda i, rows: [(i, len(list(rows)))], "i int, n long").collect()] == [(0, 2), (1, 2)]
    assert [r.items for r in transforms.glom(df).orderBy("partition").collect()] == [[1, 2], [3, 4]]
    sparse = items(spark, [1], 3)
    got = transforms.glom(sparse, empty=True).orderBy("partition").collect()
    assert sorted(map(len, (r.items for r in got))) == [0, 0, 1]


def test_keys(spark):
    assert [tuple(r) for r in transforms.key_by(items(spark, [3, 4, 5]), F.col("value") * 10).collect()] == [(3, 30), (4, 40), (5, 50)]
    pairs = items(spark, [("a", 1), ("b", 2)], kind="k string, v long")
    assert [tuple(r) for r in transforms.map_values(pairs, "v", F.col("v") + 1).collect()] == [("a", 2), ("b", 3)]
    assert [tuple(r) for r in transforms.flat_map_values(pairs, ["k"], F.sequence(F.lit(1), F.col("v"))).collect()] == [("a", 1), ("b", 1), ("b", 2)]


def test_zip(spark):
    left = items(spark, [1, 2, 3, 4, 5], 3, "a int")
    right = items(spark, ["5a", "4b", "3c", "2d", "1a"], 3, "b string")
    want = [(1, "5a"), (2, "4b"), (3, "3c"), (4, "2d"), (5, "1a")]
    assert sorted(tuple(r) for r in transforms.zip_partitions(left, right).collect()) == want
    # each partition is cut to the shorter
    short = int_range(spark, 101, 103, 1, 3).toDF("b")
    assert sorted(tuple(r) for r in transforms.zip_partitions(int_range(spark, 1, 5, 1, 3).toDF("a"), short).collect()) == [(1, 101), (2, 102), (4, 103)]
    ordered = transforms.zip_ordered(left, right, [F.col("a").desc()], ["b"])
    assert sorted(tuple(r) for r in ordered.collect()) == [(1, "5a"), (2, "4b"), (3, "3c"), (4, "2d"), (5, "1a")]


# ----------------------------------------------------------------------------------- keyed
def test_reduce_and_combine(spark):
    pairs = items(spark, [("a", 1), ("b", 2), ("a", 2), ("c", 5), ("a", 3)], kind="k string, v long")
    want = {"a": 6, "b": 2, "c": 5}
    assert dict(map(tuple, keyed.reduce_by_key(pairs, ["k"], {"v": "sum"}).collect())) == want
    assert dict(map(tuple, keyed.reduce_by_key(pairs, ["k"], {"v": "sum"}, num_splits=3).collect())) == want
    assert dict(map(tuple, keyed.reduce_by_key_py(pairs, "k", "v", lambda x, y: x + y, 2).collect())) == want
    got = keyed.combine_by_key_py(pairs, "k", "v", lambda v: [v], lambda a, v: [*a, v], lambda a, b: a + b, "k string, vs array<long>", 2)
    assert {k: sorted(v) for k, v in map(tuple, got.collect())} == {"a": [1, 2, 3], "b": [2], "c": [5]}


def test_grouping(spark):
    rows = [("x", i) for i in range(1, 8)] + [("y", i) for i in range(1, 9)]
    got = keyed.group_by_key(items(spark, rows, 4, "k string, v long"), ["k"], "v", ordered=True).collect()
    assert {r.k: r["values"] for r in got} == {"x": list(range(1, 8)), "y": list(range(1, 9))}
    nulls = items(spark, [(None, None), (None, 1)], 2, "k string, v long")
    assert keyed.group_by_key(nulls, ["k"], "v", ordered=True).collect() == [Row(k=None, values=[None, 1])]
    sign = F.when(F.col("value") < 0, "neg").when(F.col("value") > 0, "pos").otherwise("zero")
    got = keyed.group_by(items(spark, range(-3, 4)), sign).collect()
    assert {r.key: sorted(r["items"]) for r in got} == {"neg": [-3, -2, -1], "zero": [0], "pos": [1, 2, 3]}
    counts = keyed.count_by_value(items(spark, [1, 2, 1, 3, 2, 3, 3, 2, 3], 4)).collect()
    assert {r.value: r["count"] for r in counts} == {1: 2, 2: 3, 3: 4}


def test_joins(spark):
    left = items(spark, [(1, "A", "x"), (2, "B", "y"), (3, "C", "z"), (4, "D", "w")], 2, "k int, a string, b string")
    right = items(spark, [(i, f"{i}{c}") for i in (1, 2, 3) for c in "pq"], 2, "k int, w string")
    got = keyed.join(left, right, ["k"]).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"k", "a", "b", "w"} and {r.k for r in got} == {1, 2, 3}
    nul = items(spark, [(None, "n"), (1, "m")], 1, "k int, a string"), items(spark, [(None, "p"), (2, "q")], 1, "k int, w string")
    assert [tuple(r) for r in keyed.join(*nul, ["k"]).collect()] == [(None, "n", "p")]
    assert keyed.join(*nul, ["k"], null_safe=False).count() == 0
    assert sorted((tuple(r) for r in keyed.join(*nul, ["k"], how="full").collect()), key=str) == [(1, "m", None), (2, None, "q"), (None, "n", "p")]
    assert keyed.join(*nul, ["k"], how="left_anti").collect() == [Row(k=1, a="m")]


def test_cogroup(spark):
    a = items(spark, [(1, 10), (1, 11), (2, 20)], 2, "k int, v int")
    b = items(spark, [(1, "x"), (3, "z"), (None, "n")], 2, "k int, w string")
    got = {r.k: (r.left_values, r.right_values) for r in keyed.cogroup(a, b, ["k"], "v", "w").collect()}
    assert got == {1: ([10, 11], ["x"]), 2: ([20], []), 3: ([], ["z"]), None: ([], ["n"])}
    three = keyed.cogroup_many([a, b, a], ["k"], ["v", "w", "v"])
    assert {r.k: (r.values_0, r.values_1, r.values_2) for r in three.collect()}[1] == ([10, 11], ["x"], [10, 11])
    assert inspect.shuffles(three) == 1
    py = keyed.cogroup_py(a, b.dropna(), ["k"], lambda x, y: x.head(1)[["k"]].assign(n=len(y)) if len(x) else y.head(1)[["k"]].assign(n=-1), "k int, n long")
    assert {r.k: r.n for r in py.collect()} == {1: 1, 2: 0, 3: -1}


def test_cartesian_and_partitioners(spark):
    got = keyed.cartesian(items(spark, [0, 1]), items(spark, ["α", "β"], kind="c string")).collect()
    assert sorted(map(tuple, got)) == [(0, "α"), (0, "β"), (1, "α"), (1, "β")]
    pairs = items(spark, [(i % 3, i) for i in range(30)], 4, "k int, v int")
    by_key = keyed.partition_by_key(pairs, ["k"], 5)
    assert by_key.columns == ["v"] and by_key.rdd.getNumPartitions() == 5
    assert all(len({v % 3 for v in p}) <= 3 for p in by_key.rdd.map(lambda r: r.v).glom().collect())
    by_id = keyed.partition_by_id(pairs, "k", 3).withColumn("p", F.spark_partition_id())
    assert by_id.where("p <> k").count() == 0


# ------------------------------------------------------------------------------ aggregates
def test_whole_table(spark):
    df = items(spark, [1, 2, 3, 4])
    none = items(spark, [], 2)
    assert (aggregates.reduce(df, F.sum("value")), aggregates.reduce(none, F.sum("value"))) == (10, None)
    assert (aggregates.reduce_py(df, lambda a, b: Row(value=a.value + b.value)).value, aggregates.reduce_py(none, max)) == (10, None)
    assert (aggregates.fold(df, "value"), aggregates.fold(none, "value")) == (10, 0)
    assert aggregates.fold_py(df, 0, lambda a, b: a + b) == 10
    assert aggregates.fold_py(df, 10, lambda a, b: a + b) == 10 + 3 * 10  # once per partition and once more
    with pytest.raises(ValueError):
        aggregates.fold(df, "value", "sum", 5)
    with pytest.raises(ValueError):
        aggregates.fold(df, "value", "max")
    pairs = items(spark, [("a", 1), ("b", 2), ("a", 2), ("c", 5), ("a", 3)], kind="k string, v long")

    def seq(m, r):
        m[r.k] = m.get(r.k, 0) + r.v
        return m

    def comb(m, o):
        for k, v in o.items():
            m[k] = m.get(k, 0) + v
        return m

    assert aggregates.aggregate_py(pairs, {}, seq, comb) == {"a": 6, "b": 2, "c": 5}
    assert aggregates.count(df) == 4 and aggregates.is_empty(none) and not aggregates.is_empty(df)


def test_extremes(spark):
    df = items(spark, [13, 28, None, 4, 51, 113, 12])
    assert (aggregates.max_of(df), aggregates.min_of(df), aggregates.min_of(df, nulls="lowest"), aggregates.max_of(df, nulls="lowest")) == (113, 4, None, 113)
    assert aggregates.max_of(items(spark, [])) is None
    pairs = items(spark, [(1, "b"), (1, "c"), (0, "z")], kind="k int, v string")
    assert tuple(aggregates.max_of(pairs)) == (1, "c")


# -------------------------------------------------------------------------- sets and order
def test_sets(spark):
    a, b = items(spark, A, 4), items(spark, B, 3)
    assert sorted(values(sets.intersection(a, b))) == [3, 4, 5, 13]
    assert sorted(values(sets.subtract(a, b))) == [0, 1, 2, 10, 12, 19]
    assert values(sets.union(items(spark, [1, 2, 3, 4]), items(spark, [1, 2, 3, 4]))) == [1, 2, 3, 4] * 2
    assert sets.union_many([a]).count() == 10 and sets.union_many([a, b, a]).count() == 28
    with pytest.raises(ValueError):
        sets.union_many([])
    dup = items(spark, [1, 2, 2, 2, 3, 3, 3, 4, 4, 5], 3)
    for n in (2, 10):
        assert sorted(values(sets.distinct(dup, n))) == [1, 2, 3, 4, 5]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=st.lists(st.one_of(st.none(), st.integers(-3, 3))), b=st.lists(st.one_of(st.none(), st.integers(-3, 3))))
def test_sets_are_sets(spark, a, b):
    x, y = items(spark, a), items(spark, b)
    assert sorted(map(str, values(sets.intersection(x, y)))) == sorted(map(str, set(a) & set(b)))
    assert sorted(map(str, values(sets.subtract(x, y)))) == sorted(map(str, set(a) - set(b)))
    assert sorted(map(str, values(sets.distinct(x)))) == sorted(map(str, set(a)))


def test_order(spark):
    df = items(spark, [13, 28, 3, 4, 51, 108, 12, 113, 19], 4)
    assert [r.value for r in ordering.top(df, 3)] == [113, 108, 51]
    assert [r.value for r in ordering.take_ordered(df, 3)] == [3, 4, 12]
    assert ordering.take_ordered(df, 0) == [] == ordering.top(df, 0)
    assert "TakeOrderedAndProject" in inspect.formatted(ordering.top_df(df, 3))
    six = items(spark, [1, 2, 3, 4, 5, 6], 4)
    assert [len(ordering.take(six, n)) for n in (1, 3, 7, 0)] == [1, 3, 6, 0]
    assert ordering.first(six).value == 1
    with pytest.raises(ValueError):
        ordering.first(items(spark, []))
    assert [r.value for r in ordering.top(items(spark, [None, 1, 2]), 3)] == [2, 1, None]


def test_partition_numbers(spark):
    ones = items(spark, [1] * 101, 101)
    five = partitioning.coalesce(ones, 5)
    assert five.rdd.glom().map(len).collect() == [20, 20, 20, 20, 21]
    assert partitioning.number_of_splits(partitioning.coalesce(items(spark, A, 4), 10)) == 4
    assert partitioning.number_of_splits(partitioning.coalesce(items(spark, A, 4), 10, shuffle=True)) == 10
    assert partitioning.number_of_splits(partitioning.repartition(items(spark, [1] * 100, 20), 100)) == 100


# --------------------------------------------------------------------------------- samples
def test_take_sample(spark):
    five, hundred = items(spark, range(1, 6), 6), items(spark, range(100), 5)
    assert len(sampling.take_sample(five, False, 6)) == 5
    assert len(sampling.take_sample(hundred, True, 80, 1)) == 80
    assert len({r.value for r in sampling.take_sample(hundred, False, 10, 1)}) == 10
    assert len(sampling.take_sample(five, True, 12, 3)) == 12
    assert sampling.take_sample(hundred, True, 0) == [] == sampling.take_sample(items(spark, []), True, 5)


def test_sample_rates(spark):
    df = int_range(spark, 1, 20000, 1, 4)
    for f in (0.0, 0.1, 0.5, 1.0):
        assert abs(sampling.sample(df, False, f, 3).count() - 20000 * f) <= 400
    assert abs(sampling.sample(df, True, 1.5, 3).count() - 30000) < 900
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            sampling.sample(df, False, bad)


def test_random_split(spark):
    df = int_range(spark, 1, 600, 1, 3)
    parts = sampling.random_split(df, [1, 2, 3], 7)
    got = [set(values(p)) for p in parts]
    assert set.union(*got) == set(range(1, 601)) and sum(map(len, got)) == 600
    assert all(abs(len(g) - n) < 50 for g, n in zip(got, (100, 200, 300), strict=True))
    for bad in ([], [0, 0], [-1, 2]):
        with pytest.raises(ValueError):
            sampling.random_split(df, bad)


# ------------------------------------------------------------------------------ approximate
def test_count_approx(spark):
    final = approx.count_approx(int_range(spark, 1, 10000, 1, 20), 10000, 0.95).get_final_value()
    assert (final.mean, final.confidence, final.low, final.high) == (10000, 1, 10000, 10000)
    none = approx.count_approx(int_range(spark, 1, 0), 10000).get_final_value()
    assert (none.mean, none.confidence, none.low, none.high) == (0, 0, 0, sys.float_info.max)
    plain = approx.count_approx(int_range(spark, 1, 0), 10000, unknown_when_zero=False).get_final_value()
    assert (plain.mean, plain.confidence) == (0, 1)
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            approx.count_approx(int_range(spark, 1, 5), 10, bad)


def test_partial_count(spark):
    import time

    slow = transforms.map_partitions(int_range(spark, 1, 8, 1, 8), lambda rows: (time.sleep(1.5), list(rows))[1], "id long")
    got = approx.count_approx(slow, 200, 0.9)
    assert not got.is_final
    assert got.get_final_value().mean == 8


def test_count_by_value_approx(spark):
    got = approx.count_by_value_approx(items(spark, [1, 2, 2, 3, 3, 3], 6), 10000).get_final_value()
    assert {k[0]: b.mean for k, b in got.items()} == {1: 1, 2: 2, 3: 3}


# ------------------------------------------------------------------------- methods and plans
def test_methods(spark):
    c = Collection(items(spark, [("a", 1), ("b", 2), ("a", 3)], kind="k string, v long"))
    assert dict(map(tuple, c.reduce_by_key(["k"], {"v": "sum"}).collect())) == {"a": 4, "b": 2}
    assert c.where("v > 1").union(c).count() == 5
    assert [len(x.collect()) for x in Collection(spark.range(0)).random_split([1.0, 1.0])] == [0, 0]
    assert "k:string" in repr(c)


def test_pushdown_and_pruning(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_quantity") > 45).select("l_orderkey")
    assert any("GreaterThan(l_quantity,45.0)" in f for f in inspect.pushed_filters(df))
    assert inspect.read_schema(df) == ["l_orderkey:bigint,l_quantity:double"]
    assert inspect.shuffles(df) == 0 and inspect.lineage(df)


def test_stream(spark, sf, tmp_path):
    from millrace.streaming import keyed as live

    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    out = live.reduce_by_key(stream, ["event_type"], [F.count("*").alias("n")], "ts", "1 hour", "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select sum(n) from live").first()[0] == events.count()
    finally:
        q.stop()


# -------------------------------------------------------------------------------- plans
def test_one_shuffle_for_a_number_or_a_partitioner(spark):
    pairs = items(spark, [("a", 1), ("b", 2), ("a", 2), ("c", 5), ("a", 3)], kind="k string, v long")
    for n, p in ((3, None), (300, None), (3, F.ascii("k"))):
        out = keyed.reduce_by_key(pairs, ["k"], {"v": "sum"}, n, p)
        assert inspect.shuffles(out) == 1
        assert dict(map(tuple, out.collect())) == {"a": 6, "b": 2, "c": 5}
    where = {r.k: r.p for r in keyed.reduce_by_key(pairs, ["k"], {"v": "sum"}, 3, F.ascii("k")).select("k", F.spark_partition_id().alias("p")).collect()}
    assert where == {k: ord(k) % 3 for k in "abc"}
    with pytest.raises(ValueError):
        keyed.group_by_key(pairs, ["k"], "v", partitioner=F.ascii("k"))


def test_zip_partitions_is_narrow(spark):
    left, right = int_range(spark, 1, 1000, 1, 3).toDF("a"), int_range(spark, 1, 600, 1, 3).select(F.col("id").cast("string").alias("b"), F.array("id").alias("c"))
    out = transforms.zip_partitions(left, right)
    assert inspect.shuffles(out) == 0 and out.count() == 600
    assert out.columns == ["a", "b", "c"] and all(r.b == str(r.c[0]) for r in out.take(20))
    assert transforms.zip_partitions(items(spark, [1], 3), items(spark, ["x", "y"], 3, "s string")).count() <= 1


def test_ranks_of_ties(spark):
    df = items(spark, [(1, k % 3) for k in range(30)], 4, "a int, b int")
    ranks = sorted(tuple(r) for r in transforms.ranked(df, ["a"], "r").collect())
    assert sorted(r for *_, r in ranks) == list(range(30))
    assert ranks == sorted(tuple(r) for r in transforms.ranked(df.repartition(7), ["a"], "r").collect())


def test_failed_approximate_count(spark):
    def broken(batches):
        import time

        time.sleep(1)
        raise ValueError("broken on purpose")

    got = approx.count_approx(transforms.map_batches(spark.range(5), broken), 1)
    assert not got.is_final
    with pytest.raises(RuntimeError):
        got.get_final_value()
    with pytest.raises(ValueError):
        approx.count_by_value_approx_df(spark.range(1000), most=10)


def test_sample_rate_is_enough(spark):
    df = spark.range(500)
    for n in (1, 10, 80, 700):
        assert sampling.take_sample_df(df, True, n, 3).count() == n
    assert 0.16 < sampling.sample_rate(80, 500) < 0.3
