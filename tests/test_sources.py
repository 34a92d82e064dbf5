import pytest
from pyspark.sql import functions as F

from millrace.sources import collections, files, sinks
from millrace.sources.paths import Path

LINES = "This is some textual test data.\nCan be converted to strings and there are two lines."


@pytest.fixture
def folder(tmp_path):
    for i in range(10):
        (tmp_path / f"f{i}.txt").write_text(LINES)
    (tmp_path / "other.bin").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text(LINES)
    return tmp_path


def test_items_keep_order_and_slices(spark):
    df = collections.from_items(spark, [1, 2, 3, 4], num_slices=2)
    assert [r[0] for r in df.collect()] == [1, 2, 3, 4]
    assert df.rdd.getNumPartitions() == 2
    assert collections.from_items(spark, [], num_slices=3).count() == 0
    assert collections.from_items(spark, range(10), num_slices=32).rdd.getNumPartitions() == 32
    with pytest.raises(ValueError):
        collections.from_items(spark, [1], num_slices=-1)


def test_chunks_are_partitions(spark):
    df = collections.from_chunks(spark, [[1, 2, 3], [], [4]])
    assert df.rdd.glom().map(len).collect() == [3, 0, 1]
    assert collections.from_chunks(spark, []).count() == 0


def test_range_has_its_end(spark):
    assert [r.id for r in collections.int_range(spark, 1, 12, 1, 3).collect()] == list(range(1, 13))
    assert [r.id for r in collections.int_range(spark, 0, 9, 3).collect()] == [0, 3, 6, 9]
    assert collections.int_range(spark, 5, 4).count() == 0
    with pytest.raises(ValueError):
        collections.int_range(spark, 1, 2, 0)


def test_files_and_paths(spark, folder):
    config = files.FileReaderConfig(str(folder)).filter_extension("txt").expect_directory(True)
    df = files.read_source(spark, config, lambda b: b.decode().splitlines(), "line string")
    assert df.count() == 20
    assert files.read_paths(spark, config).count() == 10
    assert files.read_bytes(spark, files.FileReaderConfig(str(folder))).count() == 11
    one = files.FileReaderConfig(str(folder / "f0.txt"))
    assert files.read_source(spark, one, lambda b: b.decode().splitlines(), "line string").count() == 2
    assert files.read_source(spark, one, F.length("content").alias("n")).first().n == len(LINES)
    assert files.read_bytes(spark, config.num_partitions_per_executor(3)).rdd.getNumPartitions() % 3 == 0


def test_missing_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.read_bytes(spark, files.FileReaderConfig(str(folder)).filter_extension("nope"))
    with pytest.raises(FileNotFoundError):
        files.read_bytes(spark, files.FileReaderConfig(str(folder / "nowhere")))
    with pytest.raises(NotADirectoryError):
        files.read_bytes(spark, files.FileReaderConfig(str(folder / "f0.txt")).expect_directory(True))
    with pytest.raises(IsADirectoryError):
        files.read_bytes(spark, files.FileReaderConfig(str(folder)).expect_directory(False))


def test_delimited_and_parquet(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a b 10 3600000\na b 30 3600000\n")
    df = files.read_delimited(spark, str(tmp_path / "log.txt"), "src string, dst string, bytes long, ts long")
    assert df.groupBy("src").agg(F.avg("bytes")).first()[1] == 20
    df.write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p"), "src", "bytes").columns == ["src", "bytes"]
    assert files.read_lines(spark, str(tmp_path / "log.txt")).count() == 2


def test_packing():
    groups = files.packed([500, 2000, 3900, 2000, 1000, 1500, 500], 4)
    assert len(groups) == 4 and sum(map(sum, groups)) == 11400
    assert max(map(sum, groups)) <= 3900
    assert len(files.packed([1, 2, 3, 4], 8)) == 4
    with pytest.raises(ValueError):
        files.packed([1], 0)


def test_text_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a",), (None,), ("c",)], "s string").coalesce(1)
    sinks.save_as_text_file(df, out)
    sinks.save_as_text_file(df, out)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["", "a", "c"]
    sinks.save_as_text_file(spark.range(2).withColumn("b", F.lit("x")), out)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ['{"id":0,"b":"x"}', '{"id":1,"b":"x"}']


def test_for_each(spark):
    seen = spark.sparkContext.accumulator(0)
    sinks.for_each(spark.range(5), lambda r: seen.add(r.id))
    sinks.for_each_partition(spark.range(0, 5, 1, 2), lambda rows: seen.add(sum(r.id for r in rows)))
    assert seen.value == 20


def test_jobs_by_partition(spark):
    df = spark.range(0, 6, 1, 3)
    assert sinks.run_job(df, lambda rows: sum(r.id for r in rows)) == [1, 5, 9]
    assert sinks.run_job_with_partitions(df, lambda rows: sum(r.id for r in rows), [2, 0]) == [9, 1]
    assert sinks.run_job_with_context(df, lambda c, rows: (c.partitionId(), len(list(rows)))) == [(0, 2), (1, 2), (2, 2)]


def test_path_algebra():
    p = Path.from_url("hdfs://host:9000/a/b/c.txt")
    assert (p.scheme, p.authority, p.name, p.parent.path) == ("hdfs", "host:9000", "c.txt", "/a/b")
    assert p.to_url() == "hdfs://host:9000/a/b/c.txt"
    assert Path.from_path_string("/a//b/../c").path == "/a/c"
    assert Path.from_path_string("/").is_root and Path.from_path_string("/").parent is None
    assert not Path.from_path_string("a/b").is_absolute
    assert Path.from_url("s3://bucket/x").merge_paths(Path.from_path_string("/y")).to_url() == "s3://bucket/x/y"
    with pytest.raises(ValueError):
        Path.from_path_string("")
    with pytest.raises(ValueError):
        Path.from_scheme_auth_path("a", "b", "")
