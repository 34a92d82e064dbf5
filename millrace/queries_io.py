"""Named queries of file sources, sinks, jobs, plans and sessions, by round trips through the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import keyed, partitioning, transforms
from .plans import inspect
from .queries import _t, query
from .session import DEFAULTS, settings
from .sources import collections, files, sinks
from .sources.paths import Path
from .sources.scratch import Workspace


def _saved(spark: SparkSession, df: DataFrame, parts: int = 3) -> str:
    """A folder of text files, one per partition, with a line per row."""
    where = Workspace(spark, "text").path("lines")
    sinks.save_as_text_file(df.repartition(parts), where)
    return where


def _raised(f) -> str:
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return "none"


# ------------------------------------------------------------------------------- sources
@query("select 'nation.parquet' as name, true as whole, true as dated")
def read_files(spark, d):
    df = files.read_bytes(spark, files.FileReaderConfig(f"{d}/nation.parquet"))
    whole = F.col("length") == F.length("content")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), whole.alias("whole"), F.col("modificationTime").isNotNull().alias("dated"))


@query("select html as line, count(*) n from (select unnest(string_split(replace(html, chr(13), ''), chr(10))) html from pages) where html <> '' group by 1")
def read_source_decoder(spark, d):
    lines = transforms.flat_map(_t(spark, d, "pages"), F.split(F.regexp_replace("html", "\r", ""), "\n"), "line")
    where = files.FileReaderConfig(_saved(spark, lines.where("line <> ''"))).filter_extension("txt").expect_directory(True)
    df = files.read_source(spark, where, lambda content: content.decode().removesuffix("\n").split("\n"), "line string")
    return keyed.count_by_value(df, "line", name="n")


@query("select n_name as line from nation")
def read_source_column(spark, d):
    """The decoder is an expression over each file's bytes."""
    where = files.FileReaderConfig(_saved(spark, _t(spark, d, "nation", "n_name")))
    text = F.regexp_replace(F.col("content").cast("string"), "\n$", "")
    return files.read_source(spark, where, F.explode(F.split(text, "\n")).alias("line"))


@query("select 5 files, 5 with_extension, 0 of_folder")
def read_paths(spark, d):
    where = _saved(spark, _t(spark, d, "nation", "n_name"), 5)
    paths = files.read_paths(spark, files.FileReaderConfig(where).filter_extension(".txt"))
    count = lambda c: F.count_if(c).cast("int")
    return paths.agg(F.count("*").cast("int").alias("files"), count(F.col("path").endswith(".txt")).alias("with_extension"), count(F.col("path").endswith("lines")).alias("of_folder"))


@query("""select * from (values ('absent extension', 'FileNotFoundError'), ('absent folder', 'FileNotFoundError'), ('file for folder', 'NotADirectoryError'),
('folder for file', 'IsADirectoryError'), ('no partitions', 'ValueError'), ('as expected', 'none')) t(what, raised)""")
def file_reader_errors(spark, d):
    where = files.FileReaderConfig(_saved(spark, _t(spark, d, "region", "r_name"), 2))
    read = lambda c: lambda: files.read_bytes(spark, c)
    cases = {
        "absent extension": read(where.filter_extension("nope")),
        "absent folder": read(files.FileReaderConfig(where.path + "-absent")),
        "file for folder": read(files.FileReaderConfig(f"{d}/nation.parquet").expect_directory(True)),
        "folder for file": read(where.expect_directory(False)),
        "no partitions": lambda: where.num_partitions_per_executor(0),
        "as expected": read(where.expect_directory(True)),
    }
    return collections.from_items(spark, [(k, _raised(f)) for k, f in cases.items()], "what string, raised string", 1)


@query("select count(*) n, true as packed, count(distinct n_name) names from nation")
def read_packed_by_size(spark, d):
    """Files of unlike sizes in three partitions of an executor; contents aren't shuffled."""
    where = _saved(spark, _t(spark, d, "nation", "n_name"), 9)
    config = files.FileReaderConfig(where).num_partitions_per_executor(3)
    df = files.read_bytes(spark, config)
    lines = df.select(F.explode(F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\n")).alias("line"))
    parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return lines.agg(F.count("*").alias("n"), F.lit(1 < parts <= partitioning.number_of_splits(df)).alias("packed"), F.count_distinct("line").alias("names"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def delimited_text(spark, d):
    df = _t(spark, d, "customer").select(F.concat_ws("|", "c_custkey", "c_name", "c_nationkey", "c_acctbal").alias("line"))
    return files.read_delimited(spark, _saved(spark, df), "c_custkey long, c_name string, c_nationkey int, c_acctbal double", "|")


@query("""select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) authority,
regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) path from pages where regexp_matches(url, '^[A-Za-z]+://[^/?#]+/[^?#]')""")
def path_of_url(spark, d):
    def split(r):
        p = Path.from_url(r.url)
        return r.page_id, p.scheme, p.authority, p.path

    rows = transforms.where(_t(spark, d, "pages", "page_id", "url"), F.col("url").rlike("^[A-Za-z]+://[^/?#]+/[^?#]"))
    return transforms.map_py(rows, split, "page_id long, scheme string, authority string, path string")


@query("""select n_nationkey, 'hdfs://h/data/' || n_nationkey || '/part.txt' url, 'part.txt' as name, '/data/' || n_nationkey parent, true as absolute from nation""")
def path_algebra(spark, d):
    def built(r):
        p = Path.from_scheme_auth_path("hdfs", "h", "/data").merge_paths(Path.from_path_string(f"{r.n_nationkey}//x/../part.txt"))
        return r.n_nationkey, p.to_url(), p.name, p.parent.path, p.is_absolute

    return transforms.map_py(_t(spark, d, "nation", "n_nationkey"), built, "n_nationkey int, url string, name string, parent string, absolute boolean")


@query("select * from (values (0, 3::bigint, 6::bigint), (2, 1, 4)) t(partition, n, total)")
def from_chunks(spark, d):
    """User-made chunks, one of them empty: each is a partition."""
    return transforms.aggregate_partitions(collections.from_chunks(spark, [[1, 2, 3], [], [4]]), F.count("*").alias("n"), F.sum("value").alias("total"))


@query("select o_orderkey from orders")
def chunked(spark, d):
    chunks = collections.chunked(_t(spark, d, "orders", "o_orderkey"), 4)
    return transforms.flat_map(chunks, F.transform("items", lambda x: x["o_orderkey"]), "o_orderkey")


# --------------------------------------------------------------------------- sinks, jobs
@query("select n_name as value from nation union all select ''")
def save_as_text_file(spark, d):
    """A line per row, a null as an empty line; a second run replaces the files of the first."""
    df = _t(spark, d, "nation", "n_name").union(spark.sql("select cast(null as string)"))
    where = Workspace(spark, "sink").path("lines")
    for _ in range(2):
        sinks.save_as_text_file(df, where)
    return files.read_lines(spark, where)


@query("select r_regionkey, r_name from region")
def save_rows_as_text(spark, d):
    """Rows of several columns are lines of JSON."""
    lines = files.read_lines(spark, _saved(spark, _t(spark, d, "region", "r_regionkey", "r_name")))
    return lines.select(F.from_json("value", "r_regionkey int, r_name string").alias("r")).select("r.*")


@query("select cast(sum(n_nationkey) as bigint) total from nation")
def for_each(spark, d):
    seen = spark.sparkContext.accumulator(0)
    sinks.for_each(_t(spark, d, "nation", "n_nationkey"), lambda r: seen.add(r.n_nationkey))
    return collections.from_items(spark, [seen.value], "total long", 1)


@query("select cast(sum(n_nationkey) as bigint) total, count(*) n from nation")
def for_each_partition(spark, d):
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(rows):
        own = [r.n_nationkey for r in rows]
        total.add(sum(own))
        n.add(len(own))

    sinks.for_each_partition(_t(spark, d, "nation", "n_nationkey").repartition(4), add)
    return collections.from_items(spark, [(total.value, n.value)], "total long, n long", 1)


@query("select * from (values (0, 1::bigint), (1, 5), (2, 9)) t(partition, total)")
def run_job(spark, d):
    got = sinks.run_job(collections.int_range(spark, 0, 5, 1, 3), lambda rows: sum(r.id for r in rows))
    return collections.from_items(spark, list(enumerate(got)), "partition int, total long", 1)


@query("select * from (values (2, 9::bigint, 2::bigint), (0, 1, 2)) t(partition, total, tasks)")
def run_job_with_partitions(spark, d):
    """Two of three partitions; the third has no task."""
    ran, asked = spark.sparkContext.accumulator(0), [2, 0]

    def total(rows):
        ran.add(1)
        return sum(r.id for r in rows)

    got = sinks.run_job_with_partitions(collections.int_range(spark, 0, 5, 1, 3), total, asked)
    return collections.from_items(spark, [(p, x, ran.value) for p, x in zip(asked, got, strict=True)], "partition int, total long, tasks long", 1)


@query("select * from (values (0, 2::bigint), (1, 2), (2, 2)) t(partition, n)")
def run_job_with_context(spark, d):
    got = sinks.run_job_with_context(collections.int_range(spark, 0, 5, 1, 3), lambda c, rows: (c.partitionId(), sum(1 for _ in rows)))
    return collections.from_items(spark, got, "partition int, n long", 1)


# ----------------------------------------------------------------------- plans, sessions
@query("select 1 shuffles, true as pushed, true as pruned, true as traced")
def plan_facts(spark, d):
    """Of a filter and a reduction: one exchange, the filter and the columns at the scan."""
    df = transforms.where(_t(spark, d, "lineitem"), F.col("l_quantity") > 45)
    out = keyed.reduce_by_key(df, ["l_returnflag"], [F.sum("l_linenumber").alias("total")])
    columns = {c.split(":")[0] for s in inspect.read_schema(out) for c in s.split(",")}
    facts = (inspect.shuffles(out), any("l_quantity" in x for x in inspect.pushed_filters(out)), columns == {"l_quantity", "l_returnflag", "l_linenumber"}, "\n" in inspect.lineage(out))
    return collections.from_items(spark, [facts], "shuffles int, pushed boolean, pruned boolean, traced boolean", 1)


@query("select 3 splits, true as located, 3 n")
def splits_and_locations(spark, d):
    df = collections.int_range(spark, 0, 5, 1, 3)
    located = inspect.preferred_locations(df)
    return collections.from_items(spark, [(partitioning.number_of_splits(df), all(isinstance(x, list) for x in located), len(located))], "splits int, located boolean, n int", 1)


@query("select l_returnflag, count(*) n, count(*) again from lineitem group by 1")
def cached(spark, d):
    """Two uses of a kept table."""
    kept = inspect.cached(transforms.project(_t(spark, d, "lineitem"), "l_returnflag"))
    first = {r["l_returnflag"]: r["n"] for r in keyed.count_by_value(kept, name="n").collect()}
    out = [(r["l_returnflag"], first[r["l_returnflag"]], r["n"]) for r in keyed.count_by_value(kept, name="n").collect()]
    kept.unpersist()
    return collections.from_items(spark, out, "l_returnflag string, n long, again long", 1)


@query("""select * from (values ('argument', 'spark.sql.shuffle.partitions', '7'), ('environment', 'spark.executor.memory', '5g'), ('default', 'spark.sql.adaptive.enabled', 'true'))
t(source, setting, value)""")
def session_settings(spark, d):
    """Arguments go before the environment, and that before defaults."""
    held = {k: os.environ.get(k) for k in ("MILLRACE_EXECUTOR_MEMORY", "MILLRACE_SHUFFLE_PARTITIONS")}
    os.environ |= {"MILLRACE_EXECUTOR_MEMORY": "5g", "MILLRACE_SHUFFLE_PARTITIONS": "9"}
    try:
        found = settings(shuffle_partitions=7)
    finally:
        for k, v in held.items():
            os.environ.pop(k, None)
            if v is not None:
                os.environ[k] = v
    rows = [("argument", "spark.sql.shuffle.partitions"), ("environment", "spark.executor.memory"), ("default", "spark.sql.adaptive.enabled")]
    assert DEFAULTS["spark.sql.adaptive.enabled"] == "true"
    return collections.from_items(spark, [(a, b, found[b]) for a, b in rows], "source string, setting string, value string", 1)
