"""Seconds per headline query: the best of three runs after one to warm up.  Prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import time

from millrace import queries as own
from millrace.session import get_spark

HEADLINE = (
    "avg_by_key_hour", "map", "filter", "flat_map", "map_partitions", "flat_map_values", "join", "join_null_safe", "cogroup", "cogroup_3way",
    "cartesian", "reduce_by_key", "combine_by_key", "group_by_key", "count_by_value", "count", "aggregate", "max", "union_many", "distinct",
    "intersection", "subtract", "top", "take_ordered", "zip", "repartition", "partition_by_key", "random_split_invariant", "count_approx",
)


def duckdb_seconds(sf_dir: str) -> dict[str, float]:
    """The yardstick: the same rows by DuckDB from the same files, the best of three runs after one to warm up."""
    import duckdb

    con, out = duckdb.connect(), {}
    for name in sorted(x.removesuffix(".parquet") for x in os.listdir(sf_dir) if x.endswith(".parquet")):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            con.sql(own.oracle_sql()[name]).fetch_arrow_table()
            runs.append(time.perf_counter() - start)
        out[name] = round(min(runs[1:]), 4)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "ERROR", **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g")})
    found, seconds = own.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 4)
    duck = duckdb_seconds(sf_dir)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "duckdb": duck, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
