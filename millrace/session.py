"""Sessions: local by default, any cluster by its master; settings from arguments or the environment."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Environment variable -> Spark setting.
ENVIRONMENT = {
    "MILLRACE_MASTER": "spark.master",
    "MILLRACE_LOCAL_DIR": "spark.local.dir",
    "MILLRACE_DRIVER_HOST": "spark.driver.host",
    "MILLRACE_DRIVER_MEMORY": "spark.driver.memory",
    "MILLRACE_EXECUTOR_MEMORY": "spark.executor.memory",
    "MILLRACE_CHECKPOINT_DIR": "spark.checkpoint.dir",
    "MILLRACE_SHUFFLE_PARTITIONS": "spark.sql.shuffle.partitions",
}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def settings(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> dict[str, str]:
    """The settings of a session; arguments go before the environment, and that before defaults."""
    out = dict(DEFAULTS)
    out |= {key: os.environ[name] for name, key in ENVIRONMENT.items() if os.environ.get(name)}
    out |= {k: str(v) for k, v in conf.items()}
    if master:
        out["spark.master"] = master
    out.setdefault("spark.master", "local[*]")
    if shuffle_partitions:
        out["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif out["spark.master"].startswith("local"):
        out.setdefault("spark.sql.shuffle.partitions", "8")
    return out


def get_spark(app: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None, log_level: str = "WARN", **conf: str) -> SparkSession:
    """The running session, or a new one."""
    spark = SparkSession.builder.appName(app).config(map=settings(master, shuffle_partitions, **conf)).getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark
