"""Written tables in the folder that driver and executors share: they cut lineage and survive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without it gets a temporary folder.

    A cluster must name it, for its executors can't see the driver's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found if "://" in found or found.startswith("file:") else f"file://{found}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """A folder of its own in the shared one; it goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/millrace-{label}-{uuid.uuid4().hex[:12]}"
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))
