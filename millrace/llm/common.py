"""Helpers shared by the training-data operators: tables, scratch space, folds, samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of text that a classifier learns from at most.
SAMPLE_BYTES = 64 << 20
#: Most rows and bytes of a batch that goes to a Python worker: with texts of some kB, Spark's own bound of rows
#: means tens of MB for each of the copies that JVM and worker hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches for Python workers; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader (any file system)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out, a null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(FOLDS)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --------------------------------------------------------------------- scratch space
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the master is a
    single process (tests, local runs) a temporary folder is used instead; on a cluster the
    setting is required, for an executor can't see the driver's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if found:
        return found if "://" in found or found.startswith("file:") else f"file://{found}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def tidy(spark: SparkSession) -> None:
    """Lets the driver give back what earlier jobs held, and Spark's cleaner their shuffles and broadcasts."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive a lost executor.

    What ``drop`` has not removed is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        tidy(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/millrace-{label}-{uuid.uuid4().hex[:12]}"
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def mkdir(self, name: str) -> str:
        path, fs = self._fs(self.path(name))
        fs.mkdirs(path)
        return self.path(name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI, for Python code on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------------- manifests
def manifest(folder: str) -> str:
    """Where the names of a folder's finished archives are written, as a table (archive, ...).

    A task names its files after its attempt and returns the names as rows, so the table holds those of the attempts
    that the job took, and what lost or repeated attempts left behind is never read.
    """
    return f"{folder.rstrip('/')}-manifest"


def archives(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's archives by name: those of its manifest, or all where it has none."""
    from pyarrow import dataset
    from pyarrow import fs as pafs

    fs, top = open_fs(folder)
    found = {x.base_name: (x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(top)) if x.is_file and x.base_name.endswith(suffix) and not x.base_name.startswith("_")}
    listed = open_fs(manifest(folder))[1]
    if fs.get_file_info(listed).type == pafs.FileType.Directory:
        names = dataset.dataset(listed, filesystem=fs, format="parquet").to_table(columns=["archive"])["archive"].to_pylist()
        if absent := sorted(set(names) - found.keys()):
            raise FileNotFoundError(f"{folder}: {absent[:3]} of the manifest")
        return [found[x] for x in sorted(names)]
    return [found[x] for x in sorted(found)]


# --------------------------------------------------------------------------- samples
def some_ids(rows: DataFrame, id: str, max_rows: int) -> DataFrame:
    """The rows of about ``max_rows`` ids, chosen by a hash of the id, so the choice does not depend on partitioning."""
    n = rows.agg(F.approx_count_distinct(id, 0.01)).first()[0]  # of ids: one that repeats counts once
    if n <= max_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64(id, F.lit(17)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))


def within_bytes(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows (id, text, ...), one per id, with at most ``max_bytes`` of text together.

    Texts of more than a 64th of that are left out; of the others those with the lowest hashes of the id stay.
    """
    size = F.octet_length("text")
    rows = rows.where(size <= max_bytes // 64).withColumn("_h", F.xxhash64("id", F.lit(19)))
    # by 1,024 ranges of the hash, so that the driver sees no row
    part = F.shiftright(F.col("_h"), 54)
    ranges = sorted(rows.groupBy(part.alias("part")).agg(F.sum(size).alias("size")).collect())
    total, last = 0, None
    for r in ranges:
        total += r["size"]
        if total > max_bytes:
            break
        last = r["part"]
    if total <= max_bytes:
        return rows.drop("_h")
    return (rows.where(part <= last) if last is not None else rows.limit(0)).drop("_h")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About ``max_rows`` rows (id, text, y) to learn from, of ``max_bytes`` at most: documents outside the held-out fold with a label.

    The ids are chosen by a hash of the id, so the choice does not depend on partitioning.  Only the
    chosen ids are broadcast, and ``max_rows`` (a parameter of each classifier) bounds them.  Null ids
    or labels are left out; several label rows of an id count as one (the largest label), and so do several
    documents (the least text).
    """
    y = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .where(fold("_id") != 0)
    )
    y = some_ids(y, "_id", max_rows).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    rows = rows.join(F.broadcast(y), "_id").groupBy(F.col("_id").alias("id")).agg(F.min("_text").alias("text"), F.max("_y").alias("y"))
    rows = Scratch(docs.sparkSession, "sample").keep(rows, label)
    return within_bytes(rows, max_bytes)


def collected_sample(sample: DataFrame) -> list[tuple[str, int]]:
    """The rows of a bounded sample on the driver, in the order of their ids."""
    got = sample.toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["text"].to_pylist(), strict=True))
    return [(text, y) for _, y, text in rows]


# ------------------------------------------------------------------------------ sieve
SIEVE_BITS = 1 << 26


def sieve(rows: DataFrame, wanted: DataFrame, key: str, most: int = SIEVE_BITS) -> DataFrame:
    """``rows`` without most of those whose integer key ``wanted`` lacks; a join must follow.

    A bitmap of hashed keys is broadcast as 64-bit words, one row each.  It has 16 bits per key and never
    more than ``most``, so the broadcast is bounded; beyond that it only lets more rows through.
    """
    n = wanted.select(key).count()
    bits = min(most, max(1 << 12, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(29)), F.lit(bits))
    words = (
        wanted.select(place.alias("_p"))
        .groupBy(F.shiftrightunsigned("_p", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits"))
    )
    placed = rows.withColumn("_p", place).withColumn("_word", F.shiftrightunsigned("_p", 6))
    hit = placed.join(F.broadcast(words), "_word").where(F.expr("(shiftrightunsigned(_bits, cast(_p & 63 as int)) & 1) = 1"))
    return hit.select(*rows.columns)


# ---------------------------------------------------------------------------- blocks
def blocks(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most ``most`` characters together, or one longer text; null is empty."""
    start, size, own = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if own and size + len(text) > most:
            yield start, own
            start, size, own = i, 0, []
        own.append(text)
        size += len(text)
    if own:
        yield start, own


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def mix32_other(x: np.ndarray) -> np.ndarray:
    """Another bijection on 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
