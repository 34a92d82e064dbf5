"""URL filters: a sorted array of 64-bit digests, probed by vectorised binary search.

The index of a rule list is a folder of shards.  A shard has the sorted xxhash64 keys of its entries, the
entries' full strings and their verdicts, each as a file that workers map into memory.  A URL is turned into
the strings that a rule could have for it (host suffixes at label boundaries times path prefixes, of the
lengths that the index has), all strings of a batch are probed at once, and a hit counts only when the stored
full string is equal, so colliding digests do no harm.  Of the rules that fit, the longest wins.

The list may be as large as a table: shards are written by the cluster, in ranges of the key, and no entry
passes through the driver.

Edge cases: a null URL or one without ``://`` has an empty host and path and no rule; a rule given twice
counts once (block wins over allow); hosts are compared without case for A-Z, paths with case; URLs of any
length are handled whole; repeated rows are kept; an empty list or table gives a result all the same.  Output
columns replace columns of the same name; all others pass through.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEFAULT = "allow"
SHARD_ROWS = 1 << 20
#: (host and path, verdict)
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# --------------------------------------------------------------------------- index
def digest(entries: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(e) for e in entries], np.uint64).view(np.int64)


def build(rules: DataFrame, folder: str, shards: int | None = None) -> None:
    """Write the index of ``rules`` (rule, verdict) to ``folder``: a shard for every ``SHARD_ROWS`` rules, or ``shards``."""
    fields = "key long, rule string, verdict string"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = digest(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0), b.column(1)], names=["key", "rule", "verdict"])

    clean = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select("rule", "verdict")
    once = clean.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    shards = shards or max(1, -(-clean.count() // SHARD_ROWS))
    ranged = once.mapInArrow(keyed, fields).repartitionByRange(shards, "key").sortWithinPartitions("key", "rule")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("rule", pa.string()), ("verdict", pa.string())]))
        if rows.num_rows:
            fs, top = common.open_fs(folder)
            context = TaskContext.get()
            name, attempt = f"shard-{context.partitionId():06d}", context.taskAttemptId()
            texts = [f"{r}\t{v}".encode() for r, v in zip(rows["rule"].to_pylist(), rows["verdict"].to_pylist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            keys = rows["key"].to_numpy().astype(np.int64)
            # the parts go to names of this attempt; the last rename makes the shard visible at once
            for part, data in (("blob", b"".join(texts)), ("ends", ends.tobytes()), ("keys", keys.tobytes())):
                with fs.open_output_stream(f"{top}/_{name}-{attempt}.{part}") as f:
                    f.write(data)
                fs.move(f"{top}/_{name}-{attempt}.{part}", f"{top}/{name}.{part}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows.num_rows], pa.int64())})

    ranged.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    lengths = clean.select(
        F.length(F.substring_index("rule", "/", 1)).alias("h"),
        (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("p"),
    )
    row = lengths.agg(F.collect_set("h").alias("h"), F.collect_set("p").alias("p")).first()
    fs, top = common.open_fs(folder)
    with fs.open_output_stream(f"{top}/lengths.json") as f:
        f.write(json.dumps({"host": sorted(row["h"]), "path": sorted(row["p"])}).encode())


class Index:
    """A worker's view of an index."""

    def __init__(self, folder: str):
        from pyarrow import fs as pafs

        self.fs, self.top = common.open_fs(folder)
        self.copies: str | None = None
        with self.fs.open_input_stream(f"{self.top}/lengths.json") as f:
            lengths = json.loads(f.read())
        self.hosts, self.paths = set(lengths["host"]), lengths["path"]
        found = self.fs.get_file_info(pafs.FileSelector(self.top))
        names = sorted(x.base_name[:-5] for x in found if x.base_name.startswith("shard-") and x.base_name.endswith(".keys"))
        self.shards = [tuple(self._map(f"{n}.{part}", kind) for part, kind in (("keys", np.int64), ("ends", np.int64), ("blob", np.uint8))) for n in names]
        self.least = np.array([s[0][0] for s in self.shards], np.int64)

    def _map(self, name: str, kind) -> np.ndarray:
        from pyarrow import fs as pafs

        where = f"{self.top}/{name}"
        if not isinstance(self.fs, pafs.LocalFileSystem):  # mapping needs a local copy, in the executor's own folder
            if self.copies is None:
                self.copies = tempfile.mkdtemp(prefix="urls-", dir=SparkFiles.getRootDirectory())
                weakref.finalize(self, shutil.rmtree, self.copies, True)  # with the worker at the latest
            own = os.path.join(self.copies, name)
            pafs.copy_files(where, own, source_filesystem=self.fs)
            where = own
        return np.memmap(where, kind, "r")

    def find(self, entries: list[str]) -> list[str | None]:
        """The verdict of each entry that the index holds."""
        out: list[str | None] = [None] * len(entries)
        if not entries or not self.shards:
            return out
        keys = digest(entries)
        shard = np.searchsorted(self.least, keys, "right") - 1
        for s in np.unique(shard[shard >= 0]):
            own, ends, blob = self.shards[s]
            asked = np.flatnonzero(shard == s)
            at = np.searchsorted(own, keys[asked])
            while len(asked):  # equal digests stand next to each other; an entry is confirmed by its full string
                same = at < len(own)
                same[same] = own[at[same]] == keys[asked[same]]
                asked, at = asked[same], at[same]
                again = np.ones(len(asked), bool)
                for i, (q, p) in enumerate(zip(asked, at, strict=True)):
                    rule, _, verdict = bytes(blob[ends[p] : ends[p + 1]]).decode().rpartition("\t")
                    if rule == entries[q]:
                        out[q], again[i] = verdict, False
                asked, at = asked[again], at[again] + 1
        return out

    def candidates(self, host: str, path: str) -> list[str]:
        """The strings that a rule for this host and path could have, longest first."""
        starts = [m.end() for m in re.finditer(r"\.", host)]
        hosts = [host[i:] for i in (0, *starts) if len(host) - i in self.hosts]
        found = [h + path[:n] for h in hosts for n in self.paths if n <= len(path)]
        return sorted(found, key=len, reverse=True)


_INDEXES: dict[str, Index] = {}


def judge(urls: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """``urls`` with host, path, the longest rule that fits and the verdict."""
    own = urls.drop("host", "path", "rule", "verdict").withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    schema = T.StructType([*own.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    at = own.columns.index("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _INDEXES:
            _INDEXES[folder] = Index(folder)
        index = _INDEXES[folder]
        for batch in batches:
            rules, verdicts = [], []
            hosts, paths = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
            asked = [index.candidates(h, p) for h, p in zip(hosts, paths, strict=True)]
            flat = sorted({e for own_asked in asked for e in own_asked})
            known = {e: v for e, v in zip(flat, index.find(flat), strict=True) if v is not None}
            for own_asked in asked:
                rule = next((e for e in own_asked if e in known), None)
                rules.append(rule)
                verdicts.append(known[rule] if rule is not None else DEFAULT)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict under ``RULES``."""
    scratch = common.Scratch(spark, "urls")
    folder = scratch.mkdir("index")
    build(spark.createDataFrame(RULES, "rule string, verdict string"), folder)
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), folder).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
