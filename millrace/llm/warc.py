"""WARC: records compressed one by one with a Zstandard dictionary that the archive carries.

Every task writes archives (``.warc.zst``) of its rows in the shared folder.  It builds a dictionary from the
archive's own first records (``TRAIN_BYTES``), puts it in a skippable frame (magic 0x184D2A5D) at the start of
the archive and compresses each record to a frame of its own, so any record can be read without the others.
Of records with equal payloads of at least ``min_bytes`` the one with the largest id is a ``response`` with the
payload; the others are ``revisit`` records that refer to it.  Archives get their names by renames at the
end of their task, so lost or repeated tasks do no harm.

Edge cases: a null payload counts as empty; a null URL gives no target header; a row without an id is written
with an id-less record URI and never referred to; payloads of any length are stored whole; repeated rows
of a response's id and payload are responses all; an empty table gives no archive and an empty result.  Only the
three named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = 0x184D2A5D
TRAIN_BYTES = 4 << 20
DICT_BYTES = 112 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
BATCH_BYTES = 8 << 20
#: Most bytes of duplicates' digests that are broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of a response record, or of a revisit record, which leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, the length and digest of its payload, and the payload of a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(named["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, digest = named["WARC-Type"], named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
        raise ValueError(f"the payload of {named['WARC-Record-ID']} differs from its digest")
    key = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "key": key(named["WARC-Record-ID"]),
        "url": named.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": key(named["WARC-Refers-To"]) if "WARC-Refers-To" in named else None,
        "payload": body if kind == "response" else None,
    }


# ---------------------------------------------------------------------------- writer
def dictionary(samples: list[bytes]):
    """A trained dictionary, or where there is too little to train on, the samples themselves."""
    import zstandard as zstd

    total = sum(map(len, samples))
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(1024, total // 10)), samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Writer:
    """One archive: holds back the records that the dictionary is built from, then writes as they come."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.to = sink, [], 0, None

    def add(self, data: bytes) -> None:
        if self.to is not None:
            self.sink.write(self.to.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= TRAIN_BYTES:
            self.start()

    def start(self) -> None:
        import zstandard as zstd

        own = dictionary(self.held)
        raw = own.as_bytes()
        self.sink.write(MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        self.to = zstd.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        for data in self.held:
            self.sink.write(self.to.compress(data))
        self.held = []

    def close(self) -> None:
        if self.to is None and self.held:
            self.start()
        self.sink.close()


def marked(pages: DataFrame, scratch: common.Scratch, key: str, payload: str, min_bytes: int) -> DataFrame:
    """``pages`` with ``_refers_to``: the id of the response with the same payload, null for responses.

    Payloads are compared by digest and length.  Only digests with several rows matter; they are counted with
    partial aggregation, and joined by broadcast while they are few, else by a shuffle of two written
    tables whose large partitions adaptive execution can split.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    size = F.octet_length(body)
    # SHA-1 and length together, as one column of 24 bytes or so
    keyed = pages.withColumn("_digest", F.when(size >= min_bytes, F.concat(F.unhex(F.sha1(body)), size.cast("string").cast("binary"))))
    groups = (
        keyed.where(F.col("_digest").isNotNull())
        .groupBy("_digest")
        .agg(F.max(key).alias("_response"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_response").isNotNull())
        .drop("_n")
    )
    groups = scratch.keep(groups, "groups")
    small = groups.count() * 64 <= BROADCAST_BYTES
    out = keyed.join(F.broadcast(groups) if small else groups, "_digest", "left")
    return out.withColumn("_refers_to", F.when(~F.col("_response").eqNullSafe(F.col(key)), F.col("_response")))


def write_warc(
    pages: DataFrame, scratch: common.Scratch, key: str, url: str, payload: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> str:
    """Write a record per row; the archives' folder."""
    folder = scratch.mkdir("warc")
    rows = marked(pages.select(key, url, payload), scratch, key, payload, min_bytes).select(key, url, payload, "_refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, top = common.open_fs(folder)
        writer, done, size, records = None, [], 0, 0

        def close() -> None:
            nonlocal writer, size, records
            if writer is not None:
                writer.close()
                done.append((own, records))
                writer, size, records = None, 0, 0

        for batch in batches:
            for k, u, p, r in zip(*batch.columns, strict=True):
                data = record(k.as_py(), u.as_py(), (p.as_py() or "").encode("utf-8", "surrogatepass"), r.as_py(), r.is_valid)
                if writer is None:
                    own = f"part-{part:06d}-{attempt}-{len(done):05d}.warc.zst"
                    writer = Writer(fs.open_output_stream(f"{top}/{own}", compression=None))
                writer.add(data)
                records += 1
                size += len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([x for x, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    rows.mapInArrow(run, "archive string, records long").write.mode("overwrite").parquet(common.manifest(folder))
    scratch.drop("groups")
    return folder


# ---------------------------------------------------------------------------- reader
def records(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one by one; whole frames are held, never the archive."""
    import zstandard as zstd

    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    raw = stream.read(int.from_bytes(head[4:], "little"))
    own = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
    reader = zstd.ZstdDecompressor(dict_data=own)
    left = b""
    while True:
        left = left or stream.read(block)
        if not left:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not left:
                left = stream.read(block)
                if not left:
                    raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data
        yield b"".join(parts)


FIELDS = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARROW = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; every response's payload is verified against its digest."""
    names = [path for path, _ in common.archives(folder, ".warc.zst")]
    paths = spark.createDataFrame(list(enumerate(names)), "n int, path string")
    # a task for each archive
    paths = (paths.repartitionById(len(names), F.col("n")) if names else paths).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.open_fs(folder)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, size = [], 0
            with fs.open_input_stream(path, compression=None) as stream:
                for data in records(stream):
                    row = parse(data)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return paths.mapInArrow(run, FIELDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    scratch = common.Scratch(spark, "warc")
    folder = write_warc(common.table(spark, sf_dir, "pages"), scratch, "page_id", "url", "html")
    return read_warc(spark, folder, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
