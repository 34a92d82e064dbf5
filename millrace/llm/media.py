"""Media columns: payloads in archives of PNG images, read through a custom Spark data source.

*Writer*: each task stores its rows' payloads as 8-bit RGB images, ``WIDTH`` pixels wide, in ZIP archives of
about ``ARCHIVE_BYTES`` in the shared folder.  Archives get their names by renames at the end of their task, so
a lost task leaves nothing that a reader sees, and a repeated one writes the same names.

*Source* (format ``millrace_media``): plans partitions as byte ranges over the archives of a folder, from file
sizes alone.  A range's reader takes the members whose header lies in the range (from the archive's own
directory), streams them in Arrow batches of bounded bytes, and on a failure opens the archive anew and tries
just that member again at its offset; what still fails becomes a row with ``error``, and the other members go on.

Edge cases: a null text counts as empty; an empty payload is stored as one row of spaces; payloads of any
length are stored whole; null keys are kept; repeated rows are kept as members of their own; an empty table
gives no archive and an empty result.  Only the key and text columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 64
ROW = 3 * WIDTH
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ------------------------------------------------------------------------------- PNG
def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A lossless RGB image of a payload, padded with spaces to whole rows; its length is kept as text."""
    n = len(payload)
    padded = payload + b" " * (-n % ROW if n else ROW)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 in front of each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = zlib.compress(raw.tobytes(), 3)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"payload-bytes\0%d" % n) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of rows that start with their filter type (the five types of the format)."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    for y in np.flatnonzero(kinds):
        row, up = out[y], out[y - 1] if y else np.zeros_like(out[0])
        kind = kinds[y]
        if kind == 2:
            row += up
        elif kind == 1:
            for c in range(bpp):
                row[c::bpp] = np.cumsum(row[c::bpp], dtype=np.uint8)
        elif kind in (3, 4):
            done, above = row.astype(int), up.astype(int)
            for x in range(len(row)):
                a = done[x - bpp] if x >= bpp else 0
                b, c = above[x], above[x - bpp] if x >= bpp else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done[x] = (done[x] + guess) & 255
            out[y] = done
        else:
            raise ValueError(f"filter type {kind}")
    return out


def decode(media: bytes) -> tuple[np.ndarray, int | None]:
    """(height x width x 3 samples, the payload's length where it is given) of an 8-bit RGB image."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, length = 8, None, [], None
    while True:
        if at + 12 > len(media):
            raise ValueError("the image ends early")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media):
            raise ValueError("the image ends early")
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt" and data.startswith(b"payload-bytes\0"):
            length = int(data[14:])
        elif kind == b"IEND":
            break
    width, height, depth, color, *_, interlace = head
    if (depth, color, interlace) != (8, 2, 0):
        raise ValueError("only 8-bit RGB without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 3 * width + 1)
    return _unfilter(raw, 3).reshape(height, width, 3), length


def features(image: np.ndarray) -> str:
    """Size, mean of each channel and an average hash: which of 8 x 8 blocks are brighter than the whole."""
    h, w, _ = image.shape
    mean = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    blocks = np.add.reduceat(np.add.reduceat(image.sum(2, dtype=np.int64), rows, 0), cols, 1)
    size = np.outer(np.maximum(1, np.diff(np.append(rows, h))), np.maximum(1, np.diff(np.append(cols, w))))
    bits = "".join("1" if x else "0" for x in (blocks * (h * w) > int(image.sum(dtype=np.int64)) * size).ravel())
    return f"png:{w}x{h}:{mean[0]},{mean[1]},{mean[2]}:{int(bits, 2):016x}"


# ---------------------------------------------------------------------------- writer
def write_archives(rows: DataFrame, folder: str, key: str, text: str, archive_bytes: int = ARCHIVE_BYTES) -> dict:
    """Store every row of ``rows`` (key, text); the number of archives, members and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, top = common.open_fs(folder)
        members = total = 0
        sink = archive = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal sink, archive, members, total
            if archive is not None:
                archive.close()
                sink.close()
                done.append((own, members, total))
                sink, archive, members, total = None, None, 0, 0

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                media = encode((t.as_py() or "").encode("utf-8", "surrogatepass"))
                if archive is None:
                    own = f"part-{part:06d}-{attempt}-{len(done):05d}.zip"
                    sink = fs.open_output_stream(f"{top}/{own}", compression=None)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                name = zipfile.ZipInfo(f"{members:09d}/{k.as_py()}.png", (1980, 1, 1, 0, 0, 0))
                archive.writestr(name, media)
                members += 1
                total += len(media)
                if sink.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in done], t) for k, (n, t) in enumerate((("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())))})

    table = common.manifest(folder)
    done = rows.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "archive string, members long, bytes long")
    done.write.mode("overwrite").parquet(table)
    done = rows.sparkSession.read.schema("archive string, members long, bytes long").parquet(table)
    return done.agg(F.count("*").alias("archives"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("members", "bytes"))).first().asDict()


# ---------------------------------------------------------------------------- source
@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("key", pa.string()), ("media", pa.binary()), ("error", pa.string())])


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        """Byte ranges over the archives of the folder's manifest."""
        return [
            ByteRange(path, at, min(at + self.range_bytes, size))
            for path, size in common.archives(self.folder, ".zip")
            for at in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def _retried(self, what):
        for left in range(self.tries - 1, -1, -1):
            try:
                return what(), None
            except Exception as e:  # whatever fails in storage or content; reported in the row
                if not left:
                    return None, f"{type(e).__name__}: {e}"

    def read(self, partition):
        if not partition.archive:
            return
        fs, _ = common.open_fs(self.folder)

        def listed():
            with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
                return [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]

        members, error = self._retried(listed)
        if error:
            raise OSError(f"{partition.archive}: {error}")  # without its directory nothing is known of the range
        source = [None]

        def fetched(member):
            try:
                if source[0] is None:
                    source[0] = fs.open_input_file(partition.archive)
                source[0].seek(member.header_offset)
                head = source[0].read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                names, extra = struct.unpack("<HH", head[26:30])
                source[0].seek(member.header_offset + 30 + names + extra)
                data = source[0].read(member.compress_size)
                if zlib.crc32(data) != member.CRC:
                    raise ValueError("checksum of the member")
                return data
            except Exception:
                source[0] = None  # the next try opens the archive anew
                raise

        rows, size = [], 0
        for member in sorted(members, key=lambda m: m.header_offset):
            data, error = self._retried(lambda m=member: fetched(m))
            key = member.filename.partition("/")[2].removesuffix(".png")
            rows.append((partition.archive, member.header_offset, None if key == "None" else key, data, error))
            size += len(data or b"")
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaSource(DataSource):
    @classmethod
    def name(cls):
        return "millrace_media"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of all archives in a folder: archive, offset, key, media, error."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("millrace_media").options(**options).load(folder)


FEATURES = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def described(media: DataFrame) -> DataFrame:
    """Members with what their decoded payloads show; the payload itself stays in its batch."""
    schema = T.StructType([media.schema["key"], media.schema["error"], *FEATURES.fields])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def of(data: bytes) -> tuple:
        image, n = decode(data)
        payload = image.tobytes()
        sha = hashlib.sha256
        return (n, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), sha(data).hexdigest(), features(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for data, error in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                row = (None,) * 7
                if error is None:
                    try:
                        row = of(data.as_py())
                    except (ValueError, struct.error, zlib.error, TypeError) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append(row)
                errors.append(error)
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), *map(pa.array, columns, kinds)], names=schema.names)

    return media.select("key", "media", "error").mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image in an archive, read back by offset and described."""
    scratch = common.Scratch(spark, "media")
    folder = scratch.mkdir("archives")
    write_archives(common.table(spark, sf_dir, "documents"), folder, "doc_id", "text")
    out = described(read_archives(spark, folder))
    return out.select(F.col("key").cast("long").alias("doc_id"), *FEATURES.names, "error")
