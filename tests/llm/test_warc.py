import base64
import hashlib
import io

import pytest

from millrace.llm import common, warc

PAGES = [(1, "http://a/", "same"), (2, "http://b/\n x", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300000), (6, "u", "y"), (7, "u", "same"), (8, "é", "\r\n\r\nHTTP/1.1")]


def expected(rows):
    best = {}
    for k, _, h in rows:
        best[h or ""] = max(k, best.get(h or "", k))
    out = {}
    for k, _, h in rows:
        b, r = (h or "").encode(), best[h or ""]
        out[k] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if r == k else "revisit", None if r == k else r)
    return out


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, _digest string")


def test_query(spark, pages, data_dir, sf):
    d = data_dir(pages=pages(PAGES))
    assert {r.page_id: tuple(r)[1:] for r in warc.op3_warc(spark, d).collect()} == expected(PAGES)
    assert warc.op3_warc(spark, data_dir(pages=pages([]))).collect() == []
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert {r.page_id: tuple(r)[1:] for r in warc.op3_warc(spark, sf).collect()} == expected(rows)


def test_records_come_back_whole(spark, pages):
    scratch = common.Scratch(spark, "test")
    folder = warc.write_warc(pages(PAGES).repartition(3), scratch, "page_id", "url", "html", min_bytes=2, archive_bytes=1000)
    got = {r.key: r for r in warc.read_warc(spark, folder).collect()}
    assert {k for k, r in got.items() if r.record_type == "revisit"} == {1, 2}  # 3 and 4 are too small
    for k, url, html in PAGES:
        if got[k].record_type == "response":
            assert bytes(got[k].payload) == (html or "").encode()
        else:
            assert got[k].payload is None and got[k].refers_to == 7
    assert got[2].url == "http://b/%0A%20x" and got[3].url is None and got[8].url == "é"


def test_repeated_and_keyless_rows(spark, pages):
    scratch = common.Scratch(spark, "test")
    rows = [(1, "u", "p"), (1, "u", "p"), (None, "u", "p"), (None, "v", "q")]
    got = warc.read_warc(spark, warc.write_warc(pages(rows), scratch, "page_id", "url", "html")).collect()
    assert sorted((r.key or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]


def test_shuffled_join_for_many_groups(spark, pages, monkeypatch, data_dir):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert {r.page_id: tuple(r)[1:] for r in warc.op3_warc(spark, data_dir(pages=pages(PAGES))).collect()} == expected(PAGES)


def test_dictionary_is_in_front():
    import zstandard as zstd

    class Sink(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    sink = Sink()
    w = warc.Writer(sink)
    many = [warc.record(k, "http://example.org/", f"<html><body>page number {k} of the same site</body></html>".encode(), None, False) for k in range(400)]
    for data in many:
        w.add(data)
    w.close()
    assert int.from_bytes(sink.data[:4], "little") == 0x184D2A5D
    assert list(warc.records(io.BytesIO(sink.data), block=777)) == many
    alone = sum(len(zstd.ZstdCompressor(level=3).compress(m)) for m in many)
    assert len(sink.data) < alone
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(sink.data[:-3])))
    damaged = warc.record(1, None, b"abc", None, False).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse(damaged)


def test_only_archives_of_the_manifest_are_read(spark):
    """What another attempt of a task left behind is not read; a named archive that is gone is an error."""
    import glob
    import os
    import shutil

    pages = spark.createDataFrame([(k, f"http://a/{k}", f"page {k}") for k in range(20)], "page_id long, url string, html string").repartition(2)
    scratch = common.Scratch(spark, "test-warc")
    folder = warc.write_warc(pages, scratch, "page_id", "url", "html")
    own = sorted(glob.glob(f"{common.open_fs(folder)[1]}/*.warc.zst"))
    shutil.copy(own[0], own[0].replace("part-", "part-9"))
    assert warc.read_warc(spark, folder).count() == 20
    os.remove(own[0])
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, folder)
