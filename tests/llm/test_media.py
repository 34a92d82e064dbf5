import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import common, media


def padded(text):
    b = (text or "").encode("utf-8")
    return b + b" " * (-len(b) % 192 if b else 192)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000))
def test_png_round_trip(payload):
    image, n = media.decode(media.encode(payload))
    assert n == len(payload) and image.tobytes()[:n] == payload and image.shape[1:] == (64, 3)
    assert len(image.tobytes()) % 192 == 0 and len(image)


def test_png_filters():
    """Images of other writers use all five filters."""
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    raw = np.zeros((5, 13), np.uint8)
    for y in range(5):
        raw[y, 0] = y
        for x in range(12):
            a = int(want[y, x - 3]) if x >= 3 else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            raw[y, x + 1] = (int(want[y, x]) - (0, a, b, (a + b) // 2, paeth)[y]) % 256
    assert (media._unfilter(raw, 3) == want).all()


def test_damage_is_seen():
    data = bytearray(media.encode(b"hello"))
    data[60] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))


def test_query(spark, documents, data_dir, odd):
    d = data_dir(documents=documents(odd, ids=[*range(len(odd) - 1), None]))
    got = media.op9_media(spark, d).collect()
    assert len(got) == len(odd) and all(r.error is None for r in got)
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(odd):
        r, p = by[k if k < len(odd) - 1 else None], padded(t)
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        assert r.media_bytes == len(media.encode((t or "").encode())) and r.media_sha256 == hashlib.sha256(media.encode((t or "").encode())).hexdigest()
    assert by[0].feature == by[1].feature and by[4].media_sha256 == by[5].media_sha256
    assert media.op9_media(spark, data_dir(documents=documents([]))).collect() == []


def test_ranges_and_retries(spark, documents):
    scratch = common.Scratch(spark, "test")
    folder = scratch.mkdir("a")
    texts = [f"text {k} " * (k % 50) for k in range(300)]
    done = media.write_archives(documents(texts).repartition(2), folder, "doc_id", "text", archive_bytes=20_000)
    assert done["members"] == 300 and done["archives"] > 2
    small = media.read_archives(spark, folder, rangeBytes=1000, batchBytes=500)
    assert small.rdd.getNumPartitions() > done["archives"]
    assert sorted(int(r.key) for r in small.collect()) == list(range(300))
    # a damaged member is one row with an error; all others are read
    first = small.orderBy("archive", "offset").first()
    with open(first.archive, "r+b") as f:
        f.seek(first.offset + 60)
        f.write(b"\xff\xff\xff")
    open(f"{first.archive.rpartition('/')[0]}/_unfinished.zip", "wb").write(b"junk")
    rows = media.described(media.read_archives(spark, folder, rangeBytes=3000)).collect()
    assert len(rows) == 300 and [r.key for r in rows if r.error] == [first.key]


def test_a_try_that_fails_once(spark, documents, monkeypatch):
    scratch = common.Scratch(spark, "test")
    folder = scratch.mkdir("b")
    media.write_archives(documents(["a", "b", "c"]).coalesce(1), folder, "doc_id", "text")
    reader = media.MediaReader({"path": folder})
    real, opened = common.open_fs, []

    class Flaky:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def open_input_file(self, path):
            opened.append(path)
            if len(opened) == 2:  # the first is for the directory, this one for the first member
                raise OSError("lost connection")
            return self.fs.open_input_file(path)

    parts = reader.partitions()
    monkeypatch.setattr(common, "open_fs", lambda uri: (Flaky(real(uri)[0]), real(uri)[1]))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3 and all(r["error"] is None for r in rows) and len(opened) == 3
