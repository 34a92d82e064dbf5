import zlib

import numpy as np

from millrace.llm import common, quality

GOOD = [f"the quiet river runs past village number {k} and over the hill" for k in range(40)]
BAD = [f"BUY!! NOW!! {k} $$$ %%% CLICK!! CLICK!!" for k in range(40)]


def rows():
    return [(t, 1) for t in GOOD] + [(t, 0) for t in BAD]


def slow_grams(text, buckets):
    """The grams of one text, counted one by one."""
    out = {}
    g = quality.Grams([text], buckets)
    for at, bucket in g._all():
        for b in bucket[(at >= 0) & (at < len(text) + 1)]:
            out[int(b)] = out.get(int(b), 0) + 1
    return out


def test_grams_do_not_depend_on_the_block():
    texts = ["ab cd", "", "  ", "ab cd ab", "x", "\u00e9t\u00e9 \U0001f600"]
    table = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    total, count = quality.Grams(texts, 1 << 10).sums(table)
    for t, s, n in zip(texts, total, count, strict=True):
        own = slow_grams(t, 1 << 10)
        assert n == sum(own.values()) and abs(s - sum(table[b] * k for b, k in own.items())) < 1e-3
    for (ids, share), t in zip(quality.Grams(texts, 1 << 10).by_text(), texts, strict=True):
        own = slow_grams(t, 1 << 10)
        assert dict(zip(ids.tolist(), share.tolist(), strict=True)).keys() == own.keys()
    # words are counted: "ab cd" has 2 words, 1 pair and the grams of " ab " and " cd "
    assert count[0] == 2 + 1 + 2 * (2 + 1)


def test_learns_and_ranks():
    model = quality.fit(rows(), buckets=1 << 12)
    assert (model.score(GOOD) > 0.5).all() and (model.score(BAD) < 0.5).all()
    again = quality.fit(rows(), buckets=1 << 12)
    assert (again.table == model.table).all()


def test_without_labels():
    assert quality.fit([], buckets=1 << 8).score(["a", ""]).tolist() == [0.5, 0.5]


def test_odd_texts(spark, documents, odd):
    model = quality.fit(rows(), buckets=1 << 12)
    out = {r.doc_id: r for r in quality.score(documents(odd), model).collect()}
    alone = [float(model.score([t or ""])[0]) for t in odd]
    assert all(abs(out[k].score - s) < 1e-6 and 0 <= s <= 1 for k, s in enumerate(alone))
    assert out[0].score == out[1].score == out[2].score and out[4].score == out[5].score
    assert quality.score(documents([]), model).collect() == []


def test_query_and_sample(spark, sf):
    got = quality.op7_quality(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert 5 <= common.labelled_sample(d, y, "quality", 30).count() <= 60
    sizes = [len(r.text.encode()) for r in common.labelled_sample(d, y, "quality", 10**6, 200_000).collect()]
    assert 20_000 <= sum(sizes) <= 200_000 and max(sizes) <= 200_000 // 64
    assert common.labelled_sample(d, y.union(y), "quality", 10**6).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in labels)


def test_stage_keeps_columns(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.quality_filter(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_sample_is_bounded_by_ids(spark):
    """One id that stands in many rows of both tables counts once."""
    d = spark.range(3).selectExpr("id as doc_id", "concat('text ', id) as text").union(spark.range(100_000).selectExpr("2 as doc_id", "concat('again ', id) as text"))
    y = spark.range(100_000).selectExpr("id % 3 as doc_id", "cast(id % 2 as int) as quality")
    got = sorted(tuple(r) for r in common.labelled_sample(d, y, "quality", 10).collect())
    assert got == [(i, "text 1" if i == 1 else f"text {i}" if i == 0 else "again 0", 1) for i in range(3) if zlib.crc32(str(i).encode()) % 5]


def test_both_classes_are_told_apart(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = quality.op7_quality(spark, "/root/testdata/sf0.1").collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    shares = [sum(p == y == c for p, y in held) / sum(y == c for _, y in held) for c in (0, 1)]
    print(f"right of low and of high quality: {shares}")
    assert min(shares) >= 0.9


def mixed(x):
    """The mixing of one 32-bit number."""
    x ^= x >> 16
    x = x * 0x7FEB352D & 0xFFFFFFFF
    x ^= x >> 15
    x = x * 0x846CA68B & 0xFFFFFFFF
    return x ^ x >> 16


def brute(model, text):
    """The score of a text gram by gram, from the definition."""
    white, mask, p = set("\t\n\x0b\x0c\r \x85\xa0"), len(model.table) - 1, 0x01000193
    s = f" {text or ''} "
    found = []
    for k in (3, 4, 5):
        for i in range(len(s) - k + 1):
            if not any(c in white for c in s[i + 1 : i + k - 1]):
                found.append(mixed((k + sum(ord(c) * p**j for j, c in enumerate(s[i : i + k]))) & 0xFFFFFFFF) & mask)
    words, own = [], ""
    for c in s:
        if c not in white:
            own += c
        elif own:
            words.append(sum(ord(x) * p**j for j, x in enumerate(own)) & 0xFFFFFFFF)
            own = ""
    found += [mixed((w + 77) & 0xFFFFFFFF) & mask for w in words]
    found += [mask if a == b else mixed((a * 0x9E3779B1 + b) & 0xFFFFFFFF) & mask for a, b in zip(words, words[1:])]
    z = sum(float(model.table[g]) for g in found) / max(1, len(found)) + model.bias
    return 1 / (1 + np.exp(-z))


def test_whole_query_by_definition(spark, sf, odd, documents):
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.trained(d, y)
    got = {r.doc_id: r.score for r in quality.op7_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    short = [k for k, t in texts.items() if len(t) < 6000]
    assert len(short) > 100 and all(abs(got[k] - brute(model, texts[k])) < 1e-4 for k in short)
    small = [t for t in odd if t is None or len(t) < 100]
    scored = {r.doc_id: r.score for r in quality.score(documents(small), model).collect()}
    assert all(abs(scored[k] - brute(model, t)) < 1e-4 for k, t in enumerate(small))
