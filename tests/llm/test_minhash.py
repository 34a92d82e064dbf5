import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import common, graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, size, percent=80):
    """(set size, smallest index reachable) of every text."""
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near(rng, words, rate):
    return " ".join(w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(4, 200))]
        out += [near(rng, base, rate) for rate in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.2)]
    return [*out, None, "", " \n", "a", "A", "a b", "a b c d", "A  b\tc d", "a b c d e", "É x y z", "é x y z", "x " * 20000]


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, documents, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component) for r in minhash.near_duplicates(documents(texts), size=size).collect()}
    assert got == dict(enumerate(brute(texts, size)))


def test_small_cells(spark, documents, monkeypatch, data_dir, texts):
    """A group of many pieces: every pair still meets."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    many = [near(rng, base, 0.03) for _ in range(60)] + texts[:20]
    monkeypatch.setattr(minhash, "CELL", 1500)
    d = data_dir(documents=documents(many))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op1_minhash(spark, d).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in enumerate(brute(many, 4))}


def test_rows(spark, documents, data_dir):
    rows = documents(["a b c d e f", "a b c d e f", "a b c d e f", "q"], ids=[7, 7, 3, None])
    got = sorted(tuple(r) for r in minhash.op1_minhash(spark, data_dir(documents=rows)).collect())
    assert got == [(3, 3, 3, True), (7, 3, 3, False), (7, 3, 3, False)]
    kept = minhash.dedup_stage(spark, rows, "")
    assert kept.columns == rows.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3]
    assert minhash.near_duplicates(documents([])).collect() == []
    assert sorted(minhash.near_duplicates(documents([None, ""])).collect()) == [(0, 0, 0), (1, 0, 1)]


def test_signature_estimates_similarity():
    rng, equal = np.random.default_rng(0), []
    for _ in range(60):
        shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
        equal.append((minhash.band_keys([x, y])[0] == minhash.band_keys([x, y])[1]).sum())
    assert abs(np.mean(equal) - 20 * 0.8**4) < 1 and min(equal) > 0
    apart = minhash.band_keys([np.sort(a), np.sort(b)])
    assert (apart[0] == apart[1]).sum() == 0
    assert (minhash.band_keys([y])[0] == minhash.band_keys([x, y])[1]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), max_size=12), st.sampled_from([50, 80, 100]))
def test_links(sets, percent):
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    a, b = minhash.links(np.arange(len(sets)), sets, percent)
    child, root = graph.forest(a, b)
    got = dict(zip(child.tolist(), root.tolist(), strict=True))
    label = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                n = len(np.intersect1d(x, y))
                if 100 * n >= percent * (len(x) + len(y) - n):
                    label[i] = min(label[i], label[j])
    assert [got.get(i, i) for i in range(len(sets))] == label


@pytest.mark.parametrize("hub", [1 << 20, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 180)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)] + [(5, 5), (2, 1), (2, 1)] + [(500, 501 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(df, common.Scratch(spark, "test"), "t").collect()}
    assert {k: got.get(k, k) for k in label} == label
    assert graph.components(df.where("a < 0"), common.Scratch(spark, "test"), "t").collect() == []


def test_sieve(spark):
    rows = spark.range(10000)
    wanted = spark.range(0, 10000, 100)
    got = {r.id for r in common.sieve(rows, wanted, "id").collect()}
    assert got >= set(range(0, 10000, 100)) and len(got) < 2000
    assert common.sieve(rows, wanted.where("id < 0"), "id").count() == 0
    assert common.sieve(rows, wanted, "id", most=1 << 12).where(F.col("id") % 100 == 0).count() == 100


def test_chain_of_half_alike_sets(spark, documents, data_dir, monkeypatch):
    """Thousands of sets, each of similarity 0.65 with the next and 0.4 with the one after it: what is sent grows with their number, not its square."""
    monkeypatch.setattr(minhash, "CELL", 2048)
    monkeypatch.setattr(minhash, "WIDE", 4)
    sent = []
    met = minhash._met

    def counted(own, cells, *rest):
        sent.append(cells.count())
        return met(own, cells, *rest)

    monkeypatch.setattr(minhash, "_met", counted)
    words = [f"w{k}" for k in range(14 * 1600 + 90)]
    texts = [" ".join(words[14 * k : 14 * k + 69]) for k in range(1600)]
    texts += [" ".join(words[14 * k : 14 * k + 66]) for k in range(0, 1600, 40)]  # linked with one of them each
    got = {r.doc_id: r.component_id for r in minhash.op1_minhash(spark, data_dir(documents=documents(texts))).collect()}
    assert got == {k: k for k in range(1600)} | {1600 + n: k for n, k in enumerate(range(0, 1600, 40))}
    assert len(sent) > 1 and sum(sent) < 30 * len(texts), sent


def test_permutations_differ():
    x = np.arange(1000, dtype=np.uint32)
    assert (common.mix32(x.copy()) != common.mix32_other(x.copy())).mean() > 0.99
    assert len(np.unique(common.mix32_other(x.copy()))) == 1000
