import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontaminate as dc

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ti", "ru", "se", "mo", "la", "ne") for b in ("dar", "lin", "pos", "tek", "vum", "gra", "shi", "ost", "eld", "urn")]
COMMON = ["the", "of", "and", "to"]


def prose(n):
    return [RNG.choice(WORDS if RNG.random() < 0.6 else COMMON) for _ in range(n)]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 5), max_size=60))
def test_lcs(a, b):
    assert dc.lcs(a, b) == slow_lcs(a, b)


def test_halves_by_text():
    texts = [" ".join(prose(n)) for n in (0, 1, 31, 32, 33, 64, 65, 200)]
    voc = {w.encode(): k + 1 for k, w in enumerate(WORDS)}
    values = np.random.default_rng(0).normal(size=(len(voc) + 1, 3)).astype(np.float32)
    t = dc.Tokens(texts, voc)
    got = t.halves(values)
    want = []
    for text in texts:
        ids = [voc.get(w, 0) for w in dc.words(text)]
        want += [sum((values[i] for i in ids[a : a + 32] if i), np.zeros(3)) for a in range(0, len(ids), 32)]
    assert np.allclose(got, np.array(want), atol=1e-4)


def test_sketch_is_the_gram_matrix(spark, documents):
    texts = [" ".join(prose(n)) for n in (0, 1, 70, 64, 200, 33)]
    voc = {w.encode(): k + 1 for k, w in enumerate(WORDS)}
    counts, passages = dc.passage_counts(documents(texts).repartition(3), "text", voc)
    rows = []
    for text in texts:
        ids = [voc.get(w, 0) for w in dc.words(text)]
        rows += [ids[a : a + 64] for a in range(0, len(ids), 64)]
    assert passages == len(rows)
    assert all(counts[i] == sum(i in r for r in rows) for i in range(1, len(counts)))
    idf = np.linspace(0, 2, len(voc) + 1).astype(np.float32)
    a = np.zeros((len(rows), len(idf)))
    for x, r in zip(a, rows, strict=True):
        np.add.at(x, [i for i in r if i], idf[[i for i in r if i]])
    y = dc.sketch(documents(texts).repartition(3), "text", voc, idf, 8)
    assert np.allclose(y, a.T @ (a @ dc.test_matrix(len(idf), 8)), rtol=1e-3, atol=1e-2)
    space = dc.latent(dc.sketch(documents(texts), "text", voc, idf, 40), dc.test_matrix(len(idf), 40))
    _, values, exact = np.linalg.svd(a, full_matrices=False)
    exact = exact[: np.linalg.matrix_rank(a)]
    got = np.linalg.norm(space, axis=0)[: len(exact)]
    assert np.allclose(got, values[: len(exact)], rtol=1e-2)
    assert np.allclose(np.abs(np.einsum("ij,ji->i", exact, space[:, : len(exact)] / got)), 1, atol=1e-2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=9), st.lists(st.integers(1, 5), max_size=16))
def test_heaviest(a, b):
    """Against all subsequences of ``a``."""
    weight = [1 + x / 8 for x in a]
    best = 0.0
    for mask in range(1 << len(a)):
        at = [i for i in range(len(a)) if mask >> i & 1]
        rest = iter(b)
        if all(a[i] in rest for i in at):
            best = max(best, sum(weight[i] for i in at))
    assert abs(dc.heaviest(a, b, weight) - best) < 1e-9


def slow_coverage(ids, weights, near):
    """By definition: of each piece the heaviest common subsequence in any stretch of SPAN words."""
    n, total = max(1, len(ids) // dc.PIECE), 0.0
    for k in range(n):
        lo, hi = len(ids) * k // n, len(ids) * (k + 1) // n
        total += max((dc.heaviest(ids[lo:hi], near[j : j + dc.SPAN], weights[lo:hi]) for j in range(max(1, len(near)))), default=0.0)
    return total / sum(weights)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=5, max_size=40), st.lists(st.integers(0, 30), max_size=120))
def test_coverage(ids, near):
    weights = [1 + x / 7 for x in ids]
    assert abs(dc.Item(1, ids, set(), weights).coverage(near) - slow_coverage(ids, weights, near)) < 1e-9


@pytest.fixture(scope="module")
def bench(spark):
    items = [" ".join(prose(n)) for n in (15, 30, 59, 150)]
    return [*items, items[1], "too short", None, ""]


def test_planted_items_are_found(spark, documents, bench):
    rng = random.Random(9)
    noise = lambda n: [f"z{rng.randrange(400)}" if rng.random() < 0.5 else rng.choice(COMMON) for _ in range(n)]
    texts, want = [], []
    for k in range(4):
        for n in (0, 20, 500):
            own = bench[k].split()
            texts.append(" ".join([*noise(n), *own, *noise(n)]))  # as it is
            changed = [w for i, w in enumerate(own) if i % 6] if len(own) > 20 else own  # words left out
            texts.append(" ".join([*noise(n), *changed, *noise(n)]).upper() + "!")
            want += [{k, 4} if k == 1 else {k}] * 2
    texts += [" ".join(noise(300)), " ".join(random.Random(1).sample(bench[2].split(), 20)), None, "", "it is Too short.", "too z1 short", "too"]
    want += [set()] * 4 + [{5}, set(), set()]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.find(documents(texts), table).collect()}
    assert [{m.item_id for m in got[k].matches} for k in range(len(texts))] == want
    assert got[0].score == "x"
    blocked = {r.doc_id: r.matches for r in dc.find(documents(texts), table, block=2).collect()}
    assert [{m.item_id for m in blocked[k]} for k in range(len(texts))] == want


def test_odd_texts(spark, documents, bench, odd):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string")
    got = dc.find(documents(odd), table).collect()
    assert len(got) == len(odd) and all(r.matches == [] for r in got)
    assert dc.find(documents([]), table).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.matches == [] for r in dc.find(documents(odd), none).collect())


def test_query_against_brute_force(spark):
    """Every window and item: what the checks accept, the query finds, and nothing else."""
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: [w.decode() for w in dc.words(r.text)] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: [w.decode() for w in dc.words(r.text)] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    passages = [set(t[a : a + dc.WINDOW]) for t in docs.values() for a in range(0, len(t), dc.WINDOW)]
    counts = {w: 0 for x in items.values() for w in x}
    for p in passages:
        for w in p & counts.keys():
            counts[w] += 1
    idf = {w: float(np.log1p((len(passages) + 1) / (n + 1))) for w, n in counts.items()}
    ids = {w: k + 1 for k, w in enumerate(sorted(counts, key=str.encode))}
    want = set()
    for i, own in items.items():
        weights = [idf[w] for w in own]
        rare = sorted(set(own), key=lambda w: (counts[w], ids[w]))
        answer = set(rare[: max(2, -(-len(rare) // 4))])
        for k, t in docs.items():
            if not answer & set(t):
                continue
            for a in range(0, len(t), dc.HALF):
                near = t[max(0, a - len(own)) : a + dc.WINDOW + len(own)]
                there = set(near)
                if len(answer & there) < dc.ANSWER * len(answer) or sum(v for w, v in zip(own, weights) if w in there) < dc.COVERAGE * sum(weights):
                    continue
                share = slow_coverage(own, weights, near)
                if share >= dc.STRONG - 1e-9 or share >= max(dc.COVERAGE - 1e-9, dc.ORDER * slow_coverage(own, weights, near[::-1])):
                    want.add((k, i))
                    break
    got = {(r.doc_id, r.item_id) for r in dc.op6_decontaminate(spark, d).collect()}
    assert got == want and len(want) > 20
    pad = lambda t: f" {' '.join(t)} "
    assert {(k, i) for k, t in docs.items() for i, x in items.items() if pad(x) in pad(t)} <= got
    kept = dc.clean_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == docs.keys() - {k for k, _ in got}


@pytest.fixture(scope="module")
def large(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")


def test_paraphrases(spark, large):
    """Words replaced by others of the corpus, phrases in another order; and hardly a match that is none."""
    docs, bench = large
    rng = random.Random(1)
    texts = [r.text for r in docs.where("doc_id < 3000").collect()]
    corpus = [w for t in texts for w in t.split()]
    items = {r.item_id: r.text.split() for r in bench.collect()}
    some = sorted(items)[:: 2]

    def around(words):
        a, b = (rng.randrange(len(corpus) - 60) for _ in range(2))
        return " ".join([*corpus[a : a + 60], *words, *corpus[b : b + 60]])

    def replaced(words, share):
        return [rng.choice(corpus) if rng.random() < share else w for w in words]

    def turned(words):
        parts = [words[k : k + 8] for k in range(0, len(words), 8)]
        rng.shuffle(parts)
        return [w for p in parts for w in p]

    kinds = {
        "as it is": lambda w: w, "30 % replaced": lambda w: replaced(w, 0.3), "45 % replaced": lambda w: replaced(w, 0.45), "phrases turned": turned,
        "halves swapped": lambda w: w[len(w) // 2 :] + w[: len(w) // 2], "30 % replaced, turned": lambda w: turned(replaced(w, 0.3)),
    }
    rows = [(10**6 + n, around(f(items[i])), name, i) for n, (name, f, i) in enumerate((name, f, i) for name, f in kinds.items() for i in some)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).repartition(8)
    got = {}
    for r in dc.find(table, bench).where("size(matches) > 0").collect():
        got[r.doc_id] = {m.item_id for m in r.matches}
    pad = lambda t: b" " + b" ".join(dc.words(t)) + b" "
    recall = {name: np.mean([i in got.get(k, ()) for k, _, own, i in rows if own == name]) for name in kinds}
    whole = {(r.doc_id, i) for r in docs.collect() for i, w in items.items() if pad(" ".join(w)) in pad(r.text)}
    told = {(k, i) for k, own in got.items() for i in own if k < 10**6}
    print("recall", {k: round(float(v), 3) for k, v in recall.items()}, "in the corpus:", len(told), "of them word for word:", len(whole & told))
    assert min(recall.values()) >= 0.9
    assert whole <= told and len(told) <= 1.05 * len(whole)


def test_retrieval_against_exact_cosine(large):
    """The pairs of a window and an item with the highest exact cosines are retrieved in the latent space."""
    docs, bench = large
    asked = dc.queries_of(docs, bench, "text", "item_id", "text", 256)
    (q,) = asked.blocks
    assert q.space.shape[1] == dc.RANK < len(q.passages)  # the benchmark does not span it
    t = dc.Tokens([r.text for r in docs.where("doc_id < 600").collect()], asked.vocabulary)
    weight = np.zeros(len(q.words) + 1)
    for x in q.items:
        for i, v in zip(x.ids, x.weights):
            weight[q.local[i]] = v
    weight[0] = 0
    exact = np.diag(weight).astype(np.float32)
    half = t.halves(exact, q.local)
    same = np.append(t.doc[1:] == t.doc[:-1], False)
    half[same] += t.halves(exact, q.local)[np.flatnonzero(same) + 1]
    a = np.zeros((len(q.items), len(weight)), np.float32)
    for k, x in enumerate(q.items):
        np.add.at(a[k], q.local[x.ids], weight[q.local[x.ids]])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    cos = half @ a.T / np.maximum(1e-9, np.linalg.norm(half, axis=1))[:, None]
    w, item, _ = q.candidates(t)
    found = set(zip(w.tolist(), item.tolist()))
    last = np.append(t.doc[1:] != t.doc[:-1], True) & np.insert(t.doc[1:] == t.doc[:-1], 0, False)
    high = [(i, k) for i, k in zip(*np.nonzero(cos >= dc.COSINE)) if not last[i]]
    share = np.mean([(int(i), int(k)) in found for i, k in high])
    print(f"{share:.3f} of {len(high)} pairs")
    assert share >= 0.99


@pytest.mark.parametrize("share", [1 / 3, 0.9])
def test_widespread_item_is_found(spark, documents, share):
    """An item in many rows makes its own words common ones."""
    rng = random.Random(3)
    item = [f"w{k}" for k in range(20)]
    other = [f"v{k}" for k in range(40)]
    noise = lambda n: [rng.choice(other) if rng.random() < 0.2 else f"z{rng.randrange(900)}" for _ in range(n)]
    texts = [" ".join([*noise(k % 150), *(item if k % 60 < 60 * share else []), *noise(150 - k % 150)]) for k in range(120)]
    table = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    got = {r.doc_id: r.matches for r in dc.find(documents(texts), table).collect()}
    assert [[m.item_id for m in got[k]] for k in range(120)] == [[1] if k % 60 < 60 * share else [] for k in range(120)]
    assert all(abs(m.coverage - 1) < 1e-9 and 0 < m.cosine <= 1 + 1e-6 for own in got.values() for m in own)


@pytest.mark.parametrize("rows", [1, 2, 10])
def test_small_tables(spark, documents, bench, rows):
    texts = [f"before it {bench[k % 4]} and after it" for k in range(rows)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(bench[:4])], "item_id long, text string")
    got = {r.doc_id: r.matches for r in dc.find(documents(texts), table).collect()}
    assert [[m.item_id for m in got[k]] for k in range(rows)] == [[k % 4] for k in range(rows)]
