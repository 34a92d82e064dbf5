import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import toxicity

WORDS = [f"w{k}" for k in range(60)]


def texts(n, seed, bad):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = [rng.choice(WORDS) for _ in range(80)]
        if bad:
            at = rng.randrange(70)
            own[at : at + 3] = ["awful", rng.choice(WORDS), "nasty"]
        out.append(" ".join(own))
    return out


def rows():
    return [(t, 0) for t in texts(80, 1, False)] + [(t, 1) for t in texts(40, 2, True)]


def all_maximal(scores):
    """Scores of the maximal segments by their definition: the best one (the shortest, of equals), then those beside it."""
    spans = [(sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best, _, i, j = max(spans, default=(0, 0, 0, 0))
    return [*all_maximal(scores[:i]), best, *all_maximal(scores[j:])] if best > 0 else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.5, -2.25, -1.125, 1.0625, 2.03125, 4.015625]), max_size=12))
def test_segments_are_the_maximal_ones(scores):
    got = toxicity.segments(list(range(len(scores))), scores, -1.0)
    assert [s for *_, s in got] == all_maximal(scores)
    for a, b, s in got:
        assert sum(scores[a : b + 1]) == s


def test_gaps_count():
    assert toxicity.segments([0, 5], [3.0, 3.0], -1.0) == [(0, 0, 3.0), (5, 5, 3.0)]
    assert toxicity.segments([0, 2], [3.0, 3.0], -1.0) == [(0, 2, 5.0)]


def test_finds_passages_and_ranks():
    model = toxicity.fit(rows())
    good, bad = texts(30, 3, False), texts(30, 4, True)
    p = lambda t: model.probability(model.scan(t)[1])
    assert sum(p(t) >= 0.5 for t in bad) >= 28 and sum(p(t) >= 0.5 for t in good) <= 1
    _, found = model.scan(bad[0])
    best = min(found, key=lambda x: x[5])
    assert "awful" in bad[0][best[2] : best[3]] and "nasty" in bad[0][best[2] : best[3]]


def test_one_class():
    assert 0 < toxicity.fit([]).probability([]) < 1
    model = toxicity.fit([("a b", 0)] * 5)
    assert model.scan("a b")[1] == [] and model.probability([]) < 0.5


def test_odd_texts(spark, documents, odd):
    model = toxicity.fit(rows())
    many = [*odd, "awful nasty " * 20000]
    out = {r.doc_id: r for r in toxicity.score(documents(many), model).collect()}
    assert len(out) == len(many) and all(0 <= r.score <= 1 for r in out.values())
    assert out[0].score == out[1].score and out[4].score == out[5].score and out[0].passages == []
    last = out[len(many) - 1]
    assert last.passages and all(p.text == many[-1][p.start : p.end] for p in last.passages)
    assert toxicity.score(documents([]), model).collect() == []


def test_linear_in_hits():
    for gap in (1, 3, 6):  # a drift that is weak, even and strong
        start = time.monotonic()
        toxicity.segments([gap * k for k in range(500_000)], [1.0 + k % 3 for k in range(500_000)], -0.5)
        assert time.monotonic() - start < 10


def test_lower_case_keeps_places():
    assert toxicity.lowered("\u0130A \u0130B") == "\u0130a \u0130b" and toxicity.lowered("A\u00c9") == "a\u00e9"


def test_cluster_fit_is_the_local_fit(spark):
    own, local = toxicity.fit_table(spark.createDataFrame(rows(), "text string, y int").repartition(3)), toxicity.fit(rows())
    for name in ("words", "grams"):
        a, b = getattr(own, name), getattr(local, name)
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
    for name in ("lam", "k", "slope", "offset"):
        assert math.isclose(getattr(own, name), getattr(local, name), rel_tol=1e-6)
    assert toxicity.fit_table(spark.createDataFrame([], "text string, y int")).probability([]) == 0.5


def parts(scores):
    """(first, last, score) of the maximal segments by their definition: the best one, then those beside it."""
    todo, out = [(0, len(scores))], []
    while todo:
        lo, hi = todo.pop()
        best, total, start = (0.0, 0, 0), 0.0, lo
        for i in range(lo, hi):
            if total <= 0:
                total, start = 0.0, i
            total += scores[i]
            if total > best[0] + 1e-9:
                best = (total, start, i)
        if best[0] > 0:
            out.append((best[1], best[2], best[0]))
            todo += [(lo, best[1]), (best[2] + 1, hi)]
    return sorted(out)


def brute(model, text):
    """Score and passages of a text by definition."""
    found = list(re.finditer(r"\w+", toxicity.lowered(text or "")))
    scores = []
    for k, m in enumerate(found):
        own, w = model.words.get(m[0], 0.0), f"<{m[0]}>"
        odd = max([model.grams.get(w[i : i + n], 0.0) for n in (4, 5) for i in range(max(0, len(w) - n + 1))], default=0.0)
        value = 0.0 if k and found[k - 1][0] == m[0] else max(own, odd) if odd > 0 else own
        scores.append(value - toxicity.DRIFT)
    all_ = [(found[a].start(), found[b].end(), s, 1 - math.exp(-model.k * len(found) * math.exp(-model.lam * s))) for a, b, s in parts(scores)]
    x = math.log(1 - math.log10(max(1e-30, min([c for *_, c in all_], default=1.0))))
    return 1 / (1 + math.exp(-(model.slope * x + model.offset))), [p for p in all_ if p[3] <= toxicity.SIGNIFICANT]


@pytest.fixture(scope="module")
def learned(spark, sf):
    return toxicity.trained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_whole_query_by_definition(spark, sf, learned):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, learned).collect()}
    asked = {r.doc_id: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert got.keys() == asked.keys()
    for k, r in got.items():
        p, passages = brute(learned, r.text)
        assert math.isclose(r.score, p, abs_tol=1e-4) and math.isclose(asked[k].score, r.score, abs_tol=1e-9)
        assert asked[k].n_passages == len(r.passages) and asked[k].predicted == (asked[k].score >= 0.5)
        assert [(x.start, x.end) for x in r.passages] == [(a, b) for a, b, *_ in passages]
        assert all(math.isclose(x.score, s, abs_tol=1e-6) for x, (_, _, s, _) in zip(r.passages, passages))


def test_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    toxic, told, both = sum(y for _, y in held), sum(p for p, _ in held), sum(p and y for p, y in held)
    print(f"recall {both / toxic:.3f}, precision {both / told:.3f} of {toxic}")
    assert both >= 0.85 * toxic and both >= 0.9 * told
