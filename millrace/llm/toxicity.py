"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

*Tokens* are lower-cased runs of word characters.  *Log-odds* between toxic and clean training texts are
estimated for words and for the 4- and 5-grams of words with an informative Dirichlet prior (the pooled
counts of texts), and estimates within ``Z`` standard errors of zero count as zero.  A token has its word's
log-odds or that of its most toxic gram, whichever is higher, so inflected forms that training never showed
count too.  Less a drift, every token has a score that is negative on average, and one linear scan per text finds all maximal scoring segments (Ruzzo and Tompa).  For the background of clean
tokens, lambda solves sum p(s) exp(lambda s) = 1, so a segment of score S in a text of n tokens is as high by
chance with probability 1 - exp(-K n exp(-lambda S)); K is fitted to the clean training texts' best segments.
Segments below ``SIGNIFICANT`` are the toxic passages.  A logistic curve on the best segment's evidence,
fitted to the training texts, gives the document's score.

The fit uses at most about ``max_rows`` labelled rows (chosen by a hash of the id).  The cluster counts their words and
grams and scans them for the calibration; only log-odds that differ from zero and one best score per row reach the
driver.  Scanning covers whole texts.

Edge cases: null and empty texts, and texts without word characters, have no passage and the score of a text
without evidence; repeated rows are kept and score alike; without labelled rows of both classes no token has
log-odds and every score is the training share of toxic rows (0.5 without any); an empty table gives an empty
result.  Output columns replace columns of the same name; all others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_ROWS = 10000
PRIOR = 0.05  # of the pooled counts
Z = 3.0
MEMO = 1 << 20
HELD = 1 << 18  # counts that a task holds before it gives them on
DRIFT = 0.5
SIGNIFICANT = 0.01
_TOKEN = re.compile(r"\w+")


def segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order.

    ``at`` and ``scores``: the tokens with a positive or strongly negative score; every other token
    between them scores ``gap`` (negative).  One pass with a stack of candidates; a candidate holds its
    first and last token, the running totals left of it and at its end, and the place of the nearest one
    before it whose left total is lower.  The search for such a one follows these places, so each is
    passed over once; where there is none, all candidates so far are final and leave the stack.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    total, seen = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total += gap * (i - seen - 1)
        seen = i
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, j = i, before, len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:  # the two and all between them are one
            first, _, left, _, lower = stack[j]
            del stack[j:]
            j = lower
        if j < 0:
            done += [(a, b, r - lo) for a, b, lo, r, _ in stack]
            stack.clear()
        stack.append((first, i, left, total, j))
    return done + [(a, b, r - lo) for a, b, lo, r, _ in stack]


def lowered(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length, so that places stay those of ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def grams(word: str) -> set[str]:
    """The 4- and 5-grams of a word with its boundaries; words themselves are no grams."""
    w = f"<{word}>"
    return {w[i : i + k] for k in (4, 5) for i in range(len(w) - k + 1)}


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    grams: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def token(self, word: str) -> float:
        """A token's log-odds; remembered for the most recent words."""
        own, get = self.words.get(word, 0.0), self.grams.get
        best = max((get(g, 0.0) for g in grams(word)), default=0.0)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = best = max(own, best) if best > 0 else own
        return best

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int, float, float]]]:
        """(number of tokens, passages as (first token, last token, start, end, score, chance))."""
        low = lowered(text or "")
        tokens = _TOKEN.findall(low)
        memo, known = self.memo, self.memo.get
        for w in {w for w in tokens if w not in memo}:
            self.token(w)
        last = [None, *tokens]  # a token that only repeats the one before it is no evidence of its own
        hits = [(i, v) for i, (w, b) in enumerate(zip(tokens, last)) if ((v := known(w)) or (v is None and (v := self.token(w)))) and w != b]
        if not any(v > DRIFT for _, v in hits):
            return len(tokens), []
        found = segments([i for i, _ in hits], [v - DRIFT for _, v in hits], -DRIFT)
        spans = None
        out = []
        for a, b, s in found:
            chance = self.chance(len(tokens), s)
            if spans is None:
                spans = [m.span() for m in _TOKEN.finditer(low)]
            out.append((a, b, spans[a][0], spans[b][1], s, chance))
        return len(tokens), out

    def chance(self, n: int, s: float) -> float:
        """Of a segment as high as ``s`` among ``n`` tokens by chance."""
        return -math.expm1(-self.k * n * math.exp(-min(self.lam * s, 700)))

    def best(self, text: str | None) -> tuple[int, float]:
        """(number of tokens, score of the best segment or -inf)."""
        n, found = self.scan(text)
        return n, max((p[4] for p in found), default=-math.inf)

    def evidence(self, passages: list) -> float:
        """log(1 - log10 of the chance of the best passage): a few strong passages don't outweigh the many weak ones."""
        return math.log1p(-math.log10(max(1e-30, min((p[5] for p in passages), default=1.0))))

    def probability(self, passages: list) -> float:
        x = self.slope * self.evidence(passages) + self.offset
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _lambda(counts: dict[float, int]) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 for scores with a negative mean."""
    total = sum(counts.values())
    if not total or max(counts) <= 0:
        return 1.0
    f = lambda x: sum(n / total * math.exp(min(700.0, x * s)) for s, n in counts.items()) - 1
    low, high = 1e-6, 1.0
    if f(low) >= 0:
        return 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _log_odds(words: list[str], clean: np.ndarray, toxic: np.ndarray, size: tuple[float, float]) -> dict[str, float]:
    """Log-odds that differ from zero by ``Z`` standard errors; ``size``: all counts of clean and of toxic texts."""
    total = PRIOR * sum(size)
    prior = PRIOR * (clean + toxic)
    x, y = toxic + prior, clean + prior
    d = np.log(x / (size[1] + total - x)) - np.log(y / (size[0] + total - y))
    far = np.flatnonzero(np.abs(d) > Z * np.sqrt(1 / x + 1 / y))
    return {words[k]: float(d[k]) for k in far}


def _start(n: int, n1: int) -> Model:
    share = (n1 + 1) / (n + 2)
    return Model(offset=math.log(share / (1 - share)))


def _background(model: Model, clean: dict[float, int]) -> None:
    """Lambda of the scores' counts in clean texts; a score that those never show still has some chance."""
    counts = Counter(clean)
    for v in {*model.words.values(), *model.grams.values()}:
        if v > DRIFT:
            counts[round(v - DRIFT, 2)] += 1
    model.lam = _lambda(counts)


def _calibrate(model: Model, best: list[tuple[int, int, float]]) -> None:
    """K and the logistic curve, of (label, number of tokens, best score or -inf) of the training texts."""
    clean = [(n, s) for y, n, s in best if not y and n]
    scores = sorted(s for _, s in clean if s > -math.inf)
    # of n tokens, K n exp(-lambda S) passages are expected; matched at the median best score of clean texts
    if scores:
        level = scores[len(scores) // 2]
        over = sum(s >= level for s in scores)
        model.k = max(1e-6, over * math.exp(min(700.0, model.lam * level)) / sum(n for n, _ in clean))
    x = np.array([model.evidence([(0, 0, 0, 0, s, model.chance(n, s))] if s > -math.inf else []) for _, n, s in best])
    y = np.array([v for v, _, _ in best], float)
    weight = np.array([0.0, 0.0])
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ weight, -60, 60)))
        grad = design.T @ (p - y) + 1e-2 * weight
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        weight -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = map(float, weight)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Learn from (text, 1 if toxic) rows in this process."""
    n1 = sum(y for _, y in rows)
    model = _start(len(rows), n1)
    if not n1 or n1 == len(rows):
        return model
    seen = (Counter(), Counter())  # texts with each word
    for text, y in rows:
        seen[y].update(set(_TOKEN.findall(lowered(text))))
    parts = (Counter(), Counter())
    for own, part in zip(seen, parts, strict=True):
        for w, n in own.items():
            for g in grams(w):
                part[g] += n
    for name, (clean, toxic) in (("words", seen), ("grams", parts)):
        keys = sorted(clean.keys() | toxic.keys())
        odds = _log_odds(keys, np.array([clean[k] for k in keys], float), np.array([toxic[k] for k in keys], float), (sum(clean.values()), sum(toxic.values())))
        setattr(model, name, {k: v for k, v in odds.items() if v > 0 or name == "words"})
    counts: Counter = Counter()
    for w, b in seen[0].items():
        counts[round(model.token(w) - DRIFT, 2)] += b
    _background(model, counts)
    _calibrate(model, [(y, *model.best(text)) for text, y in rows])
    return model


COUNTS = "key string, clean long, toxic long"


def _counted(rows: DataFrame, keys, weights) -> DataFrame:
    """(key, clean, toxic) added up over ``rows``; keys(batch) gives each row's keys, weights(batch) its two counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()

        def emit() -> pa.RecordBatch:
            own = list(clean.keys() | toxic.keys())
            out = pa.RecordBatch.from_pydict({"key": pa.array(own, pa.string()), "clean": pa.array([clean[k] for k in own], pa.int64()), "toxic": pa.array([toxic[k] for k in own], pa.int64())})
            clean.clear()
            toxic.clear()
            return out

        for batch in batches:
            for own, (a, b) in zip(keys(batch), weights(batch), strict=True):
                for k in own:
                    if a:
                        clean[k] += a
                    if b:
                        toxic[k] += b
            if len(clean) + len(toxic) > HELD:
                yield emit()
        yield emit()

    return rows.mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _far(counts: DataFrame, only_toxic: bool) -> dict[str, float]:
    """Log-odds of (key, clean, toxic); keys too near zero do not leave the cluster."""
    size = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total = PRIOR * sum(size)
    x, y = (F.col(c) + PRIOR * (F.col("clean") + F.col("toxic")) for c in ("toxic", "clean"))
    d = F.log(x / (F.lit(size[1] + total) - x)) - F.log(y / (F.lit(size[0] + total) - y))
    got = counts.where(F.abs(d) > 0.999 * Z * F.sqrt(1 / x + 1 / y)).orderBy("key").toArrow()
    numbers = [got[c].to_numpy().astype(float) for c in ("clean", "toxic")]
    odds = _log_odds(got["key"].to_pylist(), *numbers, tuple(size))
    return {k: v for k, v in odds.items() if v > 0 or not only_toxic}


def fit_table(sample: DataFrame) -> Model:
    """Learn from a table (text, y); the same model as that of ``fit``."""
    spark = sample.sparkSession
    scratch = common.Scratch(spark, "toxicity")
    sample = sample.select("text", F.col("y").cast("int").alias("y"))
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = _start(n, n1)
    if not n1 or n1 == n:
        return model
    ones = ((1, 0), (0, 1))
    words = _counted(
        sample,
        lambda batch: (set(_TOKEN.findall(lowered(t))) for t in batch.column(0).to_pylist()),
        lambda batch: (ones[y] for y in batch.column(1).to_pylist()),
    )
    words = scratch.keep(words, "words")
    model.words = _far(words, False)
    parts = _counted(words, lambda batch: map(grams, batch.column(0).to_pylist()), lambda batch: zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    model.grams = _far(scratch.keep(parts, "grams"), True)
    shared = spark.sparkContext.broadcast(model)  # the log-odds of max_rows texts

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            own = [round(m.token(w) - DRIFT, 2) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"level": pa.array(own, pa.float64()), "n": batch.column(1)})

    got = words.mapInArrow(levels, "level double, n long").groupBy("level").agg(F.sum("n").alias("n")).where("n > 0").orderBy("level").collect()
    _background(model, {r["level"]: r["n"] for r in got})

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            own = [m.best(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "n": pa.array([x[0] for x in own], pa.int64()), "best": pa.array([x[1] for x in own], pa.float64())})

    got = sample.mapInArrow(bests, "y int, n long, best double").toArrow()
    _calibrate(model, sorted(zip(*(got[c].to_pylist() for c in ("y", "n", "best")), strict=True)))
    scratch.drop("words", "grams")
    return model


PASSAGE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("chance", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", passages: str = "passages") -> DataFrame:
    """``docs`` with the probability that a text is toxic and its significant passages (character offsets)."""
    own = docs.drop(out, passages)
    schema = T.StructType([*own.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(passages, T.ArrayType(PASSAGE))])
    at = own.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of max_rows texts
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, found = [], []
            for t in batch.column(at).to_pylist():
                _, got = m.scan(t)
                scores.append(m.probability(got))
                found.append([{"start": s, "end": e, "score": v, "chance": c, "text": t[s:e]} for _, _, s, e, v, c in got if c <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=schema.names)

    return own.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    return fit_table(common.labelled_sample(docs, labels, "toxic", max_rows))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity and its number of toxic passages; learned outside fold 0."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
