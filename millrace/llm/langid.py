"""Language ID: one Bloom filter of n-grams per language, stored bit-sliced.

Slot j of the table holds a bit per language: whether that language's filter has bit j.  One AND over an
n-gram's slots gives the set of all languages that contain it.  Per language the number of n-grams that it
contains is corrected for the filter's false positives, (hits - n f) / (1 - f) with f = fill ** hashes, and
the largest corrected count decides.

A language contains the n-grams (3- and 4-grams of lower-cased letters, inside words with their boundaries)
that it shows at least ``MIN_COUNT`` times and at ``SHARE`` of the highest rate of any language or more.  The
fit uses at most about ``max_rows`` rows with a language (chosen by a hash of the id), but at least ``LEAST_ROWS`` of
each of the ``MAX_LANGS`` most frequent languages where there are as many; prediction covers whole texts.

Edge cases: a null text or one without letters is ``und`` with score 0; with letters but without any known
n-gram it gets the most frequent learned language and score 0; ties go to the language that is more frequent
in training, then to the first in the alphabet; without training rows all predictions are ``und``; repeated
rows are kept; an empty table gives an empty result.  Output columns replace columns of the same name; all
others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_ROWS = 4000
LEAST_ROWS, MAX_LANGS = 50, 256
SHARE = 0.2
MIN_COUNT = 3
SLOTS = 1 << 20
HASHES = 2
SIZES = (3, 4)
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first hash of each text, one past its last, whether the text has letters) over all texts."""
    low = [t.lower() for t in texts]
    cps = common.codepoints(" " + " ".join(low) + " ").copy()
    length = np.array([len(t) for t in low], np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    end = start + 1 + length
    letter = letters()[cps]
    cps[~letter] = 32
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = seen[end] > seen[start]
    at, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in SIZES:
        m = len(cps) - k + 1
        if m <= 0:
            continue
        ok = letter[1 : m + 1].copy()
        for j in range(2, k - 1):
            ok &= letter[j : m + j]
        own = np.flatnonzero(ok)
        h = np.full(len(own), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + cps[own + j]
        at.append(own)
        out.append(common.mix64(h))
    where, hashes = np.concatenate(at), np.concatenate(out)
    order = np.argsort(where, kind="stable")
    where, hashes = where[order], hashes[order]
    return hashes, np.searchsorted(where, start), np.searchsorted(where, end), has


@dataclass
class Model:
    """``planes``: per 64 languages one table of slots; ``rate``: each filter's rate of false positives."""

    langs: list[str] = field(default_factory=list)
    planes: list[np.ndarray] = field(default_factory=list)
    rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        a, b = hashes & np.uint64(SLOTS - 1), (hashes >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(i) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        hashes, start, end, has = ngrams(texts)
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        where = self.slots(hashes)
        hits = np.zeros((len(texts), len(self.langs)))
        for p, plane in enumerate(self.planes):
            found = plane[where[0]]
            for w in where[1:]:
                found &= plane[w]
            for bit in range(min(64, len(self.langs) - 64 * p)):
                run = np.concatenate([[0], np.cumsum((found >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
                hits[:, 64 * p + bit] = run[end] - run[start]
        n = (end - start)[:, None]
        corrected = np.maximum(0, (hits - n * self.rate) / np.maximum(1e-9, 1 - self.rate))
        best, total = corrected.argmax(1), corrected.sum(1)
        share = np.where(total > 0, corrected.max(1) / np.maximum(total, 1e-12), 0.0)
        return [(self.langs[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, share, has, strict=True)]


def fit(rows: list[tuple[str, str]]) -> Model:
    """Learn from (text, language) rows."""
    by_lang: dict[str, list[str]] = {}
    for text, lang in rows:
        by_lang.setdefault(lang, []).append(text)
    langs = sorted(by_lang, key=lambda x: (-len(by_lang[x]), x))
    if not langs:
        return Model()
    grams, counts = [], []
    for lang in langs:
        own: list[np.ndarray] = []
        n: list[np.ndarray] = []
        for _, texts in common.blocks(by_lang[lang], 1 << 20):
            u, c = np.unique(ngrams(texts)[0], return_counts=True)
            own.append(u)
            n.append(c)
        u, back = np.unique(np.concatenate(own), return_inverse=True)
        grams.append(u)
        counts.append(np.bincount(back, np.concatenate(n), len(u)))
    known = np.unique(np.concatenate(grams))
    rates = np.zeros((len(langs), len(known)))
    for r, g, c in zip(rates, grams, counts, strict=True):
        r[np.searchsorted(known, g)] = np.where(c >= MIN_COUNT, c / max(1, c.sum()), 0)
    top = rates.max(0)
    model = Model(langs, [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(langs) // 64))])
    rate = []
    for i, r in enumerate(rates):
        plane, bit = model.planes[i // 64], np.uint64(1 << (i % 64))
        for w in model.slots(known[(r > 0) & (r >= SHARE * top)]):
            plane[w] |= bit
        rate.append((((plane & bit) != 0).mean()) ** HASHES)
    model.rate = np.array(rate)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the winner's share of the corrected counts."""
    own = docs.drop(out, score)
    schema = T.StructType([*own.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    at = own.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [x for _, texts in common.blocks(batch.column(at).to_pylist()) for x in m.predict(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                names=schema.names,
            )

    return own.mapInArrow(run, schema)


def trained(docs: DataFrame, max_rows: int = MAX_ROWS, least: int = LEAST_ROWS, max_bytes: int = common.SAMPLE_BYTES) -> Model:
    """Fit on about ``max_rows`` documents outside the held-out fold that have a text and a language.

    Of each of the ``MAX_LANGS`` most frequent languages about ``least`` documents at least are taken, if there are as many.
    A document that repeats counts once (its least text); ``max_bytes`` bounds the texts.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(common.fold() != 0)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.01).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    sizes = [(r["lang"], r["n"]) for r in sizes.collect()]
    if not sizes:
        return Model()
    total = sum(n for _, n in sizes)
    share = [(lang, min(1.0, max(max_rows / total, least / max(1, n)))) for lang, n in sizes]
    chosen = spark.createDataFrame([(lang, int(s * (1 << 30))) for lang, s in share], "lang string, bound long")
    own = rows.select(F.col("doc_id").alias("id"), "text", "lang").join(F.broadcast(chosen), "lang")
    own = own.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < F.col("bound")).groupBy("id", "lang").agg(F.min("text").alias("text"))
    scratch = common.Scratch(spark, "language")
    got = common.within_bytes(scratch.keep(own, "sample"), max_bytes).toArrow()
    scratch.drop("sample")
    rows = sorted(zip(got["id"].to_pylist(), got["text"].to_pylist(), got["lang"].to_pylist(), strict=True))
    return fit([(text, lang) for _, text, lang in rows])


def op8_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language; learned outside fold 0."""
    docs = common.table(spark, sf_dir, "documents")
    model = trained(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
