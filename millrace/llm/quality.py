"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character 3- to 5-grams
(inside words, with their boundaries; a word that follows itself makes one common pair); a softmax layer on that average gives the class.  Vectors and layer
are trained together by stochastic gradient descent in numpy.  Since softmax is linear in the average, a
trained model folds into one number per bucket, and a text is scored by looking its grams up in that table.

The fit uses at most about ``max_rows`` labelled rows (chosen by a hash of the id); scoring covers whole texts.

Edge cases: null and empty texts, and texts of whitespace only, have no grams and get the score of the bias
alone; repeated rows are kept and score alike; without labelled rows every score is 0.5; with one class only
the model learns that class; an empty table gives an empty result.  Output columns replace columns of the
same name; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_ROWS = 4000
THRESHOLD = 0.3
_P = np.uint32(0x01000193)
_POW = np.array([pow(0x01000193, k, 1 << 32) for k in range(6)], np.uint32)
_INV = pow(0x01000193, -1, 1 << 32)
#: Unicode's whitespace below U+0100; others count as characters of words.
_SPACE = np.zeros(0x100, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = True


class Grams:
    """The hashed grams of some texts: ``bucket`` ids with the ``doc`` (position in the block) of each.

    ``sums(values)`` adds a value per bucket over each text's grams without listing them by text.
    """

    def __init__(self, texts: list[str], buckets: int):
        self.n = len(texts)
        cps = common.codepoints(" " + " ".join(texts) + " ")
        length = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]  # the space before each text
        self.end = self.start + 1 + length
        space = np.zeros(len(cps), bool)
        low = cps < 0x100
        space[low] = _SPACE[cps[low]]
        mask = np.uint32(buckets - 1)
        self.char: list[tuple[np.ndarray, np.ndarray]] = []  # (position, bucket) by size of gram
        size = len(cps)
        for k in (3, 4, 5):
            m = size - k + 1
            if m <= 0:
                continue
            ok = ~space[1 : m + 1]
            for j in range(2, k - 1):
                ok &= ~space[j : m + j]
            at = np.flatnonzero(ok)
            h = np.full(len(at), k, np.uint32)
            for j in range(k):
                h += cps[at + j] * _POW[j]
            self.char.append((at, common.mix32(h) & mask))
        edge = np.flatnonzero(np.diff(space.astype(np.int8)))
        first, last = edge[::2] + 1, edge[1::2] + 1  # words lie in [first, last)
        self.word_at = first
        if len(first):
            power = np.full(size, _P, np.uint32)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint32)
            back = np.full(size, _INV, np.uint32)
            back[0] = 1
            back = np.cumprod(back, dtype=np.uint32)
            total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(cps * power, dtype=np.uint32)])
            w = (total[last] - total[first]) * back[first]
            self.word = common.mix32(w + np.uint32(77)) & mask
            doc = np.searchsorted(self.start, first, "right") - 1
            same = np.flatnonzero(doc[1:] == doc[:-1])
            self.pair_at = first[same]
            self.pair = common.mix32(w[same] * np.uint32(0x9E3779B1) + w[same + 1]) & mask
            self.pair[w[same] == w[same + 1]] = buckets - 1  # all repetitions of a word are one gram
        else:
            self.word = self.pair = np.zeros(0, np.uint32)
            self.pair_at = first

    def _all(self):
        yield from self.char
        yield self.word_at, self.word
        yield self.pair_at, self.pair

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of ``values`` over the grams, number of grams) of each text."""
        total, count = np.zeros(self.n), np.zeros(self.n, np.int64)
        for at, bucket in self._all():
            run = np.concatenate([[0.0], np.cumsum(values[bucket], dtype=np.float64)])
            a, b = np.searchsorted(at, self.start), np.searchsorted(at, self.end)
            total += run[b] - run[a]
            count += b - a
        return total, count

    def by_text(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct buckets, their shares of the text's grams) of each text."""
        out = []
        cut = [(np.searchsorted(at, self.start), np.searchsorted(at, self.end), bucket) for at, bucket in self._all()]
        for i in range(self.n):
            ids, n = np.unique(np.concatenate([bucket[a[i] : b[i]] for a, b, bucket in cut]), return_counts=True)
            out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
        return out


@dataclass
class Model:
    """``table``: what each bucket adds to the log-odds of class 1 when it is the whole text."""

    table: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total, count = Grams(texts, len(self.table)).sums(self.table)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -60, 60)))


def fit(
    rows: list[tuple[str, int]], buckets: int = 1 << 17, dim: int = 16, epochs: int = 5, least_steps: int = 6000, rate: float = 0.5, seed: int = 7
) -> Model:
    """Train on (text, 0 or 1) rows, ``epochs`` times each and more often until ``least_steps``; buckets is a power of two."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for _, texts in common.blocks([t for t, _ in rows]):
        own = Grams(texts, buckets).by_text()
        # one array for a block's texts: half the size, and given back to the system when the fit is done
        ids, shares = np.concatenate([i for i, _ in own]).astype(np.uint32), np.concatenate([s for _, s in own])
        cut = np.cumsum([0, *(len(i) for i, _ in own)])
        grams += [(ids[a:b], shares[a:b]) for a, b in zip(cut, cut[1:])]
    y = [label for _, label in rows]
    epochs = max(epochs, -(-least_steps // max(1, len(rows))))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = grams[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            v = share @ e[ids]
            z = w @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ w
            w -= step * np.outer(p, v)
            bias -= step * p * np.float32(0.1)
            # a bucket's share is small, so its vector takes a step of the size that fits its text
            e[ids] -= (step * np.sqrt(share))[:, None] * back
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1."""
    own = docs.drop(out)
    schema = T.StructType([*own.schema.fields, T.StructField(out, T.DoubleType())])
    at = own.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.score(texts) for _, texts in common.blocks(batch.column(at).to_pylist())]
            flat = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat)], names=schema.names)

    return own.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    return fit(common.collected_sample(common.labelled_sample(docs, labels, "quality", max_rows)))


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that the classifier rejects go; columns stay as they are."""
    model = trained(docs, common.table(spark, sf_dir, "labels"))
    own = common.unused(docs, "quality_score")
    return score(docs, model, out=own).where(F.col(own) >= THRESHOLD).drop(own)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; learned outside fold 0."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
