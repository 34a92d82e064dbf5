"""Benchmark decontamination: latent semantic retrieval, then common subsequences and answers.

Words are lower-cased runs without white space and ASCII punctuation; only the benchmark's words can count, so
all others are one blank.

1. One pass counts in how many passages of the corpus (``WINDOW`` words) each benchmark word stands: its smoothed
   idf, which is above 0 for all.  In the latent space only words weigh that are among those that make up
   ``ENERGY`` of some item's squared weight, so an item of nothing but widespread words keeps them.
2. One pass sketches the Gram matrix of the TF-IDF passages, Y = A'A R with a random R, summed by the cluster
   in slices of words.  A Nystrom step turns the sketch into the corpus's ``EXTRA`` leading right singular vectors with
   their values; those and the benchmark's passages, stacked with equal weight, are decomposed again, and the
   ``RANK`` leading vectors are the latent space.
3. One pass slides windows of ``WINDOW`` words by half their length over every whole text and takes each window's
   cosine with every benchmark passage in the latent space.  Pairs of ``COSINE`` or more are checked in the text
   around the window: of the item's answer (its rarest quarter of words) a share of ``ANSWER`` must stand there, and
   the item's pieces of ``PIECE`` words must be found again.  A piece counts with the heaviest common subsequence
   (by idf) that stands within ``SPAN`` words; all pieces together must reach ``COVERAGE`` of the item's weight, and
   below ``STRONG`` also ``ORDER`` times what they reach in the text read backwards, where only chance finds them.  So
   paraphrases are found that replace words or turn the order of phrases around, and shared words alone prove nothing.

The benchmark is the stated query set: its words and passages are held by the driver and sent to the tasks in
blocks of ``BLOCK`` passages, each with a latent space of its own over its own words (step 2 runs once), so what is
sent grows in proportion to the benchmark and not with the corpus.

Edge cases: null and empty texts match nothing; an item with fewer than ``LEAST`` words matches where all its words stand
one after another; equal items match alike; repeated rows are kept and match alike; items without words match
nothing; without items or documents nothing matches.  The column ``matches`` is replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 64
HALF = WINDOW // 2
BLOCK = 256
EXTRA, OVER = 32, 16
RANK = 192
ENERGY = 0.9
COSINE = 0.4
PIECE, SPAN = 8, 12
COVERAGE, STRONG, ORDER = 0.35, 0.6, 1.3
ANSWER = 0.25
LEAST = 5
SLICES = 16
SPLITS = 64  # so many splits of the scan share a partial matrix
SEED = 11
#: White space and ASCII punctuation become spaces.
_SPACED = bytes(i if i >= 128 or chr(i).isalnum() or i == 95 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bits of ``a`` in one integer, one step per element of ``b``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def heaviest(a: list[int], b: list[int], weight: list[float]) -> float:
    """Weight of the heaviest common subsequence; ``weight`` is that of the elements of ``a``."""
    row = [0.0] * (len(a) + 1)
    for y in b:
        before = 0.0  # of the row above, one place to the left
        for i, x in enumerate(a, 1):
            held = row[i]
            if x == y and before + weight[i - 1] > held:
                row[i] = before + weight[i - 1]
            elif row[i - 1] > held:
                row[i] = row[i - 1]
            before = held
    return row[-1]


@dataclass
class Item:
    """An item's words (ids), their weights, and its answer."""

    item_id: int
    ids: list[int]
    answer: set[int]
    weights: list[float]

    def __post_init__(self):
        self.total = sum(self.weights)
        n = max(1, len(self.ids) // PIECE)
        cuts = [len(self.ids) * k // n for k in range(n + 1)]
        self.pieces = [(self.ids[a:b], self.weights[a:b], set(self.ids[a:b])) for a, b in zip(cuts, cuts[1:])]

    def coverage(self, near: list[int]) -> float:
        """The share of the item's weight that its pieces find again in ``near``, each within ``SPAN`` words."""
        where: dict[int, list[int]] = {}
        for i, x in enumerate(near):
            where.setdefault(x, []).append(i)
        sums = []
        for ids, weights, own in self.pieces:
            at = sorted(i for x in own for i in where.get(x, ()))
            best, full, end, last = 0.0, sum(weights), 0, -1
            for k, i in enumerate(at):
                while end < len(at) and at[end] < i + SPAN:
                    end += 1
                if end > last:  # else all of it stood in the stretch before
                    best = max(best, heaviest(ids, [near[j] for j in at[k:end]], weights))
                    last = end
                if best >= full - 1e-9:
                    break
            sums.append(best)
        return sum(sums) / self.total

    def held(self, near: list[int]) -> float:
        """The coverage if the text holds the item, else 0."""
        share = self.coverage(near)
        if share < COVERAGE - 1e-9 or share < STRONG - 1e-9 and share < ORDER * self.coverage(near[::-1]):
            return 0.0
        return share


class Tokens:
    """Word ids of a block of texts, 0 for words that no benchmark item has."""

    def __init__(self, texts: list[str], vocabulary: dict[bytes, int]):
        get = vocabulary.get
        own = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in map(words, texts)]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        self.ids = np.concatenate(own) if own else np.zeros(0, np.int32)
        n = np.diff(self.start)
        halves = -(-n // HALF)
        first = np.concatenate([[0], np.cumsum(halves)])[:-1]
        self.doc = np.repeat(np.arange(len(own)), halves)
        self.at = self.start[self.doc] + (np.arange(len(self.doc)) - first[self.doc]) * HALF  # where each half window begins

    def known(self, local: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places of words, their ids), of words that ``local`` has an id for."""
        ids = self.ids if local is None else local[self.ids]
        at = np.flatnonzero(ids)
        return at, ids[at]

    def halves(self, values: np.ndarray, local: np.ndarray | None = None) -> np.ndarray:
        """The sum of the words' rows of ``values`` over each half window."""
        out = np.zeros((len(self.at), values.shape[1]), np.float32)
        known, ids = self.known(local)
        cut = np.searchsorted(known, self.at)
        full = np.flatnonzero(np.diff(np.append(cut, len(known))))
        if len(full):
            out[full] = np.add.reduceat(values[ids], cut[full], 0)
        return out


def _blocks(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 18):
    for batch in batches:
        yield from common.blocks(batch.column(at).to_pylist(), most)


# ------------------------------------------------------------------------- statistics
def passage_counts(docs: DataFrame, text: str, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """(number of passages with each word, number of passages) over all texts; words are added by the cluster."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts = np.zeros(len(own) + 1, np.int64)
        for _, texts in _blocks(batches, 0):
            t = Tokens(texts, own)
            whole = np.concatenate([[0], np.cumsum(-(-np.diff(t.start) // WINDOW))])
            known, ids = t.known()
            doc = np.searchsorted(t.start, known, "right") - 1
            passage = whole[doc] + (known - t.start[doc]) // WINDOW
            pairs = np.unique(passage * (len(own) + 1) + ids)
            counts += np.bincount(pairs % (len(own) + 1), minlength=len(counts))
            counts[0] += whole[-1]
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.int64()), "n": pa.array(counts[seen])})

    rows = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows["word"].to_numpy()] = rows["n"].to_numpy()
    return out, int(out[0])


def _gram(own: Tokens, local: np.ndarray, weighted: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Add A'A R of the block's passages (two half windows each) to ``out``; ``weighted`` is R times idf."""
    known, ids = own.known(local)
    if not len(known):
        return
    half = own.halves(weighted, local)
    pair = (own.at - own.start[own.doc]) // HALF // 2  # the passage of a half window within its text
    new = np.concatenate([[True], (own.doc[1:] != own.doc[:-1]) | (pair[1:] != pair[:-1])])
    passage = np.cumsum(new) - 1
    z = np.add.reduceat(half, np.flatnonzero(new), 0)
    of = passage[np.searchsorted(own.at, known, "right") - 1]
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out[ids[cut]] += np.add.reduceat(z[of[order]], cut, 0) * weight[ids[cut], None]


def sketch(docs: DataFrame, text: str, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """A'A R over all passages of all texts: one matrix of words x rank, added up in slices of words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, idf))
    step = -(-len(idf) // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        weighted = test_matrix(len(weight), rank) * weight[:, None]
        local = np.where(weight > 0, np.arange(len(weight)), 0)
        out = np.zeros((len(weight), rank), np.float32)
        for _, texts in _blocks(batches, 0):
            _gram(Tokens(texts, own), local, weighted, weight, out)
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([out[k * step : (k + 1) * step].tobytes() for k in range(SLICES)], pa.binary())}
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(part.as_py(), np.float32)
                total[k] = total[k] + part if k in total else part.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "part": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    # one partial matrix per task: some splits share it, so that matrices stay few and a lost task repeats little
    own = docs.select(text)
    splits = own.rdd.getNumPartitions()
    own = own.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-splits // SPLITS)))
    rows = own.mapInArrow(run, "slice int, part binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, part binary").collect()
    out = np.zeros((len(idf), rank))
    for r in rows:
        part = np.frombuffer(r["part"], np.float64).reshape(-1, rank)
        out[r["slice"] * step : r["slice"] * step + len(part)] = part
    return out


def test_matrix(n: int, rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, rank), np.float32)


def latent(y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Leading right singular vectors, times their values, of the A whose A'A has the sketch ``y`` = A'A test (Nystrom)."""
    y, test = y.astype(np.float64), test.astype(np.float64)
    shift = 1e-7 * max(1e-12, float(np.linalg.norm(y)))
    y = y + shift * test
    core = test.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 0) * 1e-9
    root = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, values, _ = np.linalg.svd(root, full_matrices=False)
    return u * values


def stacked(*parts: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading left singular vectors of columns side by side, the parts scaled to equal total weight."""
    scaled = [x / norm for x in parts if (norm := float(np.linalg.norm(x))) > 1e-12]
    if not scaled:
        return np.zeros((len(parts[0]), 1))
    u, values, _ = np.linalg.svd(np.hstack(scaled), full_matrices=False)
    return u[:, :rank][:, values[:rank] > 1e-6 * float(values.max())]


# ----------------------------------------------------------------------------- search
@dataclass
class Query:
    """A block of benchmark passages: ``space`` is idf times the latent vectors of the block's words, ``passages`` have length 1 in it."""

    words: np.ndarray  # ids of the words that weigh something here
    space: np.ndarray
    passages: np.ndarray
    item_of: list[int]
    items: list[Item]
    n_words: int

    def __post_init__(self):
        self.sizes = np.array([len(x.ids) for x in self.items], np.int64)
        self.local = np.zeros(self.n_words, np.int32)
        self.local[self.words] = np.arange(1, len(self.words) + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("sizes", "local")}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self.__post_init__()

    def candidates(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in ``items``, cosine) of all pairs of ``COSINE`` or more; a window begins at a half window."""
        half = t.halves(self.space, self.local)
        x = half.copy()
        x[:-1][t.doc[1:] == t.doc[:-1]] += half[1:][t.doc[1:] == t.doc[:-1]]
        # the last half of a text with several is the second half of the window before
        last = np.concatenate([t.doc[1:] != t.doc[:-1], [True]]) & np.concatenate([[False], t.doc[1:] == t.doc[:-1]])
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        ok = np.flatnonzero((norm > 1e-6) & ~last)
        cos = (x[ok] @ self.passages.T) / norm[ok, None]
        w, p = np.nonzero(cos >= COSINE)
        return ok[w], np.array(self.item_of, np.int64)[p], cos[w, p]

    def matches(self, t: Tokens, out: list[dict[int, tuple[float, float]]]) -> None:
        """Adds (cosine, coverage) of each item that a text holds to its map, best window only."""
        w, item, cos = self.candidates(t)
        size = self.sizes[item]
        begin = np.maximum(t.start[t.doc[w]], t.at[w] - size).tolist()
        end = np.minimum(t.start[t.doc[w] + 1], t.at[w] + WINDOW + size).tolist()
        seen, there = (-1, -1), set()
        for k, a, b, doc, c in zip(item.tolist(), begin, end, t.doc[w].tolist(), cos.tolist(), strict=True):
            own = self.items[k]
            if (a, b) != seen:
                near = t.ids[a:b].tolist()
                seen, there = (a, b), set(near)
            if len(own.answer & there) < ANSWER * len(own.answer):
                continue
            if sum(v for x, v in zip(own.ids, own.weights, strict=True) if x in there) < (COVERAGE - 1e-9) * own.total:
                continue
            share = own.held(near)
            if share > out[doc].get(own.item_id, (0.0, 0.0))[1]:
                out[doc][own.item_id] = (min(1.0, c), min(1.0, share))


@dataclass
class Asked:
    """The whole benchmark: blocks of passages, and the items too short for them."""

    vocabulary: dict[bytes, int]
    blocks: list[Query]
    short: list[tuple[int, list[int]]]

    def matches(self, texts: list[str]) -> list[list[tuple[int, float, float]]]:
        """Per text (item id, cosine, coverage) of each item that it holds."""
        out: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
        t = Tokens(texts, self.vocabulary)
        if len(t.ids):
            for q in self.blocks:
                q.matches(t, out)
            for i, ids in self.short:
                at = np.flatnonzero(t.ids[: len(t.ids) - len(ids) + 1] == ids[0])
                for k, x in enumerate(ids[1:], 1):
                    at = at[t.ids[at + k] == x]
                doc = np.searchsorted(t.start, at, "right") - 1
                for d in doc[t.start[doc + 1] >= at + len(ids)].tolist():
                    out[d][i] = (1.0, 1.0)
        return [[(k, c, s) for k, (c, s) in sorted(own.items())] for own in out]


def queries_of(docs: DataFrame, bench: DataFrame, text: str, item: str, item_text: str, block: int) -> Asked:
    rows = bench.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long"), F.col(item_text)).toArrow()
    listed = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    tokens = [(i, w) for i, t in listed if (w := words(t))]
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, own in tokens for w in own}))}
    coded = [(i, [vocabulary[w] for w in own]) for i, own in tokens]
    asked = Asked(vocabulary, [], [(i, ids) for i, ids in coded if len(ids) < LEAST])
    coded = [(i, ids) for i, ids in coded if len(ids) >= LEAST]
    if not coded:
        return asked
    counts, passages = passage_counts(docs, text, vocabulary)
    idf = np.log1p((passages + 1) / (counts + 1))
    idf[0] = 0
    heavy = np.zeros(len(idf), bool)
    items, pieces = [], []
    for i, ids in coded:
        own, n = np.unique(ids, return_counts=True)
        energy = (idf[own] * n) ** 2
        order = np.argsort(-energy, kind="stable")
        heavy[own[order[: 1 + int(np.searchsorted(np.cumsum(energy[order]), ENERGY * energy.sum()))]]] = True
        rare = sorted(set(ids), key=lambda x: (counts[x], x))
        items.append(Item(i, ids, set(rare[: max(2, -(-len(rare) // 4))]), idf[ids].tolist()))
        parts = -(-len(ids) // WINDOW)
        for k in range(parts):
            pieces.append((len(items) - 1, ids[len(ids) * k // parts : len(ids) * (k + 1) // parts]))
    weight = np.where(heavy, idf, 0).astype(np.float32)
    rank = min(len(idf), EXTRA + OVER)
    leading = latent(sketch(docs, text, vocabulary, weight, rank), test_matrix(len(idf), rank))[:, :EXTRA]
    for lo in range(0, len(pieces), block):
        own = pieces[lo : lo + block]
        mine = np.unique([x for _, ids in own for x in ids])
        mine = mine[weight[mine] > 0]
        a = np.zeros((len(own), len(idf)), np.float32)
        for k, (_, ids) in enumerate(own):
            np.add.at(a[k], ids, weight[ids])
        a = a[:, mine]
        a /= np.maximum(1e-9, np.linalg.norm(a, axis=1, keepdims=True))
        basis = stacked(leading[mine], a.T.astype(np.float64))
        vectors = a @ basis
        vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
        space = np.vstack([np.zeros((1, basis.shape[1])), basis * weight[mine, None]]).astype(np.float32)
        used = sorted({k for k, _ in own})
        asked.blocks.append(Query(mine, space, vectors.astype(np.float32), [used.index(k) for k, _ in own], [items[k] for k in used], len(idf)))
    return asked


MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("coverage", T.DoubleType())])


def find(
    docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "matches", block: int = BLOCK
) -> DataFrame:
    """``docs`` with the benchmark items that each text holds: item_id, cosine, coverage."""
    own = docs.drop(out)
    schema = T.StructType([*own.schema.fields, T.StructField(out, T.ArrayType(MATCH))])
    at = own.columns.index(text)
    asked = queries_of(docs, bench, text, item, item_text, block)
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # grows with the benchmark only
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for _, texts in common.blocks(batch.column(at).to_pylist(), 1 << 18):
                for own in shared.value.matches(texts):
                    found.append([{"item_id": i, "cosine": c, "coverage": s} for i, c, s in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    return own.mapInArrow(run, schema)


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold a benchmark item go; columns stay as they are."""
    own = common.unused(docs, "matches")
    return find(docs, common.table(spark, sf_dir, "benchmark"), out=own).where(F.size(own) == 0).drop(own)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") > 0).select("doc_id", F.inline("matches"))
