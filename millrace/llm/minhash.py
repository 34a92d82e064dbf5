"""MinHash near-dedup with circulant permutations, and exact Jaccard verification.

*Signatures*: a document's set holds its distinct shingles of ``size`` words as 64-bit hashes.  One permutation
(sigma) scatters the set over 2^32 places, a second one (pi), shifted circularly by 1, 2, ..., K places, gives
all K coordinates: the k-th is the least pi(sigma(s) - k) over the set.  ``BANDS`` bands of ``ROWS`` coordinates
are hashed to buckets; two sets of similarity 0.8 share none with probability (1 - 0.8^4)^20 < 3e-5.

*Whole groups without all pairs*: equal sets are merged first (one row per set).  Sets that share a bucket,
directly or through others, form a coarse group (components over one edge per set and bucket, to the bucket's
smallest id).  The sets of a group are brought together once and compared in memory through an inverted index
of their shingles, exactly: 100 * intersection >= percent * union.  Only links of a spanning forest leave a
task, and their components are the result.  A group of more than ``CELL`` shingles is cut by hash into pieces,
each with about ``PIVOTS`` sets of the whole group; most sets thereby find their way into one component.  Links
inside that component don't matter any more, so then only the group's other sets, in pieces of their own, meet
every piece.  No pair that could change the result is left out, and what is sent grows with a group's size, and
with its square only as far as its sets are *not* alike.

Edge cases: null and empty texts, and texts of white space, have an empty set, link with nothing and are kept;
a text of fewer than ``size`` words is one shingle; texts of any length are used whole; rows with the same id and
text count as one document; a row without an id is neither linked nor returned (there is no name for it);
an empty table gives an empty result.  Only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

BANDS, ROWS = 20, 4
SHINGLE, PERCENT = 5, 80
CELL = 1 << 18
PIVOTS = 64
WIDE = 8
TILE = 1 << 14
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_TABLE: dict[bytes, int] = {}
_TABLE_WORDS = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    low = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    words = _WORDS.findall(low)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_TABLE) > _TABLE_WORDS:
        _TABLE.clear()
    for w in set(words).difference(_TABLE):
        _TABLE[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_TABLE.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        # each position turns the running hash before the next word joins, so order counts
        out = (out << np.uint64(23) | out >> np.uint64(41)) ^ (h[j : m + j] * _FACTORS[j % len(_FACTORS)])
        out *= np.uint64(0x9FB21C651E98DF25)
    return np.unique(common.mix64(out))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x bands) bucket keys of non-empty sets."""
    flat = np.concatenate(sets)
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sigma = common.mix32((flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32) * np.uint32(0x85EBCA6B))
    signature = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    for k in range(BANDS * ROWS):
        signature[k] = np.minimum.reduceat(common.mix32_other(sigma - np.uint32(k + 1)), cut)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in signature[b * ROWS : (b + 1) * ROWS]:
            h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ r)
        keys[:, b] = h
    return keys.view(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], at_text: int, size: int):
    """(batch, first row, sets) with about ``TILE`` shingles together."""
    for batch in batches:
        texts = batch.column(at_text)
        own, n, start = [], 0, 0
        for i in range(batch.num_rows):
            s = shingle_hashes(texts[i].as_py(), size)
            own.append(s)
            n += len(s)
            if n >= TILE:
                yield batch, start, own
                own, n, start = [], 0, i + 1
        if own:
            yield batch, start, own
    _TABLE.clear()  # a worker process outlives its task


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, digest, keys) of documents (id, text); no digest and keys for an empty set."""
    kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, start, sets in _tiles(batches, 1, size):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys([sets[i] for i in full]), strict=True):
                    keys[i], digest[i] = row, xxhash.xxh3_128_digest(sets[i].tobytes())
            ids = batch.column(0).slice(start, len(sets))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, kind[3].type)], schema=kind)

    return docs.mapInArrow(run, "id long, n long, digest binary, keys array<long>")


# ----------------------------------------------------------------------- verification
def links(ids: np.ndarray, sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between sets, from exact intersection sizes.

    ``asked``: for which sets to look for links to all others; without it all links count.
    """
    none = np.zeros(0, np.int64)
    if len(ids) < 2:
        return none, none
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(ids)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(flat)))
    shared = np.repeat(count > 1, count)  # a shingle of one set alone links nothing
    place = np.repeat(np.arange(len(first)), count)[shared]
    by_doc = np.argsort(doc[shared], kind="stable")
    place = place[by_doc]
    cut = np.searchsorted(doc[shared][by_doc], np.arange(len(ids) + 1))
    label = np.arange(len(ids))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    a, b = [], []
    for i in range(len(ids)) if asked is None else np.flatnonzero(asked).tolist():
        own = place[cut[i] : cut[i + 1]]
        if len(own) * 100 < percent * size[i]:
            continue  # too few of its shingles stand in any other set
        n = count[own]
        total = int(n.sum())
        # all entries of the lists of its shingles, end to end
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        both = np.bincount(doc[at], minlength=len(ids))
        near = np.flatnonzero(both * 100 >= percent * (size + size[i] - both))
        for j in near[near < i] if asked is None else near[near != i]:
            x, y = root(i), root(int(j))
            if x != y:
                label[max(x, y)] = min(x, y)
                a.append(ids[i])
                b.append(ids[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(cells: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) within each cell of (cell, id, asked, text), which arrive sorted by cell in their partition.

    Small cells share one index: links between them can't be wrong, as they are checked like all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        asked: list[bool] = []
        sets: list[np.ndarray] = []
        held, last = 0, None

        def emit() -> pa.RecordBatch:
            a, b = links(np.array(ids), sets, percent, None if all(asked) else np.array(asked))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for cell, i, ask, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if cell != last and held >= CELL // 4:
                    yield emit()
                    ids, asked, sets, held = [], [], [], 0
                last = cell
                own = shingle_hashes(text.as_py(), size)
                ids.append(i)
                asked.append(ask)
                sets.append(own)
                held += len(own)
        if ids:
            yield emit()
        _TABLE.clear()

    return cells.select("cell", "id", "asked", "text").mapInArrow(run, "a long, b long")


def _met(own: DataFrame, cells: DataFrame, size: int, percent: int, repeated: bool) -> DataFrame:
    """Links within cells (id, cell, asked), whose texts are fetched from (id, text)."""
    some = common.sieve(own, cells, "id")  # most texts are in no group; they stay where they are
    texts = some.join(cells.hint("merge"), "id")
    if repeated:
        texts = texts.dropDuplicates(["id", "cell"])
    return verified(texts.repartition("cell").sortWithinPartitions("cell"), size, percent)


def _group_links(own: DataFrame, coarse: DataFrame, rows: DataFrame | None, reps: DataFrame, scratch: common.Scratch, size: int, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) whose components are those of all links between sets of a coarse group.

    ``rows``: (id, key) of all buckets, into which groups with too many unlinked sets fall apart (None: they don't).
    """
    member = coarse.join(reps.select(F.col("rep").alias("node"), "n"), "node").withColumnRenamed("component", "grp")
    weight = member.groupBy("grp").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("g"), F.count("*").alias("m"))
    weight = scratch.keep(weight, "weight")
    member = member.join(weight, "grp").withColumn("p", F.pmod(F.xxhash64("node", F.lit(5)), F.col("g")).cast("int"))
    member = scratch.keep(member, "member")
    pivot = (F.col("g") > 1) & (F.pmod(F.xxhash64("node", F.lit(6)), F.col("m")) < PIVOTS)
    pieces = F.when(pivot, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array("p"))
    cells = member.select(F.col("node").alias("id"), F.lit(True).alias("asked"), "grp", F.explode(pieces).alias("q"))
    cells = scratch.keep(cells.select("id", "asked", F.xxhash64("grp", "q").alias("cell")), "cells")
    found = scratch.keep(_met(own, cells, size, percent, repeated), "links")
    scratch.drop("cells")
    large = member.where("g > 1")
    if large.limit(1).isEmpty():
        scratch.drop("member", "weight")
        return found

    # of each large group, all sets that are not in its largest component meet every piece
    parts = graph.components(found, scratch, "pieces").withColumnRenamed("component", "part")
    large = large.join(parts, "node", "left").select("node", "n", "grp", "g", "p", F.coalesce("part", "node").alias("part"))
    large = scratch.keep(large, "large")
    tops = large.groupBy("grp", "part").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "part")).alias("top"))
    tops = scratch.keep(tops.select("grp", F.col("top.part").alias("top")), "tops")
    rest = large.join(tops, "grp").where(F.col("part") != F.col("top"))
    share = scratch.keep(rest.groupBy("grp").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("h")), "share")
    within = found
    if rows is not None:
        wide = share.where(F.col("h") > WIDE).select("grp")
        if not wide.limit(1).isEmpty():
            chained = large.join(wide, "grp").select(F.col("node").alias("id"))
            buckets = rows.join(chained, "id").groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"))
            # buckets with the same sets are compared once
            once = buckets.where("m > 1").groupBy("m", "s").agg(F.min("key").alias("key")).select("key")
            apart = rows.join(once, "key").join(chained, "id").select(F.col("id").alias("node"), F.col("key").alias("component"))
            apart = scratch.keep(apart, "apart")
            deep = common.Scratch(scratch.spark, "minhash-buckets")
            within = found.unionByName(_group_links(own, apart, None, reps, deep, size, percent, repeated))
            share = scratch.keep(share.where(F.col("h") <= WIDE), "narrow")
    cell = F.xxhash64("grp", F.lit("rest"), "i", "q").alias("cell")
    asks = rest.join(share, "grp").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("h")).cast("int"))
    asks = asks.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(F.col("node").alias("id"), F.lit(True).alias("asked"), cell)
    told = large.join(share, "grp").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("q", F.col("p"))
    told = told.select(F.col("node").alias("id"), F.lit(False).alias("asked"), cell)
    # a set that asks in the piece where it also stands is one row there
    cells = scratch.keep(asks.unionByName(told).groupBy("id", "cell").agg(F.bool_or("asked").alias("asked")), "cells")
    more = scratch.keep(_met(own, cells, size, percent, repeated), "more")
    scratch.drop("cells", "large", "tops", "share", "member", "weight")
    return within.unionByName(more)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component) of every document: the smallest id of its class."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "minhash")
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    found = scratch.keep(signatures(own, size), "signatures")
    # equal sets: the smallest id stands for all; partial aggregation makes a hot set one row per task
    reps = scratch.keep(found.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "reps")

    kept = reps.select(F.col("rep").alias("id"), F.col("digest").alias("_d"))
    picked = found.join(kept, "id").where(F.col("digest") == F.col("_d")).select("id", "keys")
    picked = scratch.keep(picked, "picked")
    rows = picked.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("m")).where("m > 1").select("key", "b")
    buckets = scratch.keep(buckets, "buckets")
    edges = rows.join(buckets, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    coarse = graph.components(edges, scratch, "coarse")
    scratch.drop("buckets")

    fine = graph.components(_group_links(own, coarse, rows, reps, scratch, size, percent, _repeated(found)), scratch, "fine")
    scratch.drop("links", "more", "picked", "apart", "narrow")

    named = reps.join(fine.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = scratch.keep(named, "named")
    out = found.select("id", "n", "digest").join(named, "digest", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _repeated(found: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return not found.groupBy("id").count().where("count > 1").limit(1).isEmpty()


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each class the document with the smallest id stays; columns stay as they are.

    Rows without an id stay.
    """
    classes = near_duplicates(docs)
    gone = classes.where(F.col("component") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under 4-word shingles."""
    docs = common.table(spark, sf_dir, "documents")
    return near_duplicates(docs, size=4).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("doc_id")).alias("kept")
    )
