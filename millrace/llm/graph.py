"""Connected components of large edge tables: min-label propagation with shortcuts, written between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

HELD = 1 << 20
HUB = 1 << 20  # a node with more edges is several join keys


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not the smallest of its component under the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one per node and batch of a partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0

        def emit() -> pa.RecordBatch:
            child, root = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_pydict({"a": pa.array(child, pa.int64()), "b": pa.array(root, pa.int64())})

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= HELD:
                yield emit()
                a, b, n = [], [], 0
        if n:
            yield emit()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Edges are first contracted inside their partitions, so that about one edge per node is left.  Each round then gives a node the smallest label
    among its own and its neighbours', and follows that label's own label; rounds end when no label changes.
    Labels are written to the shared folder after each round, so a lost executor costs one round at most.
    """
    # few tasks with many edges each contract best; their number follows the cluster, or the shuffle where executors come and go
    tasks = max(2, scratch.spark.sparkContext.defaultParallelism, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")) // 64)
    forests = scratch.keep(contracted(edges.coalesce(tasks)), f"{name}-forests")
    # a node has one root per task at most; it keeps the smallest, and the other roots are tied to that one
    rooted = forests.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    tied = rooted.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    e = scratch.keep(tied.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-edges")
    scratch.drop(f"{name}-forests")
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a hub's edges are dealt over several keys, each with a copy of its label; hubs are fewer than edges / HUB
    hubs = both.groupBy("b").agg(F.ceil(F.count("*") / HUB).cast("int").alias("k")).where("k > 1")
    hubs = scratch.keep(hubs, f"{name}-hubs")
    some = not hubs.limit(1).isEmpty()
    dealt = both.join(F.broadcast(hubs), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "k"), F.lit(0)).cast("int").alias("s")) if some else both
    near = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = scratch.keep(near.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    k = 0
    while True:
        # a node offers its label to its neighbours and to the node that its label names
        told = labels.withColumnRenamed("node", "b")
        if some:
            told = told.join(F.broadcast(hubs), "b", "left").select("b", "label", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("s"))
        offers = (
            dealt.join(told, ["b", "s"] if some else ["b"])
            .select(F.col("a").alias("node"), "label")
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("label").alias("new"))
        )
        offers = scratch.keep(offers, f"{name}-offers-{k}")
        jump = offers.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = offers.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"))
        new = scratch.keep(moved, f"{name}-{k + 1}")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        scratch.drop(f"{name}-{k}", f"{name}-offers-{k}")
        labels, k = new, k + 1
        if not changed:
            scratch.drop(f"{name}-edges", f"{name}-hubs")
            return labels.withColumnRenamed("label", "component")
