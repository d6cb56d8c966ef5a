"""Connected components of a graph given as an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import checkpointed
from tidemark.session import ship_package


def components(edges: DataFrame, together: int = 0) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for each node of the edges ``a``, ``b``.

    Alternating large-star and small-star steps: every node's neighbours are hung on its
    smallest neighbour, first those that are larger, then those that are smaller. Each step
    is one grouping (minimum per node, combined before the shuffle) and one join on the node;
    the edges never become more. The table is checkpointed after each round, so a round
    reads only the last one, and the number of rounds follows the logarithm of the longest
    chain. Nodes with many edges are split by skew joins, as no list of neighbours is made.
    A graph of up to ``together`` distinct edges between longs takes no rounds, but one task.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if together and pairs.count() <= together:
        return _at_once(pairs)
    before = None
    while True:
        large = _star(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        pairs = checkpointed(_star(large, larger=False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _at_once(pairs: DataFrame) -> DataFrame:
    ship_package(pairs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([b.to_numpy() for b in batch]) for batch in zip(*(b.columns for b in batches), strict=True)]
        if columns:
            nodes, at = np.unique(np.concatenate(columns), return_inverse=True)
            parent = np.arange(len(nodes))
            _union(parent, *at.reshape(2, -1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[_roots(parent)])], names=["node", "root"])

    return pairs.coalesce(1).mapInArrow(run, "node long, root long")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[k] and b[k] for all k; ``parent`` is changed in place."""
    while len(a):
        roots = _roots(parent.copy())
        x, y = roots[a], roots[b]
        open_ = x != y
        a, b, high, low = a[open_], b[open_], np.maximum(x, y)[open_], np.minimum(x, y)[open_]
        parent[:] = roots
        np.minimum.at(parent, high, low)


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hangs neighbours ``b`` of each node ``a`` on the smallest of the node and its neighbours.

    Large star takes both directions of an edge and moves the larger neighbours; small star
    takes edges from the larger node and moves the smaller neighbours and the node itself.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("_least"))
    hung = pairs.join(least, "a").withColumn("_least", F.least("_least", "a"))
    if larger:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("_least").alias("b")).union(hung.select("a", F.col("_least").alias("b")))
    return moved.where("a <> b").distinct()
