"""Nearest neighbours by inner product through multi-index hashing.

Codes. Vectors are centred, projected and rotated so that their signs lose little (iterative
quantisation, fitted on a bounded sample); 128 signs make a code of eight substrings of 16
bits. Index. Every vector is indexed, in blocks; a block has a directory per substring from
value to vectors. Search. If two codes differ in at most r bits, then in one of the eight
substrings they differ in at most r/8; the search looks up all values within that reach, in
each directory, either by listing them or, if fewer values are in use, by comparing those.
Everything found within r is ranked by the exact inner product in double precision.

The radius r is measured: for a bounded sample of queries the true neighbours are found by
a scan over all rows, and r covers ``COVERED`` of them. A query with fewer than k found is
searched again without radius, so no query is short. The query set meets the rows in blocks.

Vectors that are null, zero, hold nulls or non-finite numbers, or have another length than
most take no part. Rows with the same id are rows of their own; a null id sorts last. Ties
go to the smaller id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.rows import checkpointed
from tidemark.session import ship_package

WORDS = 2  # of 64 bits in a code
PARTS = 4 * WORDS  # substrings of 16 bits

#: Vectors the rotations are fitted on, queries the radius is measured with, and the share of
#: their true neighbours it has to cover.
FITTED, MEASURED, COVERED = 10_000, 128, 0.98

#: Most vectors and queries in one block.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 14

_LAST = (1 << 63) - 1


@dataclass
class Coder:
    mean: np.ndarray
    planes: np.ndarray  # one column per bit

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        return np.packbits((vectors - self.mean) @ self.planes > 0, axis=1).view(np.uint16)


def fit(sample: np.ndarray, seed: int = 11, rounds: int = 30) -> Coder:
    """Projections to at most 64 places, each turned so that signs are close to the values."""
    rng, size = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(axis=0)
    planes: list[np.ndarray] = []
    while sum(p.shape[1] for p in planes) < 64 * WORDS:
        base = np.linalg.qr(rng.standard_normal((size, size)))[0][:, :64]
        flat = (sample - mean) @ base
        turn = np.linalg.qr(rng.standard_normal((base.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
            turn = u @ v
        planes.append(base @ turn)
    return Coder(mean, np.hstack(planes)[:, : 64 * WORDS])


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


class Block:
    """The index of one block of vectors: codes and a directory per substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.values, self.starts = [], []
        for j, order in enumerate(self.order):
            values, starts = np.unique(codes[order, j], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(order)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes that differ from ``code`` in at most ``radius`` bits."""
        if radius >= 64 * WORDS:
            return np.arange(len(self.codes))
        marked = np.zeros(len(self.codes), bool)
        for j in range(PARTS):
            reach = (radius - j) // PARTS if radius >= j else -1  # the parts' reaches and one more each add to radius + 1
            if reach < 0:
                continue
            values = self.values[j]
            if sum(comb(16, i) for i in range(min(reach, 16) + 1)) < len(values):
                near = np.sort(code[j] ^ masks(reach))
                at = np.searchsorted(values, near)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == near)]
            else:
                at = np.nonzero(np.bitwise_count(values ^ code[j]) <= reach)[0]
            starts, ends = self.starts[j][at], self.starts[j][at + 1]
            sizes = ends - starts
            if sizes.sum():
                offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                marked[self.order[j][np.repeat(starts, sizes) + offsets]] = True
        found = np.nonzero(marked)[0]
        return found[hamming(self.codes[found], code) <= radius]


_masks: dict[int, np.ndarray] = {}


def masks(reach: int) -> np.ndarray:
    """All 16-bit values with at most ``reach`` bits set."""
    if reach not in _masks:
        _masks[reach] = np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(16), n)], np.uint16)
    return _masks[reach]


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the smaller key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.nonzero(scores >= least)[0]
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((keys[kept], -scores[kept]))][:k]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.vstack(frame["_vector"].to_numpy())


def measured_radius(rows: DataFrame, asked: DataFrame, coder: Coder, k: int) -> int:
    """The radius that covers ``COVERED`` of the true neighbours of a bounded sample of queries."""
    sample = asked.orderBy(F.xxhash64("_row"), "_row").limit(MEASURED).toPandas()
    queries, own = _matrix(sample), sample["_row"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((queries, own, coder))  # MEASURED vectors

    def scan(frames):
        for frame in frames:
            queries, own, coder = shared.value
            if len(frame):
                vectors = _matrix(frame)
                scores, codes, keys = vectors @ queries.T, coder.codes(vectors), frame["_key"].to_numpy()
                for i, code in enumerate(coder.codes(queries)):
                    others = np.nonzero(frame["_row"].to_numpy() != own[i])[0]
                    top = others[best(scores[others, i], keys[others], k)]
                    yield pd.DataFrame({"query": i, "score": scores[top, i], "bits": hamming(codes[top], code)})

    near = rows.mapInPandas(scan, "query int, score double, bits long")
    ranked = near.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "bits"))).where(F.col("n") <= k)
    found = sorted(r["bits"] for r in ranked.select("bits").collect())  # MEASURED times k
    return int(found[min(len(found) - 1, int(COVERED * len(found)))]) if found else 64 * WORDS


def nearest(rows: DataFrame, asked: DataFrame, coder: Coder, radius: int, k: int) -> DataFrame:
    """``_query``, ``_key`` and ``score`` of the k best within the radius for each row of ``asked``."""
    spark = rows.sparkSession
    blocks = lambda n, most: max(1, -(-n // most))
    held, queries = rows.count(), asked.count()
    vector_blocks = max(blocks(held, VECTOR_BLOCK), min(spark.sparkContext.defaultParallelism, blocks(held, 2048)))
    query_blocks = blocks(queries, QUERY_BLOCK)
    shared = spark.sparkContext.broadcast(coder)
    number = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_vb", number(vector_blocks)).withColumn("_qb", each(query_blocks))
    right = asked.withColumn("_qb", number(query_blocks)).withColumn("_vb", each(vector_blocks))

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"_query": [], "_key": [], "score": []}
        if len(vectors) and len(queries):
            coder, matrix = shared.value, _matrix(vectors)
            block, keys, ids = Block(coder.codes(matrix)), vectors["_key"].to_numpy(), vectors["_row"].to_numpy()
            wanted = _matrix(queries)
            for own, vector, code in zip(queries["_row"].to_numpy(), wanted, coder.codes(wanted), strict=True):
                near = block.within(code, radius)
                near = near[ids[near] != own]
                scores = (matrix[near] * vector).sum(axis=1)
                top = best(scores, keys[near], k)
                out["_query"].append(np.full(len(top), own))
                out["_key"].append(keys[near[top]])
                out["score"].append(scores[top])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()})

    pairs = left.groupBy("_vb", "_qb").cogroup(right.groupBy("_vb", "_qb"))
    found = pairs.applyInPandas(search, "_query long, _key long, score double")
    order = W.partitionBy("_query").orderBy(F.desc("score"), "_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, asked: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), key and ``score`` of the k nearest of each row where ``asked`` holds."""
    ship_package(vectors.sparkSession)
    numbered = vectors.withColumn("_row", F.monotonically_increasing_id()).where(usable(F.col(vector))).select(
        "_row",
        F.coalesce(F.col(key), F.lit(_LAST)).cast("long").alias("_key"),
        F.col(vector).cast("array<double>").alias("_vector"),
        F.coalesce(asked, F.lit(False)).alias("_asked"),
    )
    rows = checkpointed(numbered)  # the numbers are given once
    lengths = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = f"query_id long, rank int, {key} long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("_vector") == lengths["n"])
    queries, rows = rows.where("_asked").drop("_asked"), rows.drop("_asked")
    sample = rows.orderBy(F.xxhash64("_row"), "_row").limit(FITTED).toPandas()
    coder = fit(_matrix(sample))
    if queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], empty)
    radius = measured_radius(rows, queries, coder, k)
    found = checkpointed(nearest(rows, queries, coder, radius, k))
    counts = found.groupBy("_query").agg(F.count(F.lit(1)).alias("_found"))
    short = queries.join(counts, queries["_row"] == counts["_query"], "left").where(F.coalesce("_found", F.lit(0)) < min(k, rows.count() - 1))
    short = checkpointed(short.select(*queries.columns))
    if not short.isEmpty():
        again = nearest(rows, short, coder, 64 * WORDS, k)
        found = found.join(short.select(F.col("_row").alias("_query")), "_query", "left_anti").unionByName(again)
    ids = queries.select(F.col("_row").alias("_query"), F.col("_key").alias("_id"))
    back = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return found.join(ids, "_query").select(back("_id").alias("query_id"), "rank", back("_key").alias(key), "score")
