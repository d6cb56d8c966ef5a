"""SimHash near duplicates: exact pairs of fingerprints through vantage-point trees.

A text's fingerprint has a bit for each of 64 places, set if more than half of the hashes of
its word shingles have it set. Fingerprints link if at most ``RADIUS`` bits differ; linked
fingerprints form groups.

Search. Of three differing bits, one half of the 64 has at most one, so there are two trees,
one per half, each measuring Hamming distance on its half and asking for pairs within one.
The upper part of a tree is built on the driver from a bounded sample: a vantage point, and
the median distance m from it, split the sample in near (<= m) and far. By the triangle
inequality a point with distance over m + 1 has no partner on the near side, so the far
points within m + 1 are dealt to the near shard as well, and no others: each pair within
reach meets in a shard. Where a half cannot tell points apart, the split goes on with all 64
bits and radius 3. A shard is one task's group; it is split further in the same way in
memory, and the lowest parts are compared all to all. A shard passes on, for each
fingerprint it links, one edge to the group it found, so edges never outnumber fingerprints.

Only distinct fingerprints are searched: copies are one point. Nulls: a null or empty text
has fingerprint zero, linked as any other. Repeated rows and null ids get their row each;
a group's id is its smallest id that is not null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import _roots, _union, components
from tidemark.llm.rows import checkpointed, slices
from tidemark.session import ship_package

SHINGLE, SEED, RADIUS = 3, 42, 3

#: Fingerprints a shard aims at, fingerprints sampled per shard, and most shards of a tree.
SHARD, SAMPLED, MOST_SHARDS = 4096, 16, 1 << 14

#: Parts of a shard up to this size are compared all to all.
LEAF = 64

#: The metrics of the two trees: mask and radius. The last one is the fall-back, all bits.
METRICS = ((0x00000000FFFFFFFF, 1), (0xFFFFFFFF00000000, 1), (0xFFFFFFFFFFFFFFFF, RADIUS))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of a text's word shingles, repeats included; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined, starts = b" ".join(words), [0, *ends]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    array = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(array, len(array) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(array)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``bits``, the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=names)

    names = [key, "bits"]
    return rows.mapInArrow(run, rows.select(key, F.lit(0).cast("long").alias("bits")).schema)


class Split:
    """One node of a tree: near and far side of a vantage point under a metric."""

    __slots__ = ("metric", "vantage", "middle", "near", "far")

    def __init__(self, metric: int, vantage: int, middle: int):
        self.metric, self.vantage, self.middle = metric, np.uint64(vantage), middle
        self.near: Split | int | None = None
        self.far: Split | int | None = None

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.bitwise_count((points ^ self.vantage) & np.uint64(METRICS[self.metric][0]))

    def sides(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the points that go near (with those that may have partners there) and far."""
        d = self.distances(points)
        return d <= self.middle + METRICS[self.metric][1], d > self.middle


def choose(points: np.ndarray, metric: int) -> Split | None:
    """A split that leaves points on both sides, if any of a few vantage points gives one."""
    for kind in dict.fromkeys((metric, len(METRICS) - 1)):
        for vantage in points[:: max(1, len(points) // 4)][:4]:
            node = Split(kind, vantage, 0)
            d = np.sort(node.distances(points))
            middle = int(d[(len(d) - 1) // 2])
            if middle == d[-1]:
                lower = d[d < middle]
                if not len(lower):
                    continue
                middle = int(lower[-1])
            node.middle = middle
            if node.sides(points)[0].mean() < 0.95:
                return node
    return None


def build(sample: np.ndarray, metric: int, depth: int, shards: list[int]) -> Split | int:
    """The upper tree over a sample; leaves are shard numbers."""
    node = choose(sample, metric) if depth and len(sample) >= SAMPLED else None
    if node is None:
        shards.append(len(shards))
        return shards[-1]
    d = node.distances(sample)
    node.near = build(sample[d <= node.middle], node.metric, depth - 1, shards)
    node.far = build(sample[d > node.middle], node.metric, depth - 1, shards)
    return node


def deal(points: np.ndarray, tree: Split | int) -> list[tuple[int, np.ndarray]]:
    """The points of each shard: those on its side, and those near enough to have partners there."""
    if not len(points):
        return []
    if isinstance(tree, int):
        return [(tree, points)]
    near, far = tree.sides(points)
    return deal(points[near], tree.near) + deal(points[far], tree.far)


def links(points: np.ndarray, metric: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that hold all groups of distinct ``points`` that pairs within the metric form."""
    parent = np.arange(len(points))
    stack, found, waiting = [(np.arange(len(points)), metric)], [], 0
    while stack:
        at, kind = stack.pop()
        node = choose(points[at], kind) if len(at) > LEAF else None
        if node is not None:
            near, far = node.sides(points[at])
            stack += [(at[near], node.metric), (at[far], node.metric)]
            continue
        for start in range(0, len(at), 1024):  # a part that no vantage point splits is compared in strips
            rows = at[start : start + 1024]
            for other in range(start, len(at), 8192):
                columns = at[other : other + 8192]
                close = np.bitwise_count(points[rows][:, None] ^ points[columns][None, :]) <= RADIUS
                i, j = np.nonzero(close)
                apart = rows[i] != columns[j]
                found.append((rows[i][apart], columns[j][apart]))
                waiting += len(found[-1][0])
                if waiting > 1 << 20:
                    _union(parent, *map(np.concatenate, zip(*found, strict=True)))
                    found, waiting = [], 0
    if found:
        _union(parent, *map(np.concatenate, zip(*found, strict=True)))
    roots = _roots(parent)
    moved = np.nonzero(roots != np.arange(len(points)))[0]
    return moved, roots[moved]


def near_edges(points: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct ``bits`` that hold all groups of fingerprints within reach."""
    spark = points.sparkSession
    wanted = min(MOST_SHARDS, max(1, points.count() // SHARD))
    sample = points.orderBy(F.xxhash64("bits", F.lit(1)), "bits").limit(wanted * SAMPLED * 4)  # bounded by MOST_SHARDS
    bits = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    trees = [build(bits, metric, (wanted - 1).bit_length(), []) for metric in range(len(METRICS) - 1)]
    shared = spark.sparkContext.broadcast(trees)  # bounded as the sample

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for metric, tree in enumerate(shared.value):
                for shard, members in deal(own, tree):
                    columns = [np.full(len(members), metric, np.int32), np.full(len(members), shard, np.int32), members.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "shard", "bits"])

    def search(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(frame["bits"].to_numpy().view(np.uint64))
        a, b = links(own, int(key[0]))
        return pd.DataFrame({"a": own[a].view(np.int64), "b": own[b].view(np.int64)})

    dealt = points.select("bits").mapInArrow(shards, "tree int, shard int, bits long")
    return dealt.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``bits`` and ``component_id`` (smallest key of the group) of every document."""
    marked = checkpointed(fingerprints(docs, key, text))
    classes = checkpointed(marked.groupBy("bits").agg(F.min(key).alias("_first")))
    rooted = components(near_edges(classes))
    classes = classes.join(rooted, classes["bits"] == rooted["node"], "left").select("bits", "_first", F.coalesce("root", "bits").alias("_root"))
    firsts = classes.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = checkpointed(classes.join(firsts, "_root").select("bits", "component_id"))
    return marked.join(named, "bits").select(key, "bits", "component_id")
