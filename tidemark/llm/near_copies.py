"""Near copies by Jaccard similarity, found by SimHash fingerprints in vantage-point trees.

A text is the set of its shingles of ``SHINGLE`` words; two texts link if their sets have a
Jaccard similarity of ``LEAST`` or more, and linked texts form groups. Every link is checked
on the whole sets (64-bit hashes of shingles), so nothing less similar is ever linked.

Search. Texts with the same set are one point. Its fingerprint has ``64 * WORDS`` bits, each set
if more than half of the set's hashes have it set. At similarity 0.8 a bit differs with a chance
of 0.15. There are ``TREES`` vantage-point trees, each over ``PART`` drawn bits, with the splits and
the dealing of ``simhash``; a tree asks for pairs that differ in one of its bits at most. Such
pairs meet in a shard, as there, and are alike if at most ``FAR`` bits of the whole fingerprint
differ. A pair at 0.8 has a chance of 0.18 in each tree and is missed by all with one of about
0.002, one at 0.9 with 1e-6. A shard passes on one edge per alike point, and the components of
these edges are classes: no similar pair that was found lies in two of them.

Links. Classes are small as a rule; one of up to ``TOGETHER`` texts is settled in one group, pair by
pair. In larger ones the texts that are not in the class's largest group wait: each has to be
compared with all others of the class. While over ``LED`` wait, some lead: all others of the class
are compared with them, where the sets lie, and a large group of near copies falls together. Once
a turn leaves over half of them, or few, the rest meets in pairs of blocks, all in one step; many
texts that are alike and not similar do meet each other all. So turns, each some jobs of the
driver's, grow with the logarithm of a class, not with its size. A block holds at most so many
texts and hashes, and texts of one size: sizes more than 1.3 apart twice over cannot be similar.

Words are as in ``simhash``. Nulls: null and empty texts are one set. The key must be unique
and not null; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import checkpointed, released, slices, small
from tidemark.llm.simhash import MOST_SHARDS, SAMPLED, Split, _roots, _union, build, choose, shingle_hashes
from tidemark.session import ship_package

SHINGLE, LEAST = 5, (4, 5)

#: Words of a fingerprint, trees, and bits that a tree looks at.
WORDS, TREES, PART = 4, 36, 20

#: Bits in which alike fingerprints may differ, of all and of the first 64: five deviations above the mean at similarity 0.8.
FAR, FAR_FIRST = 68, 24

#: Points a shard aims at, points compared all to all, and members of a class that is settled in one group.
SHARD, LEAF, TOGETHER = 1 << 17, 512, 256

#: Leaders of a class in its first turn, and at most; waiting texts that need no turn; hashes of leaders to broadcast at most.
LEADERS, MOST_LEADERS, LED, LEAD_HASHES = 4, 256, 4096, 1 << 20

#: Texts and hashes that a block aims at, and the step from one size of texts to the next.
BLOCK, BLOCK_HASHES, BAND = 2048, 1 << 20, 1.3

#: Edges whose components are found in one task.
AT_ONCE = 1 << 20

SIGNS = [f"s{k}" for k in range(WORDS)]

_random = np.random.default_rng(11)
_MASKS, _FACTORS = (_random.integers(0, np.iinfo(np.uint64).max, (WORDS, 1), np.uint64) | np.uint64(1) for _ in range(2))
_PER_DRAW = 64 * WORDS // PART
_PARTS = np.concatenate([_random.permutation(64 * WORDS)[: _PER_DRAW * PART].reshape(-1, PART) for _ in range(-(-TREES // _PER_DRAW))])[:TREES]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of a text without words, a zero."""
    return np.unique(np.array(shingle_hashes(text, shingle) or [0], np.uint64))


def signs(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set, ``WORDS`` numbers."""
    ones = np.zeros((WORDS, 64), np.int64)
    for start in range(0, len(own), 16384):
        mixed = (own[None, start : start + 16384] ^ _MASKS) * _FACTORS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTORS[::-1]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(WORDS, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.uint16)
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view(np.uint64)[:, 0]


def part(fingerprints: np.ndarray, tree: int) -> np.ndarray:
    """The bits a tree looks at, side by side."""
    out = np.zeros(len(fingerprints), np.uint64)
    for k, at in enumerate(_PARTS[tree].tolist()):
        out |= ((fingerprints[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def _dealt(at: np.ndarray, own: np.ndarray, tree: Split | int) -> list[tuple[int, np.ndarray]]:
    """``simhash.deal`` for the points at ``at``, by place."""
    if not len(at):
        return []
    if isinstance(tree, int):
        return [(tree, at)]
    near, far = tree.sides(own[at])
    return _dealt(at[near], own, tree.near) + _dealt(at[far], own, tree.far)


def alike_groups(fingerprints: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each point of a shard the first of those that alike pairs join it to; ``own``: the tree's part."""
    parent = np.arange(len(own))
    stack, found, waiting = [(np.arange(len(own)), 0)], [], 0
    while stack:
        at, kind = stack.pop()
        node = choose(own[at], kind) if len(at) > LEAF else None
        if node is not None:
            near, far = node.sides(own[at])
            stack += [(at[near], node.metric), (at[far], node.metric)]
            continue
        for start in range(0, len(at), 256):  # a part that no vantage point splits is compared in strips
            rows = at[start : start + 256]
            for other in range(start, len(at), 4096):
                columns = at[other : other + 4096]
                close = np.bitwise_count(fingerprints[rows, 0][:, None] ^ fingerprints[columns, 0]) <= FAR_FIRST
                i, j = np.nonzero(close & (parent[rows][:, None] != parent[columns]))
                a, b = rows[i], columns[j]
                alike = np.bitwise_count(fingerprints[a] ^ fingerprints[b]).sum(axis=1, dtype=np.int64) <= FAR
                found.append((a[alike], b[alike]))
                waiting += len(found[-1][0])
                if waiting > 1 << 17:
                    _union(parent, *map(np.concatenate, zip(*found, strict=True)))
                    parent, found, waiting = _roots(parent), [], 0
    if found:
        _union(parent, *map(np.concatenate, zip(*found, strict=True)))
    return _roots(parent)


def _unsigned(columns: Iterable[np.ndarray]) -> np.ndarray:
    return np.column_stack(list(columns)).view(np.uint64)


def alike_edges(points: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between points that hold all classes; ``points``: ``point``, unique, and ``SIGNS``."""
    spark = points.sparkSession
    wanted = min(MOST_SHARDS, max(1, points.count() // SHARD))
    sample = points.orderBy(F.xxhash64("point", F.lit(1)), "point").limit(wanted * SAMPLED * 4).select(*SIGNS).collect()  # bounded by MOST_SHARDS
    drawn = np.array(sample, np.int64).reshape(-1, WORDS).view(np.uint64)
    trees = [build(part(drawn, tree), 0, (wanted - 1).bit_length(), []) for tree in range(TREES)]
    shared = spark.sparkContext.broadcast(trees)  # bounded as the sample

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_signs = _unsigned(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            for number, tree in enumerate(shared.value):
                for shard, at in _dealt(np.arange(batch.num_rows), part(all_signs, number), tree):
                    place = [pa.array(np.full(len(at), k, np.int32)) for k in (number, shard)]
                    yield pa.RecordBatch.from_arrays([*place, *batch.take(pa.array(at)).columns], names=["tree", "shard", "point", *SIGNS])

    def search(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        all_signs = _unsigned(frame[s].to_numpy() for s in SIGNS)
        first = alike_groups(all_signs, part(all_signs, int(key[0])))
        moved = np.nonzero(first != np.arange(len(first)))[0]
        point = frame["point"].to_numpy()
        return pd.DataFrame({"a": point[moved], "b": point[first[moved]]})

    kinds = ", ".join(f"{s} long" for s in SIGNS)
    dealt = points.select("point", *SIGNS).mapInArrow(shards, f"tree int, shard int, point long, {kinds}")
    return dealt.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """Key column and what ``make`` gives for the text in the second column."""
    ship_package(rows.sparkSession)
    names = rows.select(rows.columns[0], *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", ")))).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = zip(*map(make, batch.column(1).to_pylist()), strict=True) if batch.num_rows else [[] for _ in names[1:]]
            types = [kinds[f.dataType.simpleString()] for f in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names.names)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    return rows.mapInArrow(run, names)


def _sketch(text: str | None) -> tuple[int, ...]:
    own = shingle_set(text)
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 1)).view(np.int64)), len(own), *signs(own).view(np.int64).tolist()


def _whole(text: str | None) -> tuple[np.ndarray]:
    return (shingle_set(text).view(np.int64),)


def similar_edges(frame: pd.DataFrame, low: np.ndarray, high: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Edges between points at ``low`` and at ``high``, one wherever a similar pair joins two labels.

    If both are the same places each pair is met once. ``label`` is changed in place.
    """
    point, sets, out = frame["point"].to_numpy(), frame["hashes"].to_list(), []
    all_signs, n = _unsigned(frame[s].to_numpy() for s in SIGNS), np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    held, ids = np.zeros(ids.max() + 1, bool), np.split(ids, np.cumsum(n)[:-1])
    for k, i in enumerate(low.tolist()):
        at = high[:k] if high is low else high
        at = at[(label[at] != label[i]) & (np.minimum(n[at], n[i]) * LEAST[1] >= np.maximum(n[at], n[i]) * LEAST[0])]
        at = at[np.bitwise_count(all_signs[at] ^ all_signs[i]).sum(axis=1, dtype=np.int64) <= FAR]
        if not len(at):
            continue
        held[ids[i]] = True
        common = np.add.reduceat(held[np.concatenate([ids[j] for j in at])], np.cumsum(n[at]) - n[at], dtype=np.int64)
        held[ids[i]] = False
        for j in at[common * LEAST[1] >= (n[i] + n[at] - common) * LEAST[0]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((point[i], point[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def settled(sets: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that hold all groups of similar points of small classes, each in one group."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        everyone = np.arange(len(frame))
        return similar_edges(frame, everyone, everyone, everyone.copy())

    return sets.groupBy("class").applyInPandas(settle, "a long, b long")


def met(sets: DataFrame, grouped: DataFrame, waiting: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between groups: the waiting points compared with all others of their class, block by block."""
    cell, own = ["class", "waits", "band"], ["point", "group", "n", *SIGNS, "hashes"]
    marks = grouped.join(waiting.select("point", F.lit(True).alias("waits")), "point", "left")
    rows = sets.join(small(checkpointed(marks.select("point", "group", F.col("waits").isNotNull().alias("waits")))), "point")
    rows = rows.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_HASHES)).cast("int")
    cells = checkpointed(rows.groupBy(*cell).agg(blocks.alias("blocks")))
    facing = cells.join(cells.select("class", F.struct("waits", "band", "blocks").alias("other")), "class")
    facing = facing.where((F.col("waits") | F.col("other.waits")) & (F.abs(F.col("band") - F.col("other.band")) <= 1))
    facing = checkpointed(facing.groupBy(*cell, "blocks").agg(F.collect_list("other").alias("others")))  # at most six
    block = F.expr("named_struct('waits', waits, 'band', band, 'block', int(pmod(xxhash64(point, 7L), blocks)))")
    theirs = F.expr("explode(flatten(transform(others, o -> transform(sequence(0, o.blocks - 1), j -> named_struct('waits', o.waits, 'band', o.band, 'block', j)))))")
    dealt = rows.join(small(facing), cell).select("class", block.alias("_own"), theirs.alias("_other"), *own)
    pair = {f"{side}_{f}": of("_own", "_other")[f] for side, of in (("low", F.least), ("high", F.greatest)) for f in ("waits", "band", "block")}
    dealt = dealt.select("class", *(c.alias(name) for name, c in pair.items()), (F.col("_own") <= F.col("_other")).alias("low"), (F.col("_own") == F.col("_other")).alias("alone"), *own)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        label = np.unique(frame["group"].to_numpy(), return_inverse=True)[1]
        low = np.nonzero(frame["low"].to_numpy())[0]
        return similar_edges(frame, low, low if frame["alone"].iloc[0] else np.nonzero(~frame["low"].to_numpy())[0], label)

    return dealt.groupBy("class", *pair).applyInPandas(meet, "a long, b long")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def led(sets: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that hold all groups of similar points of classes of any size; ``sets`` is written."""
    spark, most, before = sets.sparkSession, LEADERS, None
    edges, done = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "point long")
    members = checkpointed(sets.select("point", "class"))
    grouped = members.withColumn("group", F.col("point"))
    while True:
        top = grouped.groupBy("class", "group").agg(F.count(F.lit(1)).alias("_n")).groupBy("class").agg(F.max_by("group", F.struct("_n", "group")).alias("_top"))
        waiting = checkpointed(grouped.join(top, "class").where(F.col("group") != F.col("_top")).join(done, "point", "left_anti").select("point", "class"))
        left = waiting.count()
        if left <= LED or before and 2 * left > before:
            return edges.union(met(sets, grouped, waiting)) if left else edges
        order = W.partitionBy("class").orderBy(F.xxhash64("point"), "point")
        leaders = checkpointed(waiting.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).select("point"))
        done, most, before = done.union(leaders), min(4 * most, MOST_LEADERS), left
        own = sets.join(small(grouped.select("point", "group")), "point")
        lead = own.join(small(leaders), "point", "left_semi")
        lead = checkpointed(lead.select("class", *(F.col(c).alias(f"_{c}") for c in ["point", "group", "n", "hashes", *SIGNS])))
        lead = F.broadcast(lead) if lead.agg(F.sum("_n")).first()[0] <= LEAD_HASHES else lead
        apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"_{s}"))) for s in SIGNS), F.lit(0))
        compared = own.join(lead, "class").where((F.col("group") != F.col("_group")) & _sizes_fit(F.col("n"), F.col("_n")) & (apart <= FAR))
        sized = compared.select("point", "_point", "n", "_n", F.size(F.array_intersect("hashes", "_hashes")).alias("_common"))
        similar = F.col("_common") * LEAST[1] >= (F.col("n") + F.col("_n") - F.col("_common")) * LEAST[0]
        found = released(sized.where(similar).select(F.col("point").alias("a"), F.col("_point").alias("b")))
        if not found.isEmpty():
            edges = edges.union(found)
            roots = checkpointed(components(edges, AT_ONCE))
            grouped = checkpointed(members.join(roots, members["point"] == roots["node"], "left").select("point", "class", F.coalesce("root", "point").alias("group")))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``component_id`` (smallest key of its group) of every text; keys are unique and not null."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = checkpointed(_mapped(rows, ", ".join(["point bigint", "n int", *(f"{s} bigint" for s in SIGNS)]), _sketch))
    least = F.min(F.struct("_key", "n", *SIGNS)).alias("_least")  # rows of a point differ in the key only
    points = checkpointed(marked.groupBy("point").agg(least).select("point", "_least.*"))
    classes = released(components(released(alike_edges(points)), AT_ONCE)).select(F.col("node").alias("point"), F.col("root").alias("class"))
    large = classes.groupBy("class").agg((F.count(F.lit(1)) > TOGETHER).alias("large"))
    wanted = checkpointed(points.join(classes, "point").join(large, "class"))
    found = rows.join(small(wanted), "_key").select(F.struct("point", "class", "large", "n", *SIGNS).alias("_own"), "_text")
    sets = released(_mapped(found, "hashes array<bigint>", _whole).select("_own.*", "hashes"))
    links = settled(sets.where("not large"))
    if not sets.where("large").isEmpty():
        links = links.union(led(sets.where("large").drop("large")))
    rooted = components(released(links), AT_ONCE)
    named = points.join(rooted, points["point"] == rooted["node"], "left").select("point", F.col("_key").alias("_first"), F.coalesce("root", "point").alias("_root"))
    firsts = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = checkpointed(named.join(firsts, "_root").select("point", "component_id"))
    return marked.join(named, "point").select(F.col("_key").alias(key), "component_id")
