"""Mixing sources to target weights with exact block quotas per output shard.

Each source gets a target of words; one that would pass ``cap`` times its size stops there
and the others share what is left by weight. A source's documents stand in a hashed order;
its words, repeated as often as the target asks, are cut into blocks of equal words, and a
document is taken where the block of its middle word has been drawn by a shard. How
many blocks of each source a shard takes is drawn by a splitting tree: the quotas of a node
are split over its two halves as draws without replacement (a multivariate hypergeometric
draw, made exactly by selection sampling), down to single shards, so every shard has its
exact share of blocks and every source exactly its quota. The blocks a shard takes from a
source are disjoint and in permuted order; within a shard, rows are ordered by a hash.

Nulls: a null source is a source of its own, last in order; a null text has no words, and a
document without words takes none. Repeated rows are documents of their own. An empty
table gives no rows. Extra columns are kept by ``mixed``, which replaces columns named as
its own, and not read by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import checkpointed, small, with_row, word_count

SOURCE = ["_no_source", "_source"]


def source_targets(sizes: DataFrame, weights: list[int], cap: float) -> DataFrame:
    """Adds ``rank`` (from 0), ``weight`` and ``target`` to one row per source with ``source_size``.

    With sources in the order of size over weight, the level at which words per weight
    settle is the highest of (what earlier sources at their cap leave) / (weights from here on).
    One row per source is all that meets in a task.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(*SOURCE)) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    total, room = F.sum("source_size").over(everything), cap * F.col("source_size")
    at_cap = F.coalesce(F.sum(room).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - at_cap) / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    return (
        ranked.withColumn("_level", level)
        .withColumn("target", F.least(room, F.col("weight") * F.max("_level").over(everything)).cast("double"))
        .drop("_level")
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From one row with the array ``quotas`` to a row per ``shard`` with its part of it.

    Each level halves the shards of every node. A block goes left with the chance (places
    left on the left side) / (blocks not yet dealt), which fills the left side exactly.
    """
    chance = f"shiftrightunsigned(xxhash64({seed}L, lo, hi, q.i, j), 11) / 9007199254740992D"
    left = f"""
        aggregate(
            transform(quotas, (n, i) -> named_struct('n', n, 'i', i)),
            named_struct('room', held * (mid - lo) div (hi - lo), 'rest', held, 'dealt', cast(array() as array<bigint>)),
            (acc, q) -> aggregate(
                if(q.n > 0, sequence(1L, q.n), cast(array() as array<bigint>)),
                named_struct('room', acc.room, 'rest', acc.rest, 'k', 0L),
                (a, j) -> if(({chance}) * a.rest < a.room,
                             named_struct('room', a.room - 1, 'rest', a.rest - 1, 'k', a.k + 1),
                             named_struct('room', a.room, 'rest', a.rest - 1, 'k', a.k)),
                a -> named_struct('room', a.room, 'rest', a.rest, 'dealt', concat(acc.dealt, array(a.k)))),
            acc -> acc.dealt)"""
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas")
    for _ in range((shards - 1).bit_length()):
        nodes = (
            nodes.withColumn("held", F.expr("aggregate(quotas, 0L, (a, n) -> a + n)"))
            .withColumn("mid", F.expr("(lo + hi) div 2"))
            .withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)))
            .selectExpr(
                "explode(if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'quotas', left), "
                "named_struct('lo', mid, 'hi', hi, 'quotas', zip_with(quotas, left, (n, k) -> n - k))), "
                "array(named_struct('lo', lo, 'hi', hi, 'quotas', quotas)))) AS node"
            )
            .select("node.*")
        )
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def block_plan(sources: DataFrame, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """Adds ``block_words`` and ``block_shards`` (the shard of each of its blocks) to every source."""
    words = F.sum("target").over(W.partitionBy()) / (shards * blocks_per_shard)
    cut = sources.withColumn("block_words", F.greatest(words, F.lit(1.0))).withColumn(
        "blocks", F.ceil(F.col("target") / F.col("block_words")).cast("long")
    )
    listed = cut.agg(F.sort_array(F.collect_list(F.struct("rank", "blocks"))).alias("_all")).select(F.col("_all.blocks").alias("quotas"))
    dealt = (
        split_quotas(listed, shards, seed)
        .select("shard", F.posexplode("quotas").alias("rank", "n"))
        .groupBy("rank")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("_dealt"))
        .withColumn("_dealt", F.expr("flatten(transform(_dealt, d -> array_repeat(d.shard, int(d.n))))"))
        .withColumn("_dealt", F.expr(f"array_sort(transform(_dealt, (s, i) -> named_struct('h', xxhash64({seed}L, rank, i), 's', s)))"))
        .select("rank", F.col("_dealt.s").alias("block_shards"))
    )
    return cut.join(dealt, "rank")


def mix_plan(
    docs: DataFrame,
    weights: list[int],
    cap: float = 3.0,
    shards: int = 8,
    blocks_per_shard: int = 64,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``_row``, key, ``size`` (words), ``source_size``, ``target`` and ``copies`` of every document.

    ``copies`` holds a struct (epoch, block, shard, draw) for each time the mix takes the
    document: at most ``cap`` rounded up, none if it is left out. ``draw`` orders a shard.
    """
    slim = with_row(docs).select(
        "_row",
        F.col(key).alias("_key"),
        F.col(source).isNull().alias("_no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("_draw"),
    )
    placed = running_sums(slim, "size", ["_draw", "_key", "_row"], SOURCE)
    sizes = placed.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    plan = checkpointed(block_plan(source_targets(checkpointed(sizes), weights, cap), shards, blocks_per_shard, seed))
    return (
        placed.join(small(plan), SOURCE)
        .withColumn("_middle", F.col("before") + F.col("size") / 2)
        .withColumn("_epochs", F.expr("if(source_size > 0, int(ceil(target / source_size)), 0)"))
        .withColumn("copies", F.filter(_places(seed), lambda c: c["shard"].isNotNull()))
        .select("_row", F.col("_key").alias(key), "size", "source_size", "target", "copies")
    )


def _places(seed: int) -> Column:
    """Where each epoch puts a document: its block, and the shard that drew it, if one did.

    A block is as long as ``block_words``, the last one of a source as long as its target leaves.
    """
    place = "e * source_size + _middle"
    block = f"int(({place}) / block_words)"
    return F.expr(
        f"transform(if(_epochs > 0, sequence(0, _epochs - 1), array()), e -> named_struct('epoch', e, 'block', {block}, "
        f"'shard', if({place} < target, get(block_shards, {block}), null), 'draw', xxhash64({seed}L, _row, e)))"
    )


def mixed(docs: DataFrame, weights: list[int], **options) -> DataFrame:
    """The mixed corpus: a row with all columns of ``docs`` per copy, then ``mix_shard`` and ``mix_draw``.

    ``shuffled`` puts the rows in the order they are to be written in.
    """
    plan = mix_plan(docs, weights, **options).where(F.size("copies") > 0).select("_row", "copies")
    rows = with_row(docs.select(F.struct("*").alias("_doc")))
    copies = rows.join(plan, "_row").select("_doc", F.explode("copies").alias("_copy"))
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("mix_shard", "mix_draw")]
    return copies.select(*kept, F.col("_copy.shard").alias("mix_shard"), F.col("_copy.draw").alias("mix_draw"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of ``mixed`` shard by shard, each shard in the order of its draws; a shard may take many files."""
    order = ["mix_shard", "mix_draw"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
