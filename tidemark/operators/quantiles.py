"""Exact quantiles of raw values, without gathering a group anywhere.

Values are first counted per distinct value (combined on the map side), then per
coarse bucket. The few bucket counts of a key tell which bucket holds each wanted
rank; only those buckets are ordered, each in its own window partition. A key that
holds a third of all rows is spread over its values, then over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR = "linear"
LOWER = "lower"


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float | tuple[float, str]],
    bucket: Column,
    weight: str | None = None,
) -> DataFrame:
    """``keys, n, <one column per quantile>``; rows with a NULL value or key are left out.

    ``bucket`` must never decrease as ``value`` grows. A quantile is a number, or a
    number and a method: ``linear`` (the default) interpolates between the two
    nearest ranks; ``lower`` takes the value at rank floor(q*(n-1)).
    ``weight`` names a column saying how many rows each row stands for.
    """
    keys = list(keys)
    wanted_ranks = {name: q if isinstance(q, tuple) else (q, LINEAR) for name, q in quantiles.items()}
    # Said up front, so that no join adds it to one reader only and both share one shuffle.
    present = reduce(and_, [F.col(c).isNotNull() for c in (*keys, value)], bucket.isNotNull())
    counted = (
        df.where(present)
        .groupBy(*keys, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_bucket", bucket)
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    running = by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_held"))
        .withColumn("_upto", F.sum("_held").over(running))
        .withColumn("_all", F.sum("_held").over(whole))
    )

    ranks = []
    for name, (q, method) in wanted_ranks.items():
        if not 0.0 <= q <= 1.0:
            raise ValueError(f"quantile out of range: {q}")
        position = F.lit(float(q)) * (F.col("_all") - 1).cast("double")
        below = F.floor(position)
        share = position - below if method == LINEAR else F.lit(0.0)
        ranks.append(F.struct(F.lit(name).alias("name"), below.alias("rank"), (F.lit(1.0) - share).alias("share")))
        if method == LINEAR:
            ranks.append(F.struct(F.lit(name).alias("name"), F.ceil(position).alias("rank"), share.alias("share")))

    wanted = (
        sized.withColumn("_want", F.explode(F.array(*ranks)))
        .where((F.col("_want.rank") < F.col("_upto")) & (F.col("_want.rank") >= F.col("_upto") - F.col("_held")))
        .groupBy(*keys, "_bucket", (F.col("_upto") - F.col("_held")).alias("_before"), "_all")
        .agg(F.collect_list("_want").alias("_wants"))
    )
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        counted.join(wanted, [*keys, "_bucket"])
        .withColumn("_seen", F.col("_before") + F.sum("_n").over(in_bucket))
        .withColumn("_want", F.explode("_wants"))
        .where((F.col("_want.rank") < F.col("_seen")) & (F.col("_want.rank") >= F.col("_seen") - F.col("_n")))
    )

    def picked(name: str, method: str) -> Column:
        mine = F.col("_want.name") == name
        if method == LOWER:
            return F.max(F.when(mine, F.col(value))).alias(name)
        return F.sum(F.when(mine, F.col(value) * F.col("_want.share"))).alias(name)

    return hits.groupBy(*keys).agg(F.max("_all").alias("n"), *[picked(name, method) for name, (_, method) in wanted_ranks.items()])
