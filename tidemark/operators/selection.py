"""Exact quantiles of few groups in two scans: bracket each rank, then count what lies between the brackets.

The first scan takes a mergeable summary of every value column per group. A summary errs by a
known share of the rows, so it brackets each wanted rank between two values for certain. The
second scan counts the rows inside the brackets by value, and those outside by the gap they
fall in, all on the map side. What is shuffled is a summary per task and group, and then about
``2 * MARGIN`` of the distinct values per quantile, however the values are spread and however
many rows one group holds. All quantiles of all columns, and plain aggregates, share the scans.

For groups of a closed domain (months, hours of the day, companies): their brackets, one row per
group, are broadcast to the second scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One over the share of rows a summary may err by, and the share a bracket leaves on either side.
ACCURACY, MARGIN = 4000, 0.002

#: Up to so many rows a group is bracketed by its least and greatest value.
FEW = int(2 / (MARGIN - 1 / ACCURACY)) + 1


def few_group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    quantiles: Mapping[str, tuple[str, float]],
    plain: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``keys``, the ``plain`` aggregates, and a column for each quantile: (name in ``values``, share).

    A quantile interpolates between the two nearest ranks of the values that are there; it
    is NULL for a group without any. A NULL key is a group as well.
    """
    keys, plain = list(keys), dict(plain or {})
    names = list(values)
    for q in quantiles.values():
        if not 0.0 <= q[1] <= 1.0:
            raise ValueError(f"quantile out of range: {q[1]}")
    rows = df.select("*", *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())])
    wanted = [(names.index(of), q) for of, q in quantiles.values()]

    brackets = rows.groupBy(*keys).agg(*[c.alias(f"_plain_{name}") for name, c in plain.items()], *_summaries(len(names), wanted))
    brackets = brackets.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[f"_plain_{name}" for name in plain], *[f"_n{i}" for i in range(len(names))], *_edges(wanted)
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    dealt = rows.select(*keys, *[f"_v{i}" for i in range(len(names))]).join(F.broadcast(brackets), same)

    carried = [c for c in brackets.columns if not c.startswith(("_key_", "_low", "_high"))]
    places = F.array(*[_place(i, [j for j, (of, _) in enumerate(wanted) if of == i]) for i in range(len(names))])
    counted = (
        dealt.select(*keys, *carried, F.inline(places))
        .groupBy(*keys, "_of", "_gap", "_kept")
        .agg(F.count("_at").alias("_rows"), F.min("_at").alias("_at"), *[F.first(c).alias(c) for c in carried])
    )
    in_order = Window.partitionBy(*keys, "_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = counted.withColumn("_seen", F.sum("_rows").over(in_order))

    def at(rank: Column, of: int) -> Column:
        here = (F.col("_of") == of) & (F.col("_seen") > rank) & (F.col("_seen") - F.col("_rows") <= rank)
        bad = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
        return F.max(F.when(here, F.coalesce("_kept", bad)))

    found = []
    for (name, _), (of, q) in zip(quantiles.items(), wanted, strict=True):
        position = F.lit(float(q)) * (F.col(f"_n{of}") - 1).cast("double")
        share = F.max(position - F.floor(position))
        found.append((at(F.floor(position), of) * (F.lit(1.0) - share) + at(F.ceil(position), of) * share).alias(name))
    return seen.groupBy(*keys).agg(*[F.first(f"_plain_{name}").alias(name) for name in plain], *found)


def _summaries(columns: int, wanted: list[tuple[int, float]]) -> list[Column]:
    out = []
    for i in range(columns):
        value = F.col(f"_v{i}")
        out += [F.count(value).alias(f"_n{i}"), F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}")]
        shares = [share for of, q in wanted if of == i for share in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
        out.append(F.percentile_approx(value, shares or [0.5], ACCURACY).alias(f"_shares{i}"))
    return out


def _edges(wanted: list[tuple[int, float]]) -> list[Column]:
    out, taken = [], {}
    for j, (of, _) in enumerate(wanted):
        at = taken[of] = taken.get(of, -1) + 1
        few = F.col(f"_n{of}") <= FEW
        out.append(F.when(few, F.col(f"_min{of}")).otherwise(F.get(f"_shares{of}", F.lit(2 * at))).alias(f"_low{j}"))
        out.append(F.when(few, F.col(f"_max{of}")).otherwise(F.get(f"_shares{of}", F.lit(2 * at + 1))).alias(f"_high{j}"))
    return out


def _place(of: int, brackets: list[int]) -> Column:
    """The value if it lies in a bracket of its column, and how many brackets end below it."""
    value, none = F.col(f"_v{of}"), F.lit(None).cast("double")
    inside = reduce(or_, [value.between(F.col(f"_low{j}"), F.col(f"_high{j}")) for j in brackets], F.lit(False))
    below = sum(((value > F.col(f"_high{j}")).cast("int") for j in brackets), F.lit(0))
    return F.struct(
        F.lit(of).alias("_of"), F.coalesce(F.when(inside, F.lit(-1)).otherwise(below), F.lit(-2)).alias("_gap"), F.when(inside, value).otherwise(none).alias("_kept"), value.alias("_at")
    )
