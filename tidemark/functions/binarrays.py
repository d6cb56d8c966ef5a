"""Expressions on a histogram held as one dense array: entry ``i`` counts bin ``i``, the last one all beyond.

An array has ``top + 1`` entries, so whatever is done to it stays inside its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once however often ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def running(counts: Column, kind: str = "bigint") -> Column:
    """Inclusive running sums."""
    zero = F.lit(0).cast(kind)
    start = F.struct(zero.alias("sum"), F.array().cast(f"array<{kind}>").alias("all"))

    def add(state: Column, n: Column) -> Column:
        total = (state["sum"] + n).cast(kind)
        return F.struct(total.alias("sum"), F.array_append(state["all"], total).alias("all"))

    return F.aggregate(counts, start, add, lambda state: state["all"])


def uniform_sum(legs: Sequence[tuple[Column, Column]], top: int) -> Column:
    """Counts of the sum of independent legs that take each of their minutes low..high once.

    A leg spreads every count evenly over its range, so each entry is a difference of two
    running sums: linear in the bins for every leg, and no pair of bins is made. What
    lies beyond is the number of all ways less those below.
    """
    minutes = F.sequence(F.lit(0), F.lit(top - 1))
    (low, high), *others = [(a.cast("int"), b.cast("int")) for a, b in legs]
    counts = F.transform(minutes, lambda t: t.between(low, high).cast("bigint"))
    ways = F.greatest(F.lit(0), high - low + 1).cast("bigint")

    def spread(low: Column, high: Column) -> Callable[[Column], Column]:
        return lambda seen: F.transform(minutes, lambda t: _at(seen, t - low) - _at(seen, t - high - 1))

    for low, high in others:
        counts = let(running(counts), spread(low, high))
        ways = ways * F.greatest(F.lit(0), high - low + 1)
    return let(counts, lambda c: F.array_append(c, ways - F.aggregate(c, F.lit(0).cast("bigint"), lambda s, n: s + n)))


def _at(seen: Column, place: Column) -> Column:
    return F.coalesce(F.get(seen, place), F.lit(0))


def convolved(left: Column, right: Column, kind: str) -> Column:
    """Counts of the sum of two legs, both given up to the same top; products are of type ``kind``."""
    zero = F.lit(0).cast(kind)

    def below(a: Column, b: Column) -> Column:
        def total(t: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), t), zero, lambda s, i: (s + (a[i] * b[t - i]).cast(kind)).cast(kind))

        return F.transform(F.sequence(F.lit(0), F.size(a) - 2), total)

    def whole(a: Column, b: Column) -> Column:
        add = lambda s, n: (s + n).cast(kind)
        ways = (F.aggregate(a, zero, add) * F.aggregate(b, zero, add)).cast(kind)
        return let(below(a, b), lambda c: F.array_append(c, (ways - F.aggregate(c, zero, add)).cast(kind)))

    return let(left, lambda a: let(right, lambda b: whole(a, b)))


def first_bins(counts: Column, quantiles: Sequence[float]) -> Column:
    """Array of the first bins whose running count reaches each share of the total; the share 0 is bin 0."""
    for q in quantiles:
        if not 0.0 <= q <= 1.0:
            raise ValueError(f"quantile out of range: {q}")

    def reached(seen: Column, q: float) -> Column:
        wanted = F.element_at(seen, -1).cast("double") * F.lit(float(q))
        return F.size(F.filter(seen, lambda n: n.cast("double") < wanted)) if q else F.lit(0)

    return let(running(counts), lambda seen: F.array(*[reached(seen, q) for q in quantiles]))
