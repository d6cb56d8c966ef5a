"""Expressions on arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _sums(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    add = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["all"], acc["sum"] + v).alias("all"))
    return F.aggregate(values, start, add, lambda acc: acc["all"])


def running(values: Column) -> Column:
    """Inclusive running sums of an array of ints, in chunks, so that long arrays stay cheap."""

    def whole(v: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
            lambda c: _sums(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))),
        )
        return let(chunks, lambda parts: F.flatten(F.zip_with(parts, _sums(F.transform(parts, lambda p: F.element_at(p, -1))), shifted)))

    def shifted(part: Column, end: Column) -> Column:
        return F.transform(part, lambda v: v + end - F.element_at(part, -1))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))
