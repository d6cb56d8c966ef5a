"""Scalar expressions over trips, fares, cells and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import DRAW_MINUTES, TOP_DOLLAR, TOP_MINUTE


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two wall-clock readings, counting second boundaries."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def minute_bin(seconds: Column, top: int = TOP_MINUTE) -> Column:
    return F.least(F.floor(seconds / F.lit(60.0)).cast("int"), F.lit(top))


def dollar_bin(fare: Column, top: int = TOP_DOLLAR) -> Column:
    """Whole dollars, halves away from zero."""
    return F.least(F.round(fare).cast("int"), F.lit(top))


def signed_sum(plus: Sequence[Column], minus: Sequence[Column] = ()) -> Column:
    """Sum of the parts with an absent part counted as 0."""
    terms = [F.coalesce(c, F.lit(0)) for c in plus] + [-F.coalesce(c, F.lit(0)) for c in minus]
    return reduce(add, terms)


def clean_text(value: Column, default: Column) -> Column:
    """Trimmed text; blank and NULL become the default."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default)


def verdict(car_p90: Column, transit_p90: Column, draw: int = DRAW_MINUTES) -> Column:
    gap = car_p90 - transit_p90
    return (
        F.when(car_p90.isNull() & transit_p90.isNull(), "unknown")
        .when(transit_p90.isNull(), "car only")
        .when(car_p90.isNull(), "transit only")
        .when(F.abs(gap) < draw, "too close to call")
        .when(gap > 0, "transit")
        .otherwise("car")
    )


def implied_minutes(distance: Column, speed: Column) -> Column:
    """NULL unless the speed is positive."""
    return F.try_divide(distance, F.when(speed > 0, speed)) * F.lit(60.0)


def month_key(ts: Column) -> Column:
    """``YYYY-MM`` of a timestamp or of ISO timestamp text."""
    return F.substring(ts.cast("string"), 1, 7)


def month_span(first: Column, last: Column) -> Column:
    """``Jan 2026``, ``Jan to May 2026`` or ``Nov 2025 to May 2026`` from ``YYYY-MM`` keys."""

    def part(key: Column, pattern: str) -> Column:
        return F.date_format(F.to_date(F.concat(key, F.lit("-01"))), pattern)

    return (
        F.when(first.isNull() | last.isNull(), F.lit(""))
        .when(first == last, part(first, "MMM yyyy"))
        .when(
            part(first, "yyyy") == part(last, "yyyy"),
            F.concat(part(first, "MMM"), F.lit(" to "), part(last, "MMM yyyy")),
        )
        .otherwise(F.concat(part(first, "MMM yyyy"), F.lit(" to "), part(last, "MMM yyyy")))
    )


def round_even_0(value: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(value)


def round_even_1(value: Column) -> Column:
    """Nearest tenth of the exact binary value, exact ties to even.

    ``bround`` works on the shortest decimal text, so it rounds 0.15 up although
    the stored number lies below 0.15. Here the sign of ``20*value - (2k+1)`` is
    found without rounding error by splitting the value into two halves whose
    products with 20 are exact.
    """
    tenths = F.floor(value * F.lit(10.0)).cast("double")
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    low = value - high
    beyond = (high * F.lit(20.0) - (tenths * F.lit(2.0) + F.lit(1.0))) + low * F.lit(20.0)
    step = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(F.abs(tenths % F.lit(2.0)))
    return (tenths + step) / F.lit(10.0)
