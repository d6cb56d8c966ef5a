"""Guards: report tables first, failure on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.fixed_values import (
    SEGMENT_UNIT_ABSOLUTE,
    SEGMENT_UNIT_MIN_ROWS,
    SEGMENT_UNIT_RELATIVE,
    UNIT_RATIO_BOUNDS,
    UNIT_RATIO_MIN_SECONDS,
)
from tidemark.functions.measures import implied_minutes
from tidemark.operators.selection import few_group_quantiles


class GuardFailure(RuntimeError):
    """Raised with the failing rows when a report is enforced."""


def unit_ratio_report(trips: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Median of duration over timestamp gap per key, for trips long enough to tell.

    The keys are few (months, feeds): the trips are read twice and hardly shuffled.
    ``wanted`` holds the keys that have to be there: one without any trip is reported as
    having no usable rows.
    """
    is_long = F.coalesce(F.col("duration_s") > UNIT_RATIO_MIN_SECONDS, F.lit(False))
    ratio = F.try_divide(F.col("duration_s").cast("double"), F.col("gap_s").cast("double"))
    low, high = UNIT_RATIO_BOUNDS
    found = few_group_quantiles(trips, keys, {"ratio": F.when(is_long, ratio)}, {"ratio": ("ratio", 0.5)}, {"checked": F.count_if(is_long)})
    if wanted is not None:
        found = wanted.select(*keys).distinct().join(found, keys, "left").fillna(0, ["checked"])
    status = (
        F.when(F.col("checked") == 0, "no usable rows")
        .when(F.coalesce(F.col("ratio").between(low, high), F.lit(False)), "ok")
        .otherwise("unit changed")
    )
    return found.select(*keys, "checked", "ratio", status.alias("status"))


def segment_unit_report(rows: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Stated minutes against distance over speed, row by row, counted per key.

    ``unparsed`` counts rows whose travel time, or whose number of buses, is there but
    no number. ``wanted`` holds the keys that have to be there.
    """
    implied = implied_minutes(F.col("road_distance"), F.col("average_road_speed"))
    allowed = F.greatest(F.lit(SEGMENT_UNIT_ABSOLUTE), F.lit(SEGMENT_UNIT_RELATIVE) * F.col("_implied"))
    off = F.abs(F.col("_implied") - F.col("average_travel_time")) > allowed
    usable = F.col("_implied").isNotNull() & F.col("average_travel_time").isNotNull()
    unparsed = F.col("average_travel_time").isNull() | F.col("bus_trip_count").isNull()
    status = (
        F.when(F.col("violations") > 0, "unit changed")
        .when(F.col("unparsed") > 0, "unparsed rows")
        .when(F.col("usable") < SEGMENT_UNIT_MIN_ROWS, "too few rows")
        .otherwise("ok")
    )
    counts = (
        rows.withColumn("_implied", implied)
        .groupBy(*keys)
        .agg(F.count_if(usable).alias("usable"), F.count_if(usable & off).alias("violations"), F.count_if(unparsed).alias("unparsed"))
    )
    if wanted is not None:
        counts = wanted.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["usable", "violations", "unparsed"])
    return counts.withColumn("status", status)


def passed_rows(report: DataFrame, accepted: tuple[str, ...] = ("ok",)) -> list[Row]:
    """All rows of a report, or :class:`GuardFailure` naming every failing one; a report has one per month or leg."""
    rows = report.collect()
    failing = [row for row in rows if row.status not in accepted]
    if failing:
        raise GuardFailure(f"{len(failing)} failing: " + "; ".join(str(row.asDict()) for row in failing))
    return rows


def enforce(report: DataFrame, accepted: tuple[str, ...] = ("ok",)) -> DataFrame:
    """The report, if it passes."""
    passed_rows(report.where(~F.col("status").isin(*accepted)), accepted)
    return report
