"""Airport bus legs summarised from month-weekday-hour averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import SEGMENT_ROW_FLOOR, WORKING_DAYS
from tidemark.functions.measures import round_even_1
from tidemark.functions.timeblocks import block_of_clock

LEG_KEYS = ["route_id", "direction", "stop_order"]


def stack_vintages(vintages: list[DataFrame]) -> DataFrame:
    """Dataset vintages of one feed as one table; an empty one adds nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), vintages)


def leg_rows(rows: DataFrame, legs: DataFrame) -> DataFrame:
    """Rows of the wanted legs; the specification is a handful of rows, sized by the planner."""
    return rows.join(legs, LEG_KEYS)


def _working_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("day_of_week").isin(*WORKING_DAYS)).withColumn("block", block_of_clock(F.col("hour_of_day")))


def _rank(values: Column, q: float, linear: bool) -> Column:
    """Value of a sorted array at rank ``q*(n-1)``: the rank below, or between the two nearest."""
    place = F.lit(q) * (F.size(values) - 1).cast("double")
    below, above = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    share = place - F.floor(place)
    return below * (F.lit(1.0) - share) + above * share if linear else below


def leg_blocks(rows: DataFrame, floor: int = SEGMENT_ROW_FLOOR) -> DataFrame:
    """``route_id, block, cells, buses_per_cell, typical, low, high, worst_cell``, one decimal.

    A leg has one row per month, weekday and hour, so a block's values are as many as its
    calendar has such cells and fit in one sorted array: one scan and one shuffle.
    """
    keys = ["route_id", "block"]
    minutes = F.array_sort(F.collect_list("average_travel_time"))
    per_block = _working_rows(rows).groupBy(*keys).agg(
        minutes.alias("_minutes"), (F.sum("bus_trip_count").cast("double") / F.count(F.lit(1)).cast("double")).alias("buses_per_cell")
    )
    values = F.col("_minutes")
    found = {"typical": _rank(values, 0.5, True), "low": _rank(values, 0.1, False), "high": _rank(values, 0.9, False), "worst_cell": F.element_at(values, -1)}
    return per_block.where(F.size(values) >= F.greatest(F.lit(floor), F.lit(1))).select(
        *keys, F.size(values).cast("bigint").alias("cells"),
        round_even_1(F.col("buses_per_cell")).alias("buses_per_cell"), *[round_even_1(c).alias(name) for name, c in found.items()],
    )


def leg_totals(rows: DataFrame) -> DataFrame:
    """Months seen and buses observed per leg; months are counted after one row per month is left."""
    per_month = _working_rows(rows).groupBy("route_id", "year_month").agg(F.sum("bus_trip_count").alias("_buses"))
    return per_month.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("months"), F.sum("_buses").alias("buses_observed")
    )


def leg_summary(rows: DataFrame, floor: int = SEGMENT_ROW_FLOOR) -> DataFrame:
    """The published leg table: totals of the leg beside each of its blocks."""
    return leg_totals(rows).join(leg_blocks(rows, floor), "route_id")


def ride_ranges(blocks: DataFrame) -> DataFrame:
    """Whole-minute ride range per route and block, at least a minute wide."""
    low = F.col("low").cast("int")
    return blocks.select(
        "route_id",
        "block",
        low.alias("seg_low"),
        F.greatest(F.col("high").cast("int"), low + 1).alias("seg_high"),
    )
