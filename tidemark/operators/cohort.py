"""Cohort medians against a published baseline, component audit and profiles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import COHORT_BASELINE_MINUTES, COHORT_HOUR
from tidemark.functions.measures import month_span, round_even_0
from tidemark.functions.timeblocks import is_working_day
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.selection import few_group_quantiles
from tidemark.sources.trips import duration_in_range

POOLED = "all"


def cohort_trips(trips: DataFrame, airport: int, hour: int = COHORT_HOUR, origins: list[int] | None = None) -> DataFrame:
    """Working-day trips to one airport picked up within one hour."""
    chosen = trips.where(
        (F.col("airport") == airport)
        & (F.hour("pickup") == hour)
        & is_working_day(F.col("pickup"))
        & duration_in_range()
    )
    return chosen if origins is None else chosen.where(F.col("origin").isin(*origins))


def cohort_medians(cohort: DataFrame, group: str = "source", baseline: int = COHORT_BASELINE_MINUTES) -> DataFrame:
    """Median minutes per group, pooled and by month, with the months it rests on.

    Trips are counted per second of duration first, so a median works on at most
    one entry per second below the longest trip allowed. A group without trips is
    simply not there.
    """
    seconds = cohort.groupBy(group, "year_month", "duration_s").agg(F.count(F.lit(1)).alias("_n"))
    both = seconds.groupingSets(
        [[group, "year_month", "duration_s"], [group, "duration_s"]], group, "year_month", "duration_s"
    ).agg(
        F.sum("_n").alias("_n"), F.grouping("year_month").alias("_pooled")
    )
    minutes = F.col("duration_s") / F.lit(60.0)
    label = F.when(F.col("_pooled") == 1, F.lit(POOLED)).otherwise(F.col("year_month"))
    medians = both.groupBy(group, label.alias("month")).agg(
        round_even_0(F.percentile(minutes, F.lit(0.5), F.col("_n"))).cast("int").alias("median"),
        F.sum("_n").alias("trips"),
    )
    months = seconds.groupBy(group, "year_month").agg(F.sum("_n").alias("_n")).groupBy(group).agg(
        F.min("year_month").alias("_first"), F.max("year_month").alias("_last"), F.count(F.lit(1)).alias("_months"),
        F.array_join(F.array_sort(F.collect_list("year_month")), ",").alias("_list"),
    )
    pooled = F.col("month") == POOLED
    first = F.when(pooled, F.col("_first")).otherwise(F.col("month"))
    last = F.when(pooled, F.col("_last")).otherwise(F.col("month"))
    return medians.join(months, group).select(
        group, "month", "median", "trips",
        F.when(pooled, F.col("_months")).otherwise(F.lit(1)).cast("bigint").alias("months"),
        first.alias("first_month"),
        last.alias("last_month"),
        F.when(pooled, F.col("_list")).otherwise(F.col("month")).alias("month_list"),
        month_span(first, last).alias("span"),
        (F.col("median") / F.lit(float(baseline)) - F.lit(1.0)).alias("change"),
    )


def windowed_feeds(feeds: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Trips of several feeds, each over its own months (first and last); an error names the feeds if none has any.

    A feed without trips adds nothing and is not in what is made of them.
    """
    parts = [trips.where(F.col("year_month").between(first, last)) for trips, first, last in feeds.values()]
    pooled = reduce(DataFrame.unionByName, parts)
    if pooled.isEmpty():
        raise RuntimeError(f"no trips in any of {', '.join(sorted(feeds))}")
    return pooled


def month_union(parts: list[DataFrame], month: str = "year_month") -> DataFrame:
    """Distinct months of several tables, in order; each side is reduced to its months first."""
    keys = [p.select(month).distinct() for p in parts]
    stacked = keys[0]
    for other in keys[1:]:
        stacked = stacked.unionByName(other)
    return stacked.distinct().orderBy(month)


def component_medians(rows: DataFrame, keys: list[str], components: dict[str, Column], bucket_width: float) -> DataFrame:
    """Median of every component per key. A component that adds up absent parts stays NULL for that row."""
    long = rows.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("component"), col.cast("double").alias("value")) for name, col in components.items()])
        ).alias("_c"),
    ).select(*keys, "_c.component", "_c.value")
    medians = exact_quantiles(
        long, [*keys, "component"], "value", {"median": 0.5}, F.floor(F.col("value") / F.lit(bucket_width))
    )
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"))
    wide = medians.groupBy(*keys).pivot("component", list(components)).agg(F.first("median"))
    return counts.join(wide, keys, "left")


def profile(trips: DataFrame, key: str, values: dict[str, Column], quantiles: dict[str, tuple[str, float]], extra: dict[str, Column] | None = None) -> DataFrame:
    """Count, interpolated quantiles of several values and plain aggregates per key, in two scans; keys are few."""
    return few_group_quantiles(trips, [key], values, quantiles, {"trips": F.count(F.lit(1)), **(extra or {})})
