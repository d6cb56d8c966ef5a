"""From trips to the two fact histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import TOP_DOLLAR, TOP_MINUTE
from tidemark.functions.measures import dollar_bin, minute_bin
from tidemark.functions.timeblocks import block_of
from tidemark.operators.histograms import count_bins
from tidemark.sources.trips import duration_in_range, fare_in_range, is_complete, is_working_day

TIME_KEYS = ["airport", "origin", "company", "block"]
FARE_KEYS = ["airport", "origin", "block"]


def with_bins(trips: DataFrame, top_minute: int = TOP_MINUTE, top_dollar: int = TOP_DOLLAR) -> DataFrame:
    return trips.select(
        "source",
        "year_month",
        "airport",
        "origin",
        "company",
        block_of(F.col("pickup")).alias("block"),
        minute_bin(F.col("duration_s"), top_minute).alias("minutes"),
        dollar_bin(F.col("fare"), top_dollar).alias("dollars"),
        "duration_s",
        "gap_s",
    )


def time_histogram(binned: DataFrame) -> DataFrame:
    return count_bins(binned, TIME_KEYS, "minutes")


def fare_histogram(binned: DataFrame) -> DataFrame:
    return count_bins(binned, FARE_KEYS, "dollars")


def validity_counts(trips: DataFrame, airports: list[int]) -> DataFrame:
    """How many trips fail each test, and how many pass them all, by source."""
    there = F.coalesce(F.col("airport").isin(*airports), F.lit(False))
    complete = is_complete()
    lasting = F.coalesce(duration_in_range(), F.lit(False))
    priced = F.coalesce(fare_in_range(), F.lit(False))
    working = F.coalesce(is_working_day(F.col("pickup")), F.lit(False))
    return trips.groupBy("source").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(~there).alias("elsewhere"),
        F.count_if(~complete).alias("incomplete"),
        F.count_if(~lasting).alias("bad_duration"),
        F.count_if(~priced).alias("bad_fare"),
        F.count_if(~working).alias("weekend"),
        F.count_if(there & complete & lasting & priced & working).alias("usable"),
    )
