"""Car cells: percentiles, mean and fare per airport, origin and part of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import PLACEHOLDER_BOROUGHS, SAMPLE_FLOOR, WHOLE_DAY
from tidemark.functions.measures import round_even_1
from tidemark.functions.timeblocks import block_names
from tidemark.operators.histograms import summarise, two_grains

CELL_KEYS = ["airport", "origin", "grain"]
TIME, FARE = "time", "fare"


def reportable_zones(zones: DataFrame, airports: list[int]) -> DataFrame:
    """Real neighbourhoods: neither an airport nor a placeholder."""
    return zones.where(
        ~F.col("zone").isin(*airports)
        & ~F.col("borough").isin(*PLACEHOLDER_BOROUGHS)
        & ~F.startswith(F.col("name"), F.lit("Unknown zone"))
    )


def grains(fact: DataFrame, bin_col: str) -> DataFrame:
    """Both grains; companies and months add up on the way."""
    return two_grains(fact, ["airport", "origin"], "block", bin_col)


def _reported_origins(hist: DataFrame, zones: DataFrame, airports: list[int]) -> DataFrame:
    wanted = reportable_zones(zones, airports).select(F.col("zone").alias("origin"))
    return hist.join(wanted, "origin", "left_semi")


def car_cells(
    time_fact: DataFrame, fare_fact: DataFrame, zones: DataFrame, airports: list[int], floor: int = SAMPLE_FLOOR
) -> DataFrame:
    """The cells of two fact tables that are kept apart; see :func:`fact_cells`."""
    columns = ["airport", "origin", "block", "n"]
    time = time_fact.select(F.lit(TIME).alias("fact"), *columns, F.col("minutes").alias("bin"))
    fare = fare_fact.select(F.lit(FARE).alias("fact"), *columns, F.col("dollars").alias("bin"))
    return fact_cells(time.unionByName(fare), zones, airports, floor)


def fact_cells(facts: DataFrame, zones: DataFrame, airports: list[int], floor: int = SAMPLE_FLOOR) -> DataFrame:
    """``airport, origin, grain, n, mean, p50, p90, p95, fare, fare_p90``.

    ``facts`` holds both histograms as ``fact, airport, origin, block, bin, n``. They are
    summarised together, the fact being one more key, and then set side by side, so one
    scan and no self-join is needed. Cells under the floor are left out. A whole day never
    holds fewer trips than one of its blocks, so a zone without a day cell has no block
    cell either.
    """
    keys = ["fact", "airport", "origin"]
    both = two_grains(_reported_origins(facts, zones, airports), keys, "block", "bin")
    found = summarise(both, ["fact", *CELL_KEYS], "bin", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, mean="_mean")

    def of(fact: str, column: str) -> Column:
        return F.max(F.when(F.col("fact") == fact, F.col(column)))

    wide = found.groupBy(*CELL_KEYS).agg(
        of(TIME, "n").alias("n"), of(TIME, "_mean").alias("_mean"),
        of(TIME, "p50").alias("_p50"), of(TIME, "p90").alias("_p90"), of(TIME, "p95").alias("_p95"),
        of(FARE, "p50").alias("fare"), of(FARE, "p90").alias("fare_p90"),
    )
    return wide.where(F.col("n") >= floor).select(
        *CELL_KEYS, "n", round_even_1(F.col("_mean")).alias("mean"),
        F.col("_p50").alias("p50"), F.col("_p90").alias("p90"), F.col("_p95").alias("p95"), "fare", "fare_p90",
    )


def thin_cells(time_fact: DataFrame, zones: DataFrame, airports: list[int], floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Per airport: reported zones and the block cells they are missing."""
    per_block = (
        _reported_origins(time_fact, zones, airports).groupBy("airport", "origin", "block").agg(F.sum("n").alias("n"))
    )
    per_zone = (
        per_block.groupBy("airport", "origin")
        .agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= floor).alias("_kept"))
        .where(F.col("n") >= floor)
    )
    blocks = len(block_names())
    return per_zone.groupBy("airport").agg(
        F.count(F.lit(1)).alias("zones"), F.sum(F.lit(blocks) - F.col("_kept")).alias("thin")
    )


def corpus_totals(time_fact: DataFrame) -> DataFrame:
    """All trips in the facts, reportable or not."""
    return time_fact.groupBy("source").agg(
        F.sum("n").alias("weekday_trips"), F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month")
    )


def published_zones(zones: DataFrame, cells: DataFrame) -> DataFrame:
    """Zones with at least one reported cell."""
    reported = cells.where(F.col("grain") == WHOLE_DAY).select(F.col("origin").alias("zone")).distinct()
    return zones.join(reported, "zone", "left_semi")
