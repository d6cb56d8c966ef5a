"""Transit journeys: a measured ride to a connector plus modelled legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import SAMPLE_FLOOR, TOP_MINUTE
from tidemark.functions.binarrays import first_bins, uniform_sum
from tidemark.operators.histograms import headway, unpacked

OVERHEAD_KEYS = ["headway", "transfer_low", "transfer_high", "wait_low", "wait_high", "ride_low", "ride_high"]
JOURNEY_KEYS = ["airport", "station", "link_pos", "route_pos"]


def routed_links(links: DataFrame) -> DataFrame:
    """One row per link and feeder route, keeping both positions."""
    return links.select("*", F.posexplode("routes").alias("route_pos", "route")).drop("routes")


def ride_cells(directions: DataFrame, links: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Measured rides from every station before the connector, with their median wait.

    Stations, pairs and waits are looked up inside each direction's own row, so the
    only join is the small one between routes and links.
    """
    at = F.array_position("names", F.col("connector"))
    reach = directions.join(routed_links(links), "route").where(F.array_contains("names", F.col("connector")))
    stops = reach.select(
        "*", (at - 1).alias("_target"), F.posexplode(F.slice(F.col("names"), F.lit(1), (at - 1).cast("int"))).alias("idx", "station")
    )
    pair = F.try_element_at("pairs", F.concat_ws("-", "idx", "_target"))
    wait = F.try_element_at("waits", F.col("idx").cast("string"))
    cells = stops.select(
        "airport", "link_pos", "route_pos", "route", "dir_pos", "idx", "station", "connector", "link",
        "ride_low", "ride_high", "wait_low", "wait_high", "transfer_low", "transfer_high",
        wait.alias("_waits"),
        F.explode(pair).alias("block", "_ride"),
    )
    return cells.select(
        "*",
        F.col("_ride.n").alias("n"),
        F.col("_ride.p50").alias("ride_p50"),
        F.col("_ride.p90").alias("ride_p90"),
        F.try_element_at("_waits", F.col("block")).alias("median_wait"),
    ).where((F.col("n") >= floor) & F.col("median_wait").isNotNull()).drop("_ride", "_waits")


def with_link_ride(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The link's own ride range, else the measured one of the block, else no cell."""
    low = F.coalesce("ride_low", "seg_low")
    high = F.coalesce("ride_high", "seg_high")
    return (
        cells.join(ranges, "block", "left")
        .withColumn("ride_low", low)
        .withColumn("ride_high", high)
        .drop("seg_low", "seg_high")
        .where(F.col("ride_low").isNotNull() & F.col("ride_high").isNotNull())
    )


def _overhead(top: int) -> Column:
    """Counts of wait + transfer + link wait + link ride of a cell, as one dense array."""
    legs = [(F.lit(0), F.col("headway"))] + [(F.col(f"{leg}_low"), F.col(f"{leg}_high")) for leg in ("transfer", "wait", "ride")]
    return uniform_sum(legs, top)


def overheads(cells: DataFrame, top: int = TOP_MINUTE) -> DataFrame:
    """Distribution of wait + transfer + link wait + link ride per distinct combination.

    Cells share few combinations, so convolving happens once per combination rather
    than once per cell, and its size follows the model rather than the data.
    """
    combos = cells.select(*OVERHEAD_KEYS).distinct()
    return unpacked(combos, OVERHEAD_KEYS, _overhead(top), "bin")


def door_to_door(cells: DataFrame, top: int = TOP_MINUTE) -> DataFrame:
    """Measured ride percentiles plus overhead percentiles: the cautious sum.

    The overhead is worked out inside each cell's row, so the cells are read once and not joined.
    """
    return (
        cells.withColumn("headway", headway(F.col("median_wait")))
        .withColumn("_over", first_bins(_overhead(top), (0.5, 0.9)))
        .where(F.col("_over").isNotNull())
        .withColumn("overhead_p50", F.col("_over")[0])
        .withColumn("overhead_p90", F.col("_over")[1])
        .withColumn("door_p50", F.col("ride_p50") + F.col("overhead_p50"))
        .withColumn("door_p90", F.col("ride_p90") + F.col("overhead_p90"))
        .drop("_over")
    )


def journeys(cells: DataFrame) -> DataFrame:
    """One row per airport, station, link and route with its block cells and typical time.

    A station met in two directions of a route keeps the later one. A journey holds
    at most one cell per part of the day.
    """
    block = F.struct("block", "n", "ride_p50", "ride_p90", "overhead_p50", "overhead_p90", "door_p50", "door_p90")
    per_stop = cells.groupBy(*JOURNEY_KEYS, "dir_pos", "idx", "route", "connector", "link").agg(
        F.array_sort(F.collect_list(block)).alias("blocks"),
        (F.sum("door_p50").cast("double") / F.count(F.lit(1)).cast("double")).alias("typical"),
    )
    latest = Window.partitionBy(*JOURNEY_KEYS).orderBy(F.desc("dir_pos"), F.desc("idx"))
    return per_stop.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "dir_pos", "idx")


def best_journeys(journeys: DataFrame) -> DataFrame:
    """The fastest journey per airport and station; the first listed wins a tie."""
    best = Window.partitionBy("airport", "station").orderBy("typical", "link_pos", "route_pos")
    return journeys.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def block_rows(journeys: DataFrame) -> DataFrame:
    return journeys.select("*", F.inline("blocks")).drop("blocks")
