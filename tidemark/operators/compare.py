"""Car against transit, zone by zone and block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import WHOLE_DAY
from tidemark.functions.measures import verdict
from tidemark.functions.timeblocks import block_names

VERDICT_COLUMNS = {"car": "car", "transit": "transit", "too close to call": "draw"}


def best_station(station_zone: DataFrame, journeys: DataFrame) -> DataFrame:
    """The quickest journey of any station in the zone, matched by station name.

    ``journeys`` holds one row per airport and station. A name listed twice in a
    zone counts once, at its first position; the earliest position wins a tie.
    """
    named = station_zone.groupBy("zone", "station").agg(F.min("pos").alias("pos"))
    first = Window.partitionBy("airport", "zone").orderBy("typical", "pos")
    return (
        named.join(journeys, "station")
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .drop("_rn")
    )


def compare_modes(cells: DataFrame, best: DataFrame, zones: DataFrame, fares: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per airport, zone and block with both modes, the verdict and the safe lead time.

    Zones come from the car side; within a zone either mode may lack a block. A zone
    gathers its cells (one per part of the day and one for the whole day) and looks
    both modes up per block. ``fares`` and ``evidence`` are lookups by airport.
    """
    entry = F.struct(F.col("grain"), F.struct("p50", "p90", "n", "fare").alias("cell"))
    car_zones = (
        cells.groupBy("airport", F.col("origin").alias("zone"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_car"))
        .where(F.map_contains_key("_car", F.lit(WHOLE_DAY)))
    )
    by_block = F.map_from_entries(F.transform("blocks", lambda b: F.struct(b["block"], b)))
    options = best.select("airport", "zone", "station", "route", "link", "connector", by_block.alias("_transit"))
    blocks = F.array(*[F.lit(b) for b in block_names()])
    rows = (
        car_zones.join(options, ["airport", "zone"], "left")
        .select("*", F.explode(blocks).alias("block"))
        .withColumn("_c", F.try_element_at("_car", F.col("block")))
        .withColumn("_t", F.try_element_at("_transit", F.col("block")))
        .where(F.col("_c").isNotNull() | F.col("_t").isNotNull())
    )
    looked_up = (
        rows.join(zones, "zone", "left").join(fares, "airport", "left").join(evidence, "airport", "left")
        .withColumns({"car_p50": F.col("_c.p50"), "car_p90": F.col("_c.p90"), "transit_p50": F.col("_t.door_p50"), "transit_p90": F.col("_t.door_p90")})
    )
    return looked_up.select(
        "airport", "zone",
        F.coalesce("name", F.col("zone").cast("string")).alias("name"),
        F.coalesce("borough", F.lit("")).alias("borough"),
        "block", "car_p50", "car_p90",
        F.col("_c.n").alias("car_n"), F.col("_c.fare").alias("car_fare"),
        "transit_p50", "transit_p90",
        F.when(F.col("transit_p90").isNotNull(), F.col("transit_fare")).alias("transit_fare"),
        F.least("car_p90", "transit_p90").alias("lead_minutes"),
        verdict(F.col("car_p90"), F.col("transit_p90")).alias("verdict"),
        (F.col("car_p90") - F.col("car_p50")).alias("car_buffer"),
        F.abs(F.col("car_p90") - F.col("transit_p90")).alias("margin"),
        "station", "route", "link", "connector",
        F.when(F.col("station").isNotNull(), F.col("transit_evidence")).alias("transit_evidence"),
    )


def verdict_tally(comparison: DataFrame) -> DataFrame:
    """Verdict counts per airport and block, over cells that have both modes."""
    both = comparison.where(F.col("car_p90").isNotNull() & F.col("transit_p90").isNotNull())
    counts = both.groupBy("airport", "block").pivot("verdict", list(VERDICT_COLUMNS)).count()
    return counts.select(
        "airport", "block", *[F.coalesce(F.col(v), F.lit(0)).alias(name) for v, name in VERDICT_COLUMNS.items()]
    )


def default_zone(comparison: DataFrame) -> DataFrame:
    """Zone to open on per airport and block: the widest lead of transit over car, else the first zone.

    Every block of an airport has a row, also one without any cell.
    """
    gap = F.col("car_p90") - F.col("transit_p90")
    ranked = F.when(gap.isNotNull(), F.struct(gap, -F.col("zone")))
    per_block = comparison.groupBy("airport", "block").agg(
        F.max_by("zone", ranked).alias("_widest"), F.max(gap).alias("gap"), F.min("zone").alias("_lowest")
    )
    named = F.filter(F.collect_list(F.struct("block", "_widest", "gap")), lambda b: b["block"].isNotNull())
    blocks = F.array(*map(F.lit, block_names()))
    per_airport = per_block.groupBy("airport").agg(F.min("_lowest").alias("_first"), F.map_from_arrays(named["block"], named).alias("_found"))
    found = F.try_element_at("_found", F.col("block"))
    return per_airport.select("airport", "_first", "_found", F.explode(blocks).alias("block")).select(
        "airport", "block", F.coalesce(found["_widest"], F.col("_first")).alias("zone"), found["gap"].alias("gap")
    )


def coverage_counts(comparison: DataFrame) -> DataFrame:
    """Zones and zones with a transit option per airport; an airport appears when it has a zone."""
    per_zone = comparison.groupBy("airport", "zone").agg(F.max(F.col("station").isNotNull()).alias("_served"))
    return per_zone.groupBy("airport").agg(F.count(F.lit(1)).alias("zones"), F.count_if("_served").alias("with_transit"))
