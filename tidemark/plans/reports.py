"""The whole pipelines, from sources to report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import AIRPORT_NAMES, LINK_EVIDENCE, OFF_FRAME_ZONES, RAIL_LINKS, SAMPLE_FLOOR, SEGMENT_LEGS, TRANSFER_RANGE, TRANSIT_FARES
from tidemark.functions.timeblocks import is_working_day
from tidemark.operators.cells import car_cells
from tidemark.operators.cohort import component_medians
from tidemark.operators.compare import best_station, compare_modes
from tidemark.operators.guards import enforce, segment_unit_report
from tidemark.operators.journeys import best_journeys, door_to_door, journeys, ride_cells, with_link_ride
from tidemark.operators.mapview import frame_box, projected_parts, zone_outlines
from tidemark.operators.segments import leg_blocks, leg_rows, leg_summary, ride_ranges, stack_vintages
from tidemark.operators.spatial import locate
from tidemark.session import staged
from tidemark.sources.months import FARE_FACT, TIME_FACT, read_fact
from tidemark.sources.trips import RIDE_HAIL

LINK_COLUMNS = (
    "airport string, link_pos int, routes array<string>, connector string, link string, "
    "ride_low int, ride_high int, wait_low int, wait_high int, transfer_low int, transfer_high int"
)
LEG_COLUMNS = (
    "route_id string, direction string, stop_order int, junction string, junction_aliases array<string>, terminal string"
)


def link_table(spark: SparkSession) -> DataFrame:
    """The rail links; positions count within an airport."""
    rows, seen = [], {}
    for airport, routes, connector, link, ride, wait in RAIL_LINKS:
        pos = seen[airport] = seen.get(airport, -1) + 1
        rows.append((airport, pos, list(routes), connector, link, *(ride or (None, None)), *wait, *TRANSFER_RANGE))
    return spark.createDataFrame(rows, LINK_COLUMNS)


def leg_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, d, s, j, list(a), t) for r, d, s, j, a, t in SEGMENT_LEGS], LEG_COLUMNS)


def fare_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSIT_FARES.items()), "airport string, transit_fare double")


def evidence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LINK_EVIDENCE.items()), "airport string, transit_evidence string")


def car_report(spark: SparkSession, facts: str, source: str, zones: DataFrame, airports: list[int]) -> DataFrame:
    """Car cells of one feed from the stored facts; partition pruning reads that feed only."""
    time, fare = (read_fact(spark, facts, name).where(F.col("source") == source) for name in (TIME_FACT, FARE_FACT))
    if time.isEmpty():
        raise RuntimeError(f"no months of {source} are stored under {facts}")
    return car_cells(time, fare, zones, airports)


def segment_report(rows: DataFrame, legs: DataFrame) -> DataFrame:
    """Leg summary after the unit guard has passed for every dataset and leg."""
    wanted = leg_rows(rows, legs)
    enforce(segment_unit_report(wanted, ["dataset", "route_id"]))
    return leg_summary(wanted)


def require_inputs(links: DataFrame, documents: DataFrame, ranges: DataFrame) -> None:
    """Stops where a route of the link table has no document, or a link without ride times no bus leg.

    The link table is a constant of a few rows, so what is missing is named in full.
    """
    wanted = links.select(F.explode("routes").alias("route")).distinct()
    missing = [r.route for r in wanted.join(documents, "route", "left_anti").orderBy("route").collect()]
    if missing:
        raise RuntimeError(f"no document for route {', '.join(missing)}")
    if ranges.isEmpty():
        bare = [r.link for r in links.where(F.col("ride_low").isNull()).select("link").distinct().orderBy("link").collect()]
        if bare:
            raise RuntimeError(f"no bus leg gives the ride times of {', '.join(bare)}")


def transit_journeys(directions: DataFrame, links: DataFrame, ranges: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Best journey per airport and station, one row each with its blocks."""
    cells = with_link_ride(ride_cells(directions, links, floor), ranges)
    return best_journeys(journeys(door_to_door(cells)))


def fare_audit(trips: DataFrame, airport: int, zones: list[int], hours: tuple[int, int] = (16, 18)) -> DataFrame:
    """Medians of each ride-hail fare component per zone; a sum with an absent part is absent."""
    chosen = trips.where(
        (F.col(RIDE_HAIL.column("destination")) == airport)
        & F.col(RIDE_HAIL.column("origin")).isin(*zones)
        & F.hour(RIDE_HAIL.column("pickup")).between(*hours)
        & is_working_day(F.col(RIDE_HAIL.column("pickup")))
    )
    base, tolls, bcf, tax, congestion, fee, cbd = (F.col(r.column) for r in RIDE_HAIL.fare_roles)
    parts = {
        "base": base, "tolls": tolls, "taxes": bcf + tax + congestion, "airport": fee, "cbd": cbd,
        "base_plus_tolls": base + tolls, "total": base + tolls + bcf + tax + congestion + fee + cbd,
    }
    medians = component_medians(chosen.withColumn("zone", F.col(RIDE_HAIL.column("origin"))), ["zone"], parts, 1.0)
    return medians.orderBy("zone")


def map_shapes(zones: DataFrame, off_frame: tuple[int, ...] = OFF_FRAME_ZONES) -> tuple[DataFrame, DataFrame]:
    """Zone outlines and the view box around them."""
    parts = staged(projected_parts(zones, list(off_frame)), "parts")
    return zone_outlines(parts), frame_box(parts)


def station_mapping(stations: DataFrame, zones: DataFrame, cell: float, band: float) -> DataFrame:
    """``zone, station, pos`` for every station inside a zone; an error when none is."""
    placed = staged(locate(stations.select(F.col("pos").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y")), zones, cell, band), "placed")
    if placed.isEmpty():
        raise RuntimeError("no station lies in any zone; are the coordinates in the right order?")
    return stations.join(placed, stations["pos"] == placed["point"]).select("zone", F.col("name").alias("station"), "pos")


def measured_ranges(rows: DataFrame, route_id: str) -> DataFrame:
    """Ride range per block of the leg whose buses carry the link."""
    return ride_ranges(leg_blocks(rows.where(F.col("route_id") == route_id))).drop("route_id")


def named_airports(cells: DataFrame, names: dict[int, str] = AIRPORT_NAMES) -> DataFrame:
    """Car cells with the airport's name in place of its zone id, as the transit side has it."""
    labels = F.coalesce(*[F.when(F.col("airport") == zone, F.lit(name)) for zone, name in names.items()])
    return cells.withColumn("airport", labels)


def comparison_report(
    cells: DataFrame, journeys: DataFrame, station_zone: DataFrame, zones: DataFrame, fares: DataFrame, evidence: DataFrame
) -> DataFrame:
    return compare_modes(cells, best_station(station_zone, journeys), zones, fares, evidence)

