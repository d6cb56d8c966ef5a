"""JSON documents at the edge. One document per airport and zone, so a report is
written by all tasks and no document grows with anything but the parts of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import CAR_EVIDENCE, SAMPLE_FLOOR

#: What the modelled part of a journey assumes.
WAIT_ASSUMPTION = "waits are uniform over the headway"

CAR_FIELDS = ["n", "mean", "p50", "p90", "p95", "fare", "fare_p90"]


def _keyed(key: str, fields: list[str]):
    entry = F.struct(F.col(key), F.struct(*fields).alias("value"))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def car_documents(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """``airport, zone, document``: name, borough and a map from part of the day to its cell."""
    maps = cells.groupBy("airport", F.col("origin").alias("zone")).agg(_keyed("grain", CAR_FIELDS).alias("cells"))
    named = maps.join(zones, "zone", "left")
    return named.select("airport", "zone", F.to_json(F.struct("airport", "zone", "name", "borough", "cells")).alias("document"))


def comparison_documents(comparison: DataFrame) -> DataFrame:
    """``airport, zone, document``: both modes, verdict and lead time per block, and the station used."""
    car = F.when(
        F.col("car_p90").isNotNull(),
        F.struct(F.col("car_p50").alias("p50"), F.col("car_p90").alias("p90"), F.col("car_n").alias("n"), F.col("car_fare").alias("fare")),
    )
    transit = F.when(
        F.col("transit_p90").isNotNull(),
        F.struct(F.col("transit_p50").alias("p50"), F.col("transit_p90").alias("p90"), F.col("transit_fare").alias("fare")),
    )
    via = F.when(F.col("station").isNotNull(), F.struct("station", "route", "link", "connector"))
    rows = comparison.select(
        "airport", "zone", "name", "borough", "block", "lead_minutes", "verdict",
        car.alias("car"), transit.alias("transit"), via.alias("via"), "transit_evidence",
    )
    maps = rows.groupBy("airport", "zone", "name", "borough", "via", "transit_evidence").agg(
        _keyed("block", ["car", "transit", "lead_minutes", "verdict"]).alias("blocks"),
        F.max(F.when(F.col("car").isNotNull(), F.lit(CAR_EVIDENCE))).alias("car_evidence"),
    )
    body = F.struct("airport", "zone", "name", "borough", "blocks", "via", "transit_evidence", "car_evidence")
    return maps.select("airport", "zone", F.to_json(body).alias("document"))


def corpus_document(time_fact: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """``source, document``: what a car report rests on."""
    totals = time_fact.groupBy("source").agg(
        F.sum("n").alias("weekday_trips"), F.array_sort(F.collect_set("year_month")).alias("months")
    )
    body = F.struct("source", "months", "weekday_trips", F.lit(floor).alias("sample_floor"), F.lit(CAR_EVIDENCE).alias("evidence"))
    return totals.select("source", F.to_json(body).alias("document"))


def journey_documents(journeys: DataFrame, fares: DataFrame) -> DataFrame:
    """``airport, station, document``: the best journey of a station with its fare and evidence."""
    body = F.struct(*journeys.columns, "transit_fare", F.lit(WAIT_ASSUMPTION).alias("assumption"))
    return journeys.join(fares, "airport", "left").select("airport", "station", F.to_json(body).alias("document"))


def cohort_documents(medians: DataFrame, group: str = "source") -> DataFrame:
    """``source, document``: the pooled median of a feed and a map from month to its own."""
    fields = ["median", "trips", "months", "month_list", "span", "change"]
    return medians.groupBy(group).agg(_keyed("month", fields).alias("months")).select(
        group, F.to_json(F.struct(group, "months")).alias("document")
    )


def leg_documents(summary: DataFrame, legs: DataFrame) -> DataFrame:
    """``route_id, document``: a bus leg with its blocks."""
    fields = ["cells", "buses_per_cell", "typical", "low", "high", "worst_cell"]
    maps = summary.groupBy("route_id", "months", "buses_observed").agg(_keyed("block", fields).alias("blocks"))
    body = F.struct("route_id", "junction", "junction_aliases", "terminal", "buses_observed", "months", "blocks")
    return maps.join(legs, "route_id").select("route_id", F.to_json(body).alias("document"))


STORED = "airport int, zone int, document string"
_CAR = "name string, borough string, cells map<string, struct<n: bigint, mean: double, p50: int, p90: int, p95: int, fare: int, fare_p90: int>>"
_MODE = "struct<p50: int, p90: int, n: bigint, fare: double>"
_COMPARISON = (
    "name string, borough string, transit_evidence string, "
    "via struct<station: string, route: string, link: string, connector: string>, "
    f"blocks map<string, struct<car: {_MODE}, transit: {_MODE}, lead_minutes: int, verdict: string>>"
)
_LEG = (
    "junction string, junction_aliases array<string>, terminal string, buses_observed bigint, months bigint, "
    "blocks map<string, struct<cells: bigint, buses_per_cell: double, typical: double, low: double, high: double, worst_cell: double>>"
)


_CORPUS = "source string, months array<string>, weekday_trips bigint, sample_floor int, evidence string"
_JOURNEY = (
    "route string, connector string, link string, typical double, transit_fare double, assumption string, "
    "blocks array<struct<block: string, n: bigint, ride_p50: int, ride_p90: int, overhead_p50: int, overhead_p90: int, door_p50: int, door_p90: int>>"
)
_COHORT = "months map<string, struct<median: int, trips: bigint, months: bigint, month_list: string, span: string, change: double>>"


def read_corpus_documents(documents: DataFrame) -> DataFrame:
    """Stored corpus documents as one row per source and month."""
    parsed = documents.select(F.from_json("document", _CORPUS).alias("_d")).select("_d.*")
    return parsed.select("source", "weekday_trips", "sample_floor", "evidence", F.explode("months").alias("year_month"))


def read_journey_documents(documents: DataFrame) -> DataFrame:
    """Stored journey documents as one row per part of the day."""
    parsed = documents.select("airport", "station", F.from_json("document", _JOURNEY).alias("_d"))
    return parsed.select("airport", "station", "_d.*").select("*", F.inline("blocks")).drop("blocks")


def read_cohort_documents(documents: DataFrame, group: str = "source") -> DataFrame:
    """Stored cohort documents as one row per month, and one for all."""
    parsed = documents.select(group, F.from_json("document", _COHORT).alias("_d"))
    return parsed.select(group, F.explode("_d.months").alias("month", "_m")).select(group, "month", "_m.*")


def read_car_documents(documents: DataFrame) -> DataFrame:
    """Stored car documents as one row per cell."""
    parsed = documents.select("airport", "zone", F.from_json("document", _CAR).alias("_d"))
    return parsed.select("airport", "zone", "_d.name", "_d.borough", F.explode("_d.cells").alias("grain", "_cell")).select(
        "airport", "zone", "name", "borough", "grain", "_cell.*"
    )


def read_comparison_documents(documents: DataFrame) -> DataFrame:
    """Stored comparison documents as one row per block."""
    parsed = documents.select("airport", "zone", F.from_json("document", _COMPARISON).alias("_d"))
    return parsed.select("airport", "zone", "_d.name", "_d.borough", "_d.via.station", F.explode("_d.blocks").alias("block", "_b")).select(
        "airport", "zone", "name", "borough", "station", "block",
        F.col("_b.car.p90").alias("car_p90"),
        F.col("_b.transit.p90").alias("transit_p90"),
        "_b.lead_minutes", "_b.verdict",
    )


def read_leg_documents(documents: DataFrame) -> DataFrame:
    """Stored leg documents as one row per block."""
    parsed = documents.select("route_id", F.from_json("document", _LEG).alias("_d"))
    return parsed.select(
        "route_id", "_d.junction", "_d.terminal", "_d.buses_observed", "_d.months", F.explode("_d.blocks").alias("block", "_b")
    ).select("route_id", "junction", "terminal", "buses_observed", "months", "block", "_b.*")


def station_documents(station_zone: DataFrame) -> DataFrame:
    """``zone, document``: the zone's station names in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "station")))
    names = F.transform(ordered, lambda s: s["station"])
    return station_zone.groupBy("zone").agg(F.to_json(names).alias("document"))


def read_station_documents(documents: DataFrame) -> DataFrame:
    """``zone, pos, station`` from stored documents."""
    names = F.from_json("document", "array<string>")
    return documents.select("zone", F.posexplode(names).alias("pos", "station"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
