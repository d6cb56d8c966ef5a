"""Text sources: delimited zone rows, JSON rows, nested route documents and GeoJSON.

Every reader takes a DataFrame with one record per row, however it was read, and
returns typed rows. Records that do not parse are left out, as each source asks; the
``*_faults`` name why, and ``quarantine`` keeps such records apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import clean_text, month_key
from tidemark.sources.quarantine import judged, usable

POINT = "struct<x:double,y:double>"
ROUTE_SCHEMA = (
    "directions map<string, struct<"
    "stations: array<struct<id: string, name: string, km: double>>, "
    "pairs: map<string, map<string, struct<n: bigint, p50: int, p90: int>>>, "
    "waits: map<string, map<string, double>>>>"
)
SEGMENT_SCHEMA = (
    "route_id string, direction string, stop_order string, timestamp string, day_of_week string, "
    "hour_of_day string, road_distance string, average_travel_time string, average_road_speed string, "
    "bus_trip_count string"
)
STATION_SCHEMA = (
    "gtfs_stop_id string, stop_name string, borough string, daytime_routes string, "
    "gtfs_longitude string, gtfs_latitude string"
)
ZONE_LINE_SCHEMA = "LocationID string, Borough string, Zone string, service_zone string"


def split_zones(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of delimited zone rows, as text."""
    return lines.select(F.from_csv(F.col(line), F.lit(ZONE_LINE_SCHEMA)).alias("_row")).select("_row.*")


def zone_faults() -> dict[str, Column]:
    return {"zone id is no whole number": F.trim("LocationID").try_cast("int").isNull()}


def zone_dimension(lines: DataFrame, line: str = "line") -> DataFrame:
    """``zone, name, borough`` from delimited rows; rows without a whole-number id are left out."""
    return typed_zones(split_zones(lines, line))


def typed_zones(rows: DataFrame) -> DataFrame:
    """The same from rows a CSV reader already split (``LocationID, Borough, Zone``).

    Of rows with the same id the last one counts, by ``pos`` where the rows have it.
    """
    number = F.trim("LocationID").try_cast("int")
    unnamed = F.concat(F.lit("Unknown zone "), number.cast("string"))
    typed = usable(judged(rows, zone_faults())).select(
        number.alias("zone"),
        F.struct(
            (F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id()).alias("pos"),
            clean_text(F.col("Zone"), unnamed).alias("name"),
            clean_text(F.col("Borough"), F.lit("Unknown")).alias("borough"),
        ).alias("_row"),
    )
    return typed.groupBy("zone").agg(F.max("_row").alias("_last")).select("zone", "_last.name", "_last.borough")


def parsed_segments(rows: DataFrame, text: str = "row") -> DataFrame:
    """The fields of segment rows in JSON, as text."""
    return rows.select("dataset", F.from_json(F.col(text), SEGMENT_SCHEMA).alias("_row")).select("dataset", "_row.*")


def segment_faults() -> dict[str, Column]:
    return {"no travel time": F.col("average_travel_time").isNull()}


def clock_faults() -> dict[str, Column]:
    """Hours no clock shows, which a part of the day cannot be found for."""
    hour = F.col("hour_of_day").try_cast("int")
    return {"hour is no number": hour.isNull(), "hour beyond the clock": ~hour.between(0, 23)}


def segment_rows(rows: DataFrame, text: str = "row") -> DataFrame:
    """Typed segment rows from JSON text."""
    return typed_segments(parsed_segments(rows, text))


def typed_segments(rows: DataFrame) -> DataFrame:
    """Numbers out of text; rows without a travel time are left out.

    A travel time or a number of buses that is there but does not parse is NULL and
    fails the guard; a number of buses that is absent is 0.
    """
    return usable(judged(rows, segment_faults())).select(
        "dataset", "route_id", "direction",
        F.col("stop_order").try_cast("int").alias("stop_order"),
        month_key(F.col("timestamp")).alias("year_month"),
        "day_of_week",
        F.col("hour_of_day").try_cast("int").alias("hour_of_day"),
        F.col("road_distance").try_cast("double").alias("road_distance"),
        F.col("average_travel_time").try_cast("double").alias("average_travel_time"),
        F.col("average_road_speed").try_cast("double").alias("average_road_speed"),
        F.coalesce(F.nullif(F.trim("bus_trip_count"), F.lit("")), F.lit("0")).try_cast("int").alias("bus_trip_count"),
    )


def route_directions(documents: DataFrame, text: str = "document") -> DataFrame:
    """One row per route and direction, in document order: station names, pairs and waits."""
    parsed = documents.select("route", F.from_json(F.col(text), ROUTE_SCHEMA).alias("_doc"))
    return parsed.select("route", F.posexplode(F.map_entries("_doc.directions")).alias("dir_pos", "_dir")).select(
        "route",
        "dir_pos",
        F.col("_dir.key").alias("direction"),
        F.col("_dir.value.stations.name").alias("names"),
        F.col("_dir.value.pairs").alias("pairs"),
        F.col("_dir.value.waits").alias("waits"),
    )


def _ring(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def shape_faults(geometry: str = "the_geom") -> dict[str, Column]:
    coordinates = F.get_json_object(geometry, "$.coordinates")
    return {
        "no geometry": F.col(geometry).isNull(),
        "geometry without coordinates": ~F.coalesce(F.regexp_like(coordinates, F.lit("[0-9]")), F.lit(False)),
    }


def zone_shapes(rows: DataFrame, geometry: str = "the_geom") -> DataFrame:
    """GeoJSON text to ``pos, zone, name, kind, parts`` (parts -> rings -> points).

    Rows without geometry or without a single coordinate are left out. Kinds other
    than Polygon and MultiPolygon keep their row with no parts, so nothing is inside them.
    """
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    single = F.from_json(coordinates, "array<array<array<double>>>")
    several = F.from_json(coordinates, "array<array<array<array<double>>>>")
    parts = (
        F.when(kind == "Polygon", F.array(F.transform(single, _ring)))
        .when(kind == "MultiPolygon", F.transform(several, lambda part: F.transform(part, _ring)))
        .otherwise(F.array().cast(f"array<array<array<{POINT}>>>"))
    )
    return usable(judged(rows, shape_faults(geometry))).select(
        "pos", F.col("locationid").cast("bigint").alias("zone"), "name", kind.alias("kind"), parts.alias("parts"),
        *(["borough"] if "borough" in rows.columns else []),
    )


def parsed_stations(rows: DataFrame, text: str = "row") -> DataFrame:
    """The fields of station rows in JSON, as text."""
    return rows.select("pos", F.from_json(F.col(text), STATION_SCHEMA).alias("_row")).select("pos", "_row.*")


def station_faults() -> dict[str, Column]:
    return {
        "no id": F.col("gtfs_stop_id").isNull(),
        "no name": F.col("stop_name").isNull(),
        "longitude is no number": F.col("gtfs_longitude").try_cast("double").isNull(),
        "latitude is no number": F.col("gtfs_latitude").try_cast("double").isNull(),
    }


def stations(rows: DataFrame, text: str = "row") -> DataFrame:
    """Typed stations from JSON text."""
    return typed_stations(parsed_stations(rows, text))


def typed_stations(rows: DataFrame) -> DataFrame:
    """Stations; rows lacking an id, a name or a readable position are left out."""
    routes = F.trim(F.coalesce(F.col("daytime_routes"), F.lit("")))
    return usable(judged(rows, station_faults())).select(
        "pos",
        F.col("gtfs_stop_id").alias("stop_id"),
        F.col("stop_name").alias("name"),
        F.coalesce(F.col("borough"), F.lit("")).alias("borough"),
        F.when(routes == "", F.array().cast("array<string>")).otherwise(F.split(routes, "\\s+")).alias("routes"),
        F.col("gtfs_longitude").try_cast("double").alias("lon"),
        F.col("gtfs_latitude").try_cast("double").alias("lat"),
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same DataFrame, once it is known not to be empty."""
    if df.isEmpty():
        raise RuntimeError(f"no {what} could be read")
    return df
