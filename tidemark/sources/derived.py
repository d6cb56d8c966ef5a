"""Feeds and dimensions derived from the provided star-schema tables.

Definitions are in FIXTURES.md. Each one scans a table that grows with the scale
factor and leaves filtering, pruning and pre-aggregation to its readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import TOP_MINUTE, TRANSFER_RANGE
from tidemark.functions.timeblocks import block_of, block_position
from tidemark.operators.histograms import count_bins, summarise
from tidemark.session import fresh_dir
from tidemark.sources.trips import conform, feed

FEED = feed(
    "lineitem",
    """
    company      company
    pickup       pickup
    dropoff      dropoff
    origin       origin
    destination  airport
    seconds      trip_time
    fare!        base_cents
    fare         tolls_cents
    refund       tip_cents
    """,
    units=100,
)

#: The same trips from a provider that records neither company nor duration, and one fare.
PLAIN_FEED = feed(
    "derived_duration",
    """
    pickup       pickup
    dropoff      dropoff
    origin       origin
    destination  airport
    fare!        base_cents
    """,
    units=100,
)
AIRPORTS = [0, 1, 2]
TOP = 90
STATIONS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` dressed as a provider's trip file."""
    offset = "cast((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 3571) % 86400 as int)"
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 4 as int) as airport",
        "cast(l_partkey % 40 as int) as origin",
        "l_returnflag as company",
        f"timestampadd(SECOND, {offset}, l_shipdate) as pickup",
        "cast(l_quantity as bigint) * 120 + l_partkey % 600 as trip_time",
        "cast(l_orderkey % 41 - 20 as int) as noise",
        "cast(round(l_extendedprice * 100) as bigint) div 1000 as base_cents",
        "case when l_linenumber <> 7 then (l_partkey % 7) * 100 end as tolls_cents",
        "(l_suppkey % 100) * 9 as tip_cents",
        "cast(l_quantity as bigint) * 40 + l_orderkey % 173 as miles_hundredths",
        "cast(l_suppkey % 2 as int) as leg",
        "date_format(l_shipdate, 'yyyy-MM') as year_month",
    )
    return lines.withColumn(
        "dropoff", F.expr("timestampadd(SECOND, cast(trip_time as int) + noise, pickup)")
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(raw_trips(spark, sf_dir), FEED, F.col("year_month"))


RIDE_KEYS = ["route", "station", "block"]


def ride_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` dressed as rides from a station, counted per whole minute."""
    rides = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("route"),
        (F.col("user_id") % STATIONS).cast("int").alias("station"),
        block_of(F.col("ts")).alias("block"),
        F.least(F.floor("value").cast("int"), F.lit(TOP_MINUTE)).alias("minutes"),
    )
    return count_bins(rides, RIDE_KEYS, "minutes")


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(ride_histogram(spark, sf_dir), RIDE_KEYS, "minutes", {"p50": 0.5, "p90": 0.9})


def with_wait(rides: DataFrame) -> DataFrame:
    """A median wait per route, station and block, in quarter minutes."""
    steps = (F.col("station") * 7 + F.length("route") * 3 + block_position(F.col("block"))) % 13
    return rides.withColumn("median_wait", (steps + 1) / F.lit(4.0))


LINK_SCHEMA = (
    "airport int, link_pos int, routes array<string>, connector string, link string, "
    "ride_low int, ride_high int, wait_low int, wait_high int, transfer_low int, transfer_high int"
)


def links(spark: SparkSession) -> DataFrame:
    low, high = TRANSFER_RANGE
    rows = [
        (0, 0, ["click"], "S8", "rail", 10, 15, 0, 10, low, high),
        (0, 1, ["view", "purchase"], "S11", "rail", 8, 12, 0, 10, low, high),
        (1, 0, ["error"], "S5", "bus", None, None, 0, 12, low, high),
        (1, 1, ["signup"], "S11", "bus", None, None, 0, 12, low, high),
    ]
    return spark.createDataFrame(rows, LINK_SCHEMA)


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per route, nested as published: directions -> stations, pairs, waits.

    Three directions list the same stations: forwards, backwards and every fifth.
    A document holds one route's stations and blocks and nothing that grows with rows.
    """
    station, idx, last = F.col("station"), F.col("_at.idx"), STATIONS - 1
    ride = F.struct(F.col("n"), (F.col("p50") + F.col("_at.dir")).alias("p50"), (F.col("p90") + F.col("_at.dir")).alias("p90"))
    stops = (
        with_wait(rides(spark, sf_dir))
        .withColumn(
            "_at",
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("dir"), station.alias("idx")),
                    F.struct(F.lit(1).alias("dir"), (F.lit(last) - station).alias("idx")),
                    F.struct(F.lit(2).alias("dir"), ((station * 5) % STATIONS).cast("int").alias("idx")),
                )
            ),
        )
        .groupBy("route", F.col("_at.dir").alias("dir"), idx.alias("idx"))
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("block"), ride.alias("value")))).alias("ride"),
            F.array_sort(F.collect_list(F.struct(F.col("block"), F.col("median_wait").alias("value")))).alias("wait"),
        )
        .groupBy("route", "dir")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "ride", "wait"))).alias("stops"))
        .groupBy("route")
        .agg(F.array_sort(F.collect_list(F.struct("dir", "stops"))).alias("dirs"))
    )

    def station_at(direction, i):
        number = F.when(direction.dir == 0, i).when(direction.dir == 1, F.lit(last) - i).otherwise((i * 5) % STATIONS)
        name = F.concat(F.lit("S"), number.cast("string"))
        return F.struct(name.alias("id"), name.alias("name"), i.cast("double").alias("km"))

    def pairs_of(direction):
        origins = F.filter(direction.stops, lambda s: s.idx < last)
        per_origin = F.transform(
            origins,
            lambda s: F.transform(
                F.sequence(s.idx + 1, F.lit(last)),
                lambda t: F.struct(F.concat_ws("-", s.idx, t).alias("k"), F.map_from_entries(s.ride).alias("v")),
            ),
        )
        return F.map_from_entries(F.flatten(per_origin))

    def direction_entry(direction):
        body = F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: station_at(direction, i)).alias("stations"),
            pairs_of(direction).alias("pairs"),
            F.map_from_entries(
                F.transform(
                    direction.stops,
                    lambda s: F.struct(s.idx.cast("string").alias("k"), F.map_from_entries(s.wait).alias("v")),
                )
            ).alias("waits"),
        )
        return F.struct(F.concat(F.lit("d"), direction.dir.cast("string")).alias("k"), body.alias("v"))

    directions = F.map_from_entries(F.transform("dirs", direction_entry))
    return stops.select("route", F.to_json(F.struct(directions.alias("directions"))).alias("document"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension: zone, name, borough."""
    ids = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("int").alias("zone")).distinct()
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    borough = F.when(F.col("zone") == 3, "Unknown").when(F.col("zone") == 17, "N/A").otherwise(F.col("r_name"))
    return ids.join(regions, F.col("zone") % 5 == F.col("r_regionkey"), "left").select(
        "zone", F.concat(F.lit("ZONE_"), F.col("zone").cast("string")).alias("name"), borough.alias("borough")
    )


def zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone dimension as delimited text, with blanks, padding and unusable ids."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    key = F.col("p_partkey")
    line = F.concat_ws(
        ",",
        F.when(key % 11 == 5, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")),
        F.when(key % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" Borough "), (key % 5).cast("string"))),
        F.when(key % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("Zone "), key.cast("string"), F.lit(" "))),
        F.lit("Boro"),
    )
    return part.select(line.alias("line"))


def station_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone to station names, with the position that settles ties."""
    return (
        table(spark, sf_dir, "part")
        .select(
            (F.col("p_partkey") % 40).cast("int").alias("zone"),
            F.concat(F.lit("S"), ((F.col("p_partkey") * 7) % STATIONS).cast("string")).alias("station"),
            "p_partkey",
        )
        .groupBy("zone", "station")
        .agg(F.min("p_partkey").alias("pos"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` averaged per leg, month, weekday and hour, as JSON rows with text numbers."""
    day = F.element_at(
        F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]),
        F.weekday("pickup") + 1,
    )
    cells = (
        raw_trips(spark, sf_dir)
        .groupBy(
            "leg",
            F.trunc("pickup", "MM").alias("month_start"),
            day.alias("day_of_week"),
            F.hour("pickup").alias("hour_of_day"),
        )
        .agg(F.sum("trip_time").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_minutes", F.col("_sum").cast("double") / F.col("_n").cast("double") / F.lit(60.0))
        .withColumn("_distance", (F.col("leg") + 4).cast("double"))
    )
    text = F.to_json(
        F.struct(
            F.concat(F.lit("L"), F.col("leg").cast("string")).alias("route_id"),
            F.lit("N").alias("direction"),
            (F.col("leg") + 2).cast("string").alias("stop_order"),
            F.concat(F.col("month_start").cast("string"), F.lit("T00:00:00.000")).alias("timestamp"),
            "day_of_week",
            F.col("hour_of_day").cast("string").alias("hour_of_day"),
            F.when(F.col("_n") % 17 == 16, F.lit("n/a")).otherwise(F.col("_distance").cast("string")).alias("road_distance"),
            F.col("_minutes").cast("string").alias("average_travel_time"),
            (F.col("_distance") / F.col("_minutes") * F.lit(60.0)).cast("string").alias("average_road_speed"),
            F.col("_n").cast("string").alias("bus_trip_count"),
        )
    )
    vintage = F.when(F.col("month_start") < F.lit("1998-06-01").cast("date"), "v1").otherwise("v2")
    return cells.select(vintage.alias("dataset"), text.alias("row"))


LEG_SCHEMA = (
    "route_id string, direction string, stop_order int, junction string, junction_aliases array<string>, terminal string"
)


def legs(spark: SparkSession) -> DataFrame:
    rows = [
        ("L0", "N", 2, "S5", ["S5", "S11"], "Terminal A"),
        ("L1", "N", 3, "S11", ["S11"], "Terminal B"),
    ]
    return spark.createDataFrame(rows, LEG_SCHEMA)


GRID_COLUMNS = 400


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a grid of 20-unit zones: one row per zone, parts -> rings -> points.

    Sides bend inwards by (k % 5) * 0.00015; every third zone has a hole; every
    fourth has a half-unit second part that lies inside another zone.
    """
    key = F.col("c_custkey")
    x0 = ((key % GRID_COLUMNS) * 20).cast("double")
    y0 = (F.floor(key / GRID_COLUMNS) * 20).cast("double")
    bend = (key % 5).cast("double") * F.lit(0.00015)

    def ring(corners):
        return F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in corners])

    n = F.lit
    outline = ring(
        [
            (n(0.0), n(0.0)), (n(10.0), bend), (n(20.0), n(0.0)), (n(20.0) - bend, n(10.0)),
            (n(20.0), n(20.0)), (n(10.0), n(20.0) - bend), (n(0.0), n(20.0)), (bend, n(10.0)),
        ]
    )
    hole = ring([(n(5.0), n(5.0)), (n(5.0), n(15.0)), (n(15.0), n(15.0)), (n(15.0), n(5.0))])
    islet = ring([(n(205.0), n(9.0)), (n(205.5), n(9.0)), (n(205.5), n(9.5)), (n(205.0), n(9.5))])
    main = F.when(key % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline))
    # A zone is small as a record and large as a shape: a file of one split is spread over the tasks first.
    spread = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition("c_custkey")
    return spread.select(
        key.alias("pos"),
        key.alias("zone"),
        F.col("c_name").alias("name"),
        F.when(key % 4 == 0, F.array(main, F.array(islet))).otherwise(F.array(main)).alias("parts"),
    )


def geojson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones as GeoJSON text; some have no geometry, an empty one or a kind that is not an area."""
    key = F.col("zone")

    def pairs(ring):
        return F.transform(ring, lambda p: F.array(p.x, p.y))

    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(F.col("parts")[0], pairs).alias("coordinates")))
    several = F.to_json(
        F.struct(
            F.lit("MultiPolygon").alias("type"),
            F.transform("parts", lambda part: F.transform(part, pairs)).alias("coordinates"),
        )
    )
    geometry = (
        F.when(key % 50 == 7, F.lit(None))
        .when(key % 50 == 9, F.lit('{"type":"MultiPolygon","coordinates":[]}'))
        .when(key % 50 == 11, F.lit('{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}'))
        .when(F.size("parts") == 1, single)
        .otherwise(several)
    )
    return polygons(spark, sf_dir).select("pos", key.cast("string").alias("locationid"), "name", geometry.alias("the_geom"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as points in and around the zone of their customer, never on an edge."""
    home, key = F.col("o_custkey"), F.col("o_orderkey")
    x = (home % GRID_COLUMNS) * 20 + (key * 37 % 241).cast("double") / F.lit(10.0) + F.lit(-1.97)
    y = F.floor(home / GRID_COLUMNS) * 20 + (key * 91 % 239).cast("double") / F.lit(10.0) + F.lit(-1.93)
    return table(spark, sf_dir, "orders").select(key.alias("point"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as station JSON rows, some malformed."""
    key = F.col("s_suppkey")
    text = F.to_json(
        F.struct(
            F.when(key % 13 != 6, F.concat(F.lit("G"), key.cast("string"))).alias("gtfs_stop_id"),
            F.col("s_name").alias("stop_name"),
            F.when(key % 3 > 0, F.concat(F.lit("B"), (key % 5).cast("string"))).alias("borough"),
            F.when(key % 4 > 0, F.concat(F.lit(" A  "), (key % 7).cast("string"), F.lit(" "))).alias("daytime_routes"),
            F.when(key % 17 == 8, F.lit("east")).otherwise(((key % 360) / F.lit(8.0)).cast("string")).alias("gtfs_longitude"),
            F.when(key % 19 != 9, ((key % 180) / F.lit(4.0)).cast("string")).alias("gtfs_latitude"),
        )
    )
    return table(spark, sf_dir, "supplier").select(key.alias("pos"), text.alias("row"))


def daily_event_files(spark: SparkSession, sf_dir: str):
    """``events`` as a stream of files in several batches; each file holds some days, early and late ones mixed."""
    events, folder = table(spark, sf_dir, "events"), fresh_dir(spark, "events")
    events.repartition(6, F.to_date("ts")).write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)


LATE_PERIOD_DAYS, LATE_BY_PERIODS = 6, 4


def arriving_events(spark: SparkSession, sf_dir: str):
    """``events`` as a stream that is a batch per six days: some rows come a batch late, and a seventh four batches late.

    Files carry the time they arrive as their time of change, so they are read in that order.
    """
    events, folder = table(spark, sf_dir, "events"), fresh_dir(spark, "arrivals")
    late = F.when(F.col("user_id") % 7 == 0, LATE_BY_PERIODS).when(F.col("user_id") % 7 == 1, 1).otherwise(0)
    arrival = F.floor(F.unix_date(F.to_date("ts")) / LATE_PERIOD_DAYS) + late
    events.withColumn("arrival", arrival).repartition("arrival").write.partitionBy("arrival").parquet(folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{folder}/arrival=*/part-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or []:
        number = int(found.getPath().getParent().getName().rpartition("=")[2])
        files.setTimes(found.getPath(), number * 1000, -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrival=*")
