"""Every operator as a named query over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import CAR_EVIDENCE, LICENCE_NAMES, TOP_MINUTE
from tidemark.functions.measures import month_key, round_even_0, round_even_1
from tidemark.functions.timeblocks import block_of, block_of_minute, block_table, is_working_day, minute_of_day, named_bounds, tiling_report
from tidemark.operators import cells as car
from tidemark.operators import cohort, compare, guards, histograms, journeys, mapview, segments, spatial, tripbins
from tidemark.operators.quantiles import LOWER, exact_quantiles
from tidemark.plans import reports as plans
from tidemark.session import fresh_dir
from tidemark.sources import derived, documents, months, quarantine, reports
from tidemark.sources.derived import AIRPORTS, FEED, TOP
from tidemark.sources.trips import company_name, conform, usable_trips
from tidemark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared inputs -------------------------------------------------------------


def binned(spark: SparkSession, sf: str) -> DataFrame:
    return tripbins.with_bins(usable_trips(derived.trips(spark, sf), AIRPORTS), TOP)


def time_fact(spark: SparkSession, sf: str) -> DataFrame:
    return tripbins.time_histogram(binned(spark, sf))


def fare_fact(spark: SparkSession, sf: str) -> DataFrame:
    return tripbins.fare_histogram(binned(spark, sf))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Car cells of both facts from one scan of the trips."""
    facts = months.both_facts(binned(spark, sf)).withColumn("bin", F.coalesce("minutes", "dollars"))
    return car.fact_cells(facts, derived.zones(spark, sf), AIRPORTS)


def segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    return segments.leg_rows(documents.segment_rows(derived.segments(spark, sf)), derived.legs(spark))


def directions(spark: SparkSession, sf: str) -> DataFrame:
    return documents.route_directions(derived.route_documents(spark, sf))


def best_journeys(spark: SparkSession, sf: str) -> DataFrame:
    ranges = plans.measured_ranges(segment_rows(spark, sf), "L0")
    return plans.transit_journeys(directions(spark, sf), derived.links(spark), ranges)


def transit_fares(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 11.75), (1, 3.0)], "airport int, transit_fare double")


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    evidence = spark.createDataFrame([(0, "rail"), (1, "rail and bus")], "airport int, transit_evidence string")
    return plans.comparison_report(
        cells(spark, sf), best_journeys(spark, sf), derived.station_zone(spark, sf), derived.zones(spark, sf), transit_fares(spark), evidence
    )


def scaled_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The zone grid in units that read as degrees (an exact power of two apart)."""
    shrink = F.lit(1024.0)
    parts = F.transform(
        "parts",
        lambda part: F.transform(
            part,
            lambda ring: F.transform(ring, lambda p: F.struct((p["x"] / shrink).alias("x"), (p["y"] / shrink).alias("y"))),
        ),
    )
    return derived.polygons(spark, sf).withColumn("parts", parts)


SCALED_TOLERANCE = 0.0002 / 1024


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    return mapview.projected_parts(scaled_zones(spark, sf), [1], SCALED_TOLERANCE)


# ---- trips to histograms -------------------------------------------------------


@query
def time_histogram(spark, sf):
    return time_fact(spark, sf)


@query
def fare_histogram(spark, sf):
    return fare_fact(spark, sf)


@query
def block_classify(spark, sf):
    events = derived.table(spark, sf, "events").select(block_of(F.col("ts")).alias("block"), is_working_day(F.col("ts")).alias("working_day"))
    return events.groupBy("block", "working_day").agg(F.count(F.lit(1)).alias("n"))


@query
def block_minutes_check(spark, sf):
    """Every pickup minute seen: the CASE and the block table must name the same block."""
    minutes = derived.raw_trips(spark, sf).groupBy(minute_of_day(F.col("pickup")).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    table = tiling_report(block_table(spark)).withColumn("minute", F.explode(F.sequence("start_min", F.col("end_min") - 1)))
    return minutes.join(table, "minute", "left").select(
        "minute", "n", block_of_minute(F.col("minute")).alias("block_case"), F.col("block").alias("block_table"), "next_block", "tiles"
    )


@query
def block_bounds(spark, sf):
    """Every part of the day that events fall in, looked up by its name, with the minutes seen in it."""
    minute = minute_of_day(F.col("ts"))
    seen = derived.table(spark, sf, "events").groupBy(block_of(F.col("ts")).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min(minute).alias("first_minute"), F.max(minute).alias("last_minute")
    )
    return seen.select("block", "n", "first_minute", "last_minute", named_bounds(F.col("block")).alias("_b")).select("block", "n", "first_minute", "last_minute", "_b.*")


@query
def trip_validity_counts(spark, sf):
    return tripbins.validity_counts(derived.trips(spark, sf), AIRPORTS)


@query
def company_labels(spark, sf):
    names = {"A": "Alpha", "N": "North", **LICENCE_NAMES}
    return time_fact(spark, sf).groupBy(company_name(F.col("company"), names).alias("company")).agg(F.sum("n").alias("trips"))


@query
def histogram_merge(spark, sf):
    rows = binned(spark, sf)
    odd = F.substring("year_month", 6, 2).cast("int") % 2 == 1
    keys = ["airport", "origin", "block"]
    halves = [histograms.count_bins(rows.where(part), keys, "minutes") for part in (odd, ~odd)]
    return histograms.merge(halves, keys, "minutes")


@query
def histogram_two_grain(spark, sf):
    return car.grains(time_fact(spark, sf), "minutes")


@query
def histogram_dense(spark, sf):
    merged = histograms.merge([time_fact(spark, sf)], ["airport", "company"], "minutes")
    return histograms.densify(merged, ["airport", "company"], "minutes", TOP)


@query
def histogram_from_samples(spark, sf):
    return histograms.from_samples(derived.table(spark, sf, "events"), ["event_type"], "value", TOP_MINUTE)


@query
def histogram_totals_means(spark, sf):
    found = histograms.summarise(time_fact(spark, sf), ["airport", "company"], "minutes", {"p0": 0.0, "p100": 1.0}, "mean")
    return found.withColumn("mean", F.round("mean", 6))


@query
def percentiles_long(spark, sf):
    merged = histograms.merge([time_fact(spark, sf)], ["airport", "origin", "block"], "minutes")
    found = histograms.summarise(merged, ["airport", "origin", "block"], "minutes", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return found.where("n >= 30")


@query
def percentiles_raw(spark, sf):
    """The same percentiles straight from trips, counted and packed into one short array per cell."""
    keys = ["airport", "origin", "block"]
    counted = histograms.count_bins(binned(spark, sf), keys, "minutes")
    return histograms.array_quantiles(counted, keys, "minutes", {"p50": 0.5, "p90": 0.9, "p95": 0.95}).where("n >= 30")


# ---- car cells -----------------------------------------------------------------


@query
def car_summary(spark, sf):
    return cells(spark, sf)


@query
def car_day_cells(spark, sf):
    """Flagship: median and 90th percentile minutes per destination and origin, whole day."""
    return cells(spark, sf).where("grain = 'day'").select("airport", "origin", "n", "p50", "p90")


@query
def car_thin_cells(spark, sf):
    return car.thin_cells(time_fact(spark, sf), derived.zones(spark, sf), AIRPORTS)


@query
def corpus_totals(spark, sf):
    fact = histograms.count_bins(binned(spark, sf), ["source", "year_month", "airport"], "minutes")
    return car.corpus_totals(fact)


@query
def published_zones(spark, sf):
    return car.published_zones(derived.zones(spark, sf), cells(spark, sf))


@query
def zone_dimension(spark, sf):
    zones = documents.zone_dimension(derived.zone_lines(spark, sf))
    kept = car.reportable_zones(zones, AIRPORTS).select("zone", F.lit(True).alias("reportable"))
    return zones.join(kept, "zone", "left").select("zone", "name", "borough", F.coalesce("reportable", F.lit(False)).alias("reportable"))


# ---- guards and schema drift ---------------------------------------------------


@query
def unit_ratio_guard(spark, sf):
    report = guards.unit_ratio_report(usable_trips(derived.trips(spark, sf), AIRPORTS), months.MONTH_KEYS)
    return report.withColumn("ratio", F.round("ratio", 9))


@query
def segment_unit_guard(spark, sf):
    rows = segment_rows(spark, sf)
    broken = rows.withColumn("average_travel_time", F.col("average_travel_time") * 60).withColumn("dataset", F.concat("dataset", F.lit("_seconds")))
    unread = rows.withColumn("average_travel_time", F.when(F.col("hour_of_day") != 9, F.col("average_travel_time")))
    unread = unread.withColumn("dataset", F.concat("dataset", F.lit("_unread")))
    return guards.segment_unit_report(segments.stack_vintages([rows, broken, unread]), ["dataset", "route_id"])


@query
def fare_components(spark, sf):
    rows = derived.raw_trips(spark, sf).where(
        (F.col("airport") == 0) & F.col("origin").isin(4, 5, 6) & F.hour("pickup").between(16, 18) & is_working_day(F.col("pickup"))
    )
    parts = {
        "base": F.col("base_cents"),
        "tolls": F.col("tolls_cents"),
        "tip": F.col("tip_cents"),
        "base_plus_tolls": F.col("base_cents") + F.col("tolls_cents"),
        "total": F.col("base_cents") + F.col("tolls_cents") - F.col("tip_cents"),
    }
    return cohort.component_medians(rows, ["origin"], parts, 100.0)


@query
def fare_drift_conform(spark, sf):
    """Even months come without the toll column; odd months spell it in capitals."""
    raw = derived.raw_trips(spark, sf)
    even = F.substring("year_month", 6, 2).cast("int") % 2 == 0
    without = raw.where(even).drop("tolls_cents")
    shouting = raw.where(~even).withColumnRenamed("tolls_cents", "TOLLS_CENTS")
    joined = conform(without, FEED, F.col("year_month")).unionByName(conform(shouting, FEED, F.col("year_month")), allowMissingColumns=True)
    return joined.groupBy("year_month", "missing_parts").agg(
        F.count(F.lit(1)).alias("trips"), F.sum(F.round(F.col("fare") * 100).cast("bigint")).alias("fare_cents")
    )


@query
def feed_union(spark, sf):
    """Two feeds with different columns, one with a recorded duration and one without."""
    raw = derived.raw_trips(spark, sf)
    both = conform(raw, FEED, F.col("year_month")).unionByName(conform(raw.drop("company"), derived.PLAIN_FEED, F.col("year_month")))
    good = usable_trips(both, AIRPORTS)
    return good.groupBy("source", "company").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("duration_s").alias("seconds"), F.sum("gap_s").alias("gap")
    )


# ---- months --------------------------------------------------------------------


@query
def month_coverage(spark, sf):
    seen = derived.trips(spark, sf).groupBy("year_month").agg(F.count(F.lit(1)).alias("trips"))
    wanted = months.spanned_months(seen, before=2, after=1)
    stored = seen.where(F.substring("year_month", 6, 2).cast("int") % 3 == 0)
    return months.coverage(wanted, stored, seen).join(seen, "year_month", "left")


@query
def month_union(spark, sf):
    """Months seen in either of two feeds, each over all its trips."""
    rows = binned(spark, sf)
    return cohort.month_union([rows.where(F.col("company") == "A"), rows.where(F.col("company") != "A")])


@query
def month_ingest(spark, sf):
    """Store the even months, then all; the second run adds only the odd ones."""
    out = fresh_dir(spark, "ingest")
    trips = derived.trips(spark, sf)
    wanted = months.spanned_months(trips)
    even = wanted.where(F.substring("year_month", 6, 2).cast("int") % 2 == 0)
    for some in (even, wanted):
        months.ingest(trips, some, AIRPORTS, out, top_minute=TOP)
    return months.stored_counts(spark, out)


# ---- legs and convolution ------------------------------------------------------


def _waits(spark, sf):
    waits = derived.with_wait(derived.rides(spark, sf))
    return waits.withColumn("headway", histograms.headway(F.col("median_wait"))).select("route", "station", "block", "headway")


@query
def wait_legs(spark, sf):
    keys = ["route", "station", "block"]
    return histograms.uniform_leg(_waits(spark, sf), keys, F.lit(0), F.col("headway"))


@query
def convolve_pair(spark, sf):
    """Measured ride times of every route, station and block, plus the wait for them."""
    keys = ["route", "station", "block"]
    rides = derived.ride_histogram(spark, sf).withColumnRenamed("minutes", "bin")
    return histograms.convolve_uniform(rides, _waits(spark, sf), keys, F.lit(0), F.col("headway")).withColumn("n", F.col("n").cast("bigint"))


@query
def convolve_four_legs(spark, sf):
    """Wait, transfer, link wait and link ride of every cell; links without a ride of their own take the measured one."""
    ranges = plans.measured_ranges(segment_rows(spark, sf), "L0")
    rides = journeys.with_link_ride(journeys.ride_cells(directions(spark, sf), derived.links(spark), 1), ranges)
    cells = rides.withColumn("headway", histograms.headway(F.col("median_wait")))
    return journeys.overheads(cells).withColumn("n", F.col("n").cast("bigint"))


@query
def shortcut_error(spark, sf):
    keys = ["route", "station", "block"]
    rides = derived.ride_histogram(spark, sf).withColumnRenamed("minutes", "bin")
    waits = histograms.uniform_leg(_waits(spark, sf), keys, F.lit(0), F.col("headway"))
    summed = histograms.convolve_uniform(rides, _waits(spark, sf), keys, F.lit(0), F.col("headway"))
    return histograms.shortcut_error(rides, waits, keys, summed=summed)


# ---- bus segments --------------------------------------------------------------


@query
def segment_scan(spark, sf):
    rows = segment_rows(spark, sf)
    return rows.groupBy("dataset", "route_id", "junction", "terminal", F.size("junction_aliases").alias("aliases"), "year_month", "day_of_week").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("bus_trip_count").alias("buses"), F.count("road_distance").alias("with_distance")
    )


@query
def segment_leg_summary(spark, sf):
    return segments.leg_summary(segment_rows(spark, sf))


@query
def floor_rank_quantile(spark, sf):
    return exact_quantiles(
        usable_trips(derived.trips(spark, sf), AIRPORTS).select("airport", "company", "duration_s"),
        ["airport", "company"], "duration_s", {"low": (0.1, LOWER), "high": (0.9, LOWER)}, F.floor(F.col("duration_s") / F.lit(60.0)),
    )


# ---- journeys and comparison ---------------------------------------------------


@query
def route_documents(spark, sf):
    """Rides before each connector read back out of the nested documents."""
    return journeys.ride_cells(directions(spark, sf), derived.links(spark)).select(
        "airport", "link_pos", "route_pos", "route", "dir_pos", "idx", "station", "connector", "block", "n", "ride_p50", "ride_p90", "median_wait"
    )


@query
def ride_range(spark, sf):
    return segments.ride_ranges(segments.leg_blocks(segment_rows(spark, sf)))


@query
def journeys_best(spark, sf):
    best = journeys.block_rows(best_journeys(spark, sf))
    return best.drop("link_pos", "route_pos").withColumn("typical", F.round("typical", 6))


@query
def mode_comparison(spark, sf):
    return comparison(spark, sf).withColumn("car_evidence", F.when(F.col("car_p90").isNotNull(), CAR_EVIDENCE))


@query
def verdict_tally(spark, sf):
    return compare.verdict_tally(comparison(spark, sf))


@query
def default_zone(spark, sf):
    return compare.default_zone(comparison(spark, sf))


@query
def coverage_counts(spark, sf):
    return compare.coverage_counts(comparison(spark, sf))


@query
def station_counts(spark, sf):
    return best_journeys(spark, sf).groupBy("airport").agg(F.count(F.lit(1)).alias("stations"))


@query
def quintile_shade(spark, sf):
    return mapview.shade(comparison(spark, sf), F.col("car_p90"))


@query
def buffer_shade(spark, sf):
    return mapview.shade(comparison(spark, sf), F.col("car_buffer"))


# ---- cohorts and profiles ------------------------------------------------------


@query
def cohort_medians(spark, sf):
    found = cohort.cohort_medians(cohort.cohort_trips(derived.trips(spark, sf), 0), "company")
    return found.withColumn("change", F.round("change", 6))


@query
def cohort_feeds(spark, sf):
    """Three feeds, each over its own window; the one without trips in its window is not there."""
    raw = derived.raw_trips(spark, sf)
    recorded, plain = (conform(raw, f, F.col("year_month")) for f in (FEED, derived.PLAIN_FEED))
    feeds = {
        "recorded": (recorded, "1994-01", "1995-06"),
        "plain": (plain, "1996-11", "1997-02"),
        "nobody": (recorded.withColumn("source", F.lit("nobody")), "2031-01", "2031-12"),
    }
    found = cohort.cohort_medians(cohort.cohort_trips(cohort.windowed_feeds(feeds), 0))
    return found.withColumn("change", F.round("change", 6))


@query
def company_profile(spark, sf):
    trips = derived.trips(spark, sf).where(F.col("airport") == 0)
    dollars = {"avg_fare": F.sum(F.round(F.col("fare") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)).cast("double") / 100.0}
    found = cohort.profile(trips, "company", {"time": F.col("duration_s")}, {"median": ("time", 0.5), "p90": ("time", 0.9)}, dollars)
    return found.select(
        "company", "trips", F.round(F.col("median") / 60.0, 4).alias("median_min"), F.round(F.col("p90") / 60.0, 4).alias("p90_min"),
        F.round("avg_fare", 4).alias("avg_fare"),
    )


@query
def hour_profile(spark, sf):
    trips = derived.raw_trips(spark, sf).where((F.col("airport") == 0) & is_working_day(F.col("pickup"))).withColumn("hour", F.hour("pickup"))
    values = {"time": F.col("trip_time"), "miles": F.col("miles_hundredths")}
    found = cohort.profile(trips, "hour", values, {"median": ("time", 0.5), "p90": ("time", 0.9), "miles": ("miles", 0.5)})
    return found.select(
        "hour", "trips", F.round(F.col("median") / 60.0, 4).alias("median_min"), F.round(F.col("p90") / 60.0, 4).alias("p90_min"),
        F.round(F.col("miles") / 100.0, 4).alias("median_miles"),
    )


@query
def rounding_rules(spark, sf):
    """Half-even rounding of event values and their twentieths, and the month key of their time."""
    events = derived.table(spark, sf, "events")
    value = F.floor(F.col("value") * 20) / F.lit(20.0)
    rows = events.select(month_key(F.col("ts")).alias("year_month"), round_even_1(value).alias("tenth"), round_even_0(value).alias("whole"))
    return rows.groupBy("year_month", "tenth", "whole").agg(F.count(F.lit(1)).alias("n"))


# ---- geometry ------------------------------------------------------------------


@query
def geojson_scan(spark, sf):
    shapes = documents.zone_shapes(derived.geojson_rows(spark, sf))
    return shapes.select(
        "zone", "name", "kind", F.size("parts").alias("parts"),
        F.aggregate("parts", F.lit(0), lambda t, part: t + F.aggregate(part, F.lit(0), lambda u, ring: u + F.size(ring))).alias("vertices"),
    )


@query
def station_scan(spark, sf):
    found = documents.stations(derived.station_rows(spark, sf))
    return found.select("stop_id", "name", "borough", F.array_join("routes", "|").alias("routes"), "lon", "lat")


def _judged(spark, sf) -> dict[str, DataFrame]:
    """Raw records of four sources with what is wrong with them; some segment rows lose their time or their clock hour."""
    raw = documents.parsed_segments(derived.segments(spark, sf))
    buses = F.col("bus_trip_count").cast("int")
    broken = raw.withColumns(
        {
            "average_travel_time": F.when(buses % 11 != 3, F.col("average_travel_time")),
            "hour_of_day": F.when(buses % 7 == 2, "24").when(buses % 7 == 3, "noon").otherwise(F.col("hour_of_day")),
        }
    )
    return {
        "zones": quarantine.judged(documents.split_zones(derived.zone_lines(spark, sf)), documents.zone_faults()),
        "segments": quarantine.judged(broken, documents.segment_faults() | documents.clock_faults()),
        "zone shapes": quarantine.judged(derived.geojson_rows(spark, sf), documents.shape_faults()),
        "stations": quarantine.judged(documents.parsed_stations(derived.station_rows(spark, sf)), documents.station_faults()),
    }


@query
def quarantine_counts(spark, sf):
    """Kept and quarantined records by source and reason."""
    parts = [quarantine.counts(rows, source) for source, rows in _judged(spark, sf).items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def quarantine_rows(spark, sf):
    """Stations written once, the unreadable ones beside the others, and read from there."""
    kept, lost = quarantine.sift(_judged(spark, sf)["stations"], "stations", fresh_dir(spark, "stations"))
    found = documents.typed_stations(kept).select(F.col("pos"), F.lit("kept").alias("reason"), "name")
    return found.union(lost.select(F.get_json_object("record", "$.pos").cast("bigint"), "reason", F.get_json_object("record", "$.stop_name")))


@query
def quarantined_segments(spark, sf):
    """Leg blocks of what is left after rows without a time or a clock hour are kept apart."""
    kept = quarantine.usable(_judged(spark, sf)["segments"])
    return segments.leg_blocks(segments.leg_rows(documents.typed_segments(kept), derived.legs(spark))).select("route_id", "block", "cells")


@query
def station_mapping(spark, sf):
    """Zone to station names, stored as documents and read back."""
    out = fresh_dir(spark, "mapping")
    reports.write_documents(reports.station_documents(derived.station_zone(spark, sf)), out)
    return reports.read_station_documents(spark.read.schema("zone int, document string").json(out))


@query
def zone_bounds(spark, sf):
    return spatial.zone_bounds(derived.polygons(spark, sf)).drop("pos")


@query
def ring_edges(spark, sf):
    edges = spatial.edge_rows(derived.polygons(spark, sf))
    return edges.select("zone", "part", "ring", "seq", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def ring_area(spark, sf):
    return spatial.part_areas(derived.polygons(spark, sf)).select("zone", "part", F.round("area", 4).alias("area"))


@query
def sliver_trim(spark, sf):
    return spatial.part_areas(derived.polygons(spark, sf)).where(~F.col("sliver")).select("zone", "part", F.size("rings").alias("rings"))


@query
def simplify_rings(spark, sf):
    kept = mapview.drawn_parts(derived.polygons(spark, sf))
    points = kept.select("zone", "part", F.posexplode("ring").alias("seq", "_p"))
    return points.select("zone", "part", "seq", F.round("_p.x", 6).alias("x"), F.round("_p.y", 6).alias("y"))


@query
def point_in_zone(spark, sf):
    return spatial.locate(derived.points(spark, sf), derived.polygons(spark, sf), 20.0, 5.0)


@query
def project_frame(spark, sf):
    # Drawn rings are never empty; an inner explode would place and round every ring once more to filter by its size.
    points = drawn(spark, sf).select("zone", "part", F.posexplode_outer("ring").alias("seq", "_p"))
    return points.select("zone", "part", "seq", "_p.x", "_p.y")


@query
def zone_path(spark, sf):
    return mapview.zone_outlines(drawn(spark, sf)).select("zone", "path")


@query
def zone_centroid(spark, sf):
    return mapview.zone_outlines(drawn(spark, sf)).select("zone", "cx", "cy")


@query
def view_box(spark, sf):
    return mapview.frame_box(drawn(spark, sf))


@query
def clipped_zones(spark, sf):
    shares = mapview.clipped_shares(drawn(spark, sf), 1.25)
    return mapview.worst_clipped(shares).select("zone", "outside", "vertices", F.round("share", 6).alias("share"))


@query
def drawing_counts(spark, sf):
    return mapview.drawing_counts(derived.polygons(spark, sf))


@query
def nearest_zone(spark, sf):
    """Closest zone corner mark to every point, among zones that are shaded."""
    zones = derived.polygons(spark, sf).where(F.col("zone") % 7 != 0)
    centres = spatial.zone_bounds(zones).select("pos", "zone", (F.col("min_x") + 10).alias("cx"), (F.col("min_y") + 10).alias("cy"))
    return spatial.nearest(derived.points(spark, sf), centres, 11.0).withColumn("distance", F.round("distance", 6))


# ---- sinks and streams ---------------------------------------------------------


@query
def report_json(spark, sf):
    """Car documents written and read back flat."""
    out = fresh_dir(spark, "car")
    reports.write_documents(reports.car_documents(cells(spark, sf), derived.zones(spark, sf)), out)
    return reports.read_car_documents(spark.read.schema(reports.STORED).json(out))


@query
def comparison_json(spark, sf):
    """Comparison documents written and read back flat."""
    out = fresh_dir(spark, "comparison")
    reports.write_documents(reports.comparison_documents(comparison(spark, sf)), out)
    return reports.read_comparison_documents(spark.read.schema(reports.STORED).json(out))


@query
def leg_json(spark, sf):
    """Bus leg documents written and read back flat."""
    out = fresh_dir(spark, "legs")
    reports.write_documents(reports.leg_documents(segments.leg_summary(segment_rows(spark, sf)), derived.legs(spark)), out)
    return reports.read_leg_documents(spark.read.schema("route_id string, document string").json(out))


@query
def corpus_json(spark, sf):
    """Corpus documents written and read back flat."""
    out = fresh_dir(spark, "corpus")
    fact = histograms.count_bins(binned(spark, sf), ["source", "year_month", "airport"], "minutes")
    reports.write_documents(reports.corpus_document(fact), out)
    return reports.read_corpus_documents(spark.read.schema("source string, document string").json(out))


@query
def journey_json(spark, sf):
    """Journey documents written and read back flat."""
    out = fresh_dir(spark, "journeys")
    reports.write_documents(reports.journey_documents(best_journeys(spark, sf), transit_fares(spark)), out)
    found = reports.read_journey_documents(spark.read.schema("airport int, station string, document string").json(out))
    return found.withColumn("typical", F.round("typical", 6))


@query
def cohort_json(spark, sf):
    """Cohort documents written and read back flat."""
    out = fresh_dir(spark, "cohort")
    medians = cohort.cohort_medians(cohort.cohort_trips(derived.trips(spark, sf), 0), "company")
    reports.write_documents(reports.cohort_documents(medians, "company"), out)
    found = reports.read_cohort_documents(spark.read.schema("company string, document string").json(out), "company")
    return found.withColumn("change", F.round("change", 6))


@query
def stream_histogram(spark, sf):
    out, marks = fresh_dir(spark, "stream"), fresh_dir(spark, "marks")

    def rides(batch: DataFrame) -> DataFrame:
        return batch.select(
            "event_type", block_of(F.col("ts")).alias("block"), F.least(F.floor("value").cast("int"), F.lit(TOP_MINUTE)).alias("minutes")
        )

    incremental.run_histogram(derived.daily_event_files(spark, sf), rides, ["event_type", "block"], "minutes", out, marks)
    incremental.merge_tiers(spark, ["event_type", "block"], "minutes", out, fan=2)
    return incremental.read_histogram(spark, ["event_type", "block"], "minutes", out)


@query
def stream_daily_counts(spark, sf):
    out, marks = fresh_dir(spark, "days"), fresh_dir(spark, "marks")
    incremental.run_daily_totals(derived.daily_event_files(spark, sf), "ts", ["event_type"], out, marks)
    return incremental.read_histogram(spark, ["event_type"], "day", out)


@query
def stream_closed_days(spark, sf):
    """Days the watermark has closed, with state; rows later than the delay are dropped."""
    out, marks = fresh_dir(spark, "closed"), fresh_dir(spark, "marks")
    incremental.run_daily_counts(derived.arriving_events(spark, sf), "ts", ["event_type"], out, marks, delay=f"{derived.LATE_PERIOD_DAYS} days")
    return spark.read.schema("day string, event_type string, n bigint").parquet(out)
