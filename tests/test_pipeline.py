import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.fixed_values import RAIL_LINKS
from tidemark.operators import cells, cohort, compare, guards, journeys, mapview, segments, tripbins
from tidemark.plans import reports as plans
from tidemark.sources import documents, manifest, months, reports
from tidemark.sources.trips import FEEDS, RIDE_HAIL, YELLOW, conform, fare_columns, read_months, spellings, usable_trips

MONDAY = datetime(2026, 3, 2, 10, 15)


def ride_hail(spark, rows, extra=()):
    """Rows of (origin, destination, pickup, seconds, base fare, tolls)."""
    fields = "hvfhs_license_num string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_time int, base_passenger_fare double, tolls double"
    made = [("HV0003", at, at + timedelta(seconds=s), o, d, s, f, t) for o, d, at, s, f, t in rows]
    return spark.createDataFrame(made, fields)


# ---- feeds ---------------------------------------------------------------------


def test_optional_fare_parts_may_be_missing_and_are_named(spark):
    plus, minus, missing = fare_columns(RIDE_HAIL, {"base_passenger_fare": "base_passenger_fare", "airport_fee": "Airport_fee"})
    assert plus == ["base_passenger_fare", "Airport_fee"] and minus == []
    assert "cbd_congestion_fee" in missing and "airport_fee" not in missing


def test_a_missing_required_column_is_an_error(spark):
    with pytest.raises(ValueError):
        fare_columns(YELLOW, {"tip_amount": "tip_amount"})


def test_tips_are_taken_off_and_duration_derived(spark):
    df = spark.createDataFrame(
        [(MONDAY, MONDAY + timedelta(seconds=1800), 161, 132, 80.0, 15.0), (MONDAY, MONDAY + timedelta(seconds=60), 161, 132, 20.0, None)],
        "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, Total_Amount double, tip_amount double",
    )
    assert spellings(df)["total_amount"] == "Total_Amount"
    rows = conform(df, YELLOW).collect()
    assert [(r.fare, r.duration_s, r.company, r.year_month) for r in rows] == [(65.0, 1800, "", "2026-03"), (20.0, 60, "", "2026-03")]


def test_months_with_different_columns_are_read_one_by_one(spark, tmp_path):
    january = ride_hail(spark, [(161, 132, MONDAY, 1500, 50.0, 5.0)])
    january.write.parquet(str(tmp_path / RIDE_HAIL.file_name("2026-01")))
    february = january.withColumnRenamed("tolls", "Tolls").withColumn("cbd_congestion_fee", F.lit(2.0))
    february.write.parquet(str(tmp_path / RIDE_HAIL.file_name("2026-02")))
    rows = {r.year_month: r for r in read_months(spark, FEEDS["fhvhv"], str(tmp_path), ["2026-01", "2026-02"]).collect()}
    assert rows["2026-01"].fare == 55.0 and rows["2026-02"].fare == 57.0
    assert "cbd_congestion_fee" in rows["2026-01"].missing_parts and "cbd_congestion_fee" not in rows["2026-02"].missing_parts


def test_unusable_trips_are_dropped(spark):
    saturday = MONDAY + timedelta(days=5)
    df = ride_hail(
        spark,
        [(161, 132, MONDAY, 1500, 50.0, None), (161, 7, MONDAY, 1500, 50.0, 0.0), (None, 132, MONDAY, 1500, 50.0, 0.0),
         (161, 132, MONDAY, 0, 50.0, 0.0), (161, 132, MONDAY, 21600, 50.0, 0.0), (161, 132, MONDAY, 1500, 501.0, 0.0),
         (161, 132, MONDAY, 1500, -1.0, 0.0), (161, 132, saturday, 1500, 50.0, 0.0), (161, 138, MONDAY, 21599, 500.0, 0.0)],
    )
    trips = conform(df, RIDE_HAIL)
    kept = tripbins.with_bins(usable_trips(trips, [132, 138, 1])).collect()
    assert sorted((r.airport, r.block, r.minutes, r.dollars) for r in kept) == [(132, "midday", 25, 50), (138, "midday", 180, 300)]
    counts = tripbins.validity_counts(trips, [132, 138, 1]).first()
    assert (counts.trips, counts.elsewhere, counts.incomplete, counts.bad_duration, counts.bad_fare, counts.weekend, counts.usable) == (9, 1, 1, 2, 2, 1, 2)


# ---- months --------------------------------------------------------------------


def test_month_range_rolls_over_the_year(spark):
    assert [r.year_month for r in months.month_range(spark, "2025-11", "2026-02").orderBy("year_month").collect()] == [
        "2025-11", "2025-12", "2026-01", "2026-02",
    ]
    assert months.month_range(spark, "2026-01").count() == 1 and months.month_range(spark, "2026-02", "2026-01").count() == 0


def test_coverage_names_every_month(spark):
    wanted = months.month_range(spark, "2026-01", "2026-04")
    have = spark.createDataFrame([("2026-01",)], "year_month string")
    offered = spark.createDataFrame([("2026-01",), ("2026-02",), ("2026-04",)], "year_month string")
    report = months.coverage(wanted, have, offered)
    assert {r.year_month: r.status for r in report.collect()} == {
        "2026-01": "cached", "2026-02": "fetched", "2026-03": "skipped", "2026-04": "fetched",
    }
    totals = months.coverage_totals(report).first()
    assert (totals.fetched, totals.cached, totals.skipped, totals.skipped_months) == (2, 1, 1, ["2026-03"])
    forced = months.coverage(wanted, have, offered, force=True)
    assert forced.where("status = 'fetched'").count() == 3


def april(spark, n, seconds=1500, stated=None):
    df = ride_hail(spark, [(161, 132, MONDAY + timedelta(days=7 * (i % 3)), seconds, 50.0, 0.0) for i in range(n)])
    return df if stated is None else df.withColumn("trip_time", F.lit(stated))


def test_ingest_adds_only_missing_months_and_force_replaces(spark, tmp_path):
    out = str(tmp_path / "facts")
    wanted = months.month_range(spark, "2026-03")
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [132], out)
    first = months.stored_counts(spark, out).collect()
    assert [(r.year_month, r.bins, r.trips, r.fare_trips) for r in first] == [("2026-03", 1, 40, 40)]
    assert months.missing_months(wanted, months.stored_months(spark, out)).isEmpty()
    months.ingest(conform(april(spark, 55), RIDE_HAIL), wanted, [132], out, force=True)
    assert months.stored_counts(spark, out).first().trips == 55
    zones = spark.createDataFrame([(161, "Midtown", "M"), (132, "Airport", "Q")], "zone int, name string, borough string")
    report = plans.named_airports(plans.car_report(spark, out, "fhvhv", zones, [132])).collect()
    assert {(r.airport, r.grain, r.n, r.p50, r.fare) for r in report} == {("JFK", "midday", 55, 25, 50), ("JFK", "day", 55, 25, 50)}
    with pytest.raises(RuntimeError):
        plans.car_report(spark, out, "yellow", zones, [132])


def test_a_changed_unit_stops_the_ingest_before_anything_is_stored(spark, tmp_path):
    out = str(tmp_path / "facts")
    minutes_as_seconds = april(spark, 40, seconds=60, stated=3600)
    with pytest.raises(guards.GuardFailure, match="unit changed"):
        months.ingest(conform(minutes_as_seconds, RIDE_HAIL), months.month_range(spark, "2026-03"), [132], out)
    assert months.stored_months(spark, out).isEmpty()


# ---- guards --------------------------------------------------------------------


@pytest.mark.parametrize(
    "duration, gap, status",
    [(1000, 1000, "ok"), (2674, 2649, "ok"), (1000, 60000, "unit changed"), (60000, 1000, "unit changed"),
     (1000, 0, "unit changed"), (600, 600, "no usable rows")],
)
def test_unit_ratio(spark, duration, gap, status):
    df = spark.createDataFrame([("s", duration, gap)] * 3, "source string, duration_s bigint, gap_s bigint")
    assert guards.unit_ratio_report(df, ["source"]).first().status == status


def segment(spark, minutes, n=20, distance="3.99", speed="15.0"):
    body = {"road_distance": distance, "average_road_speed": speed, "average_travel_time": str(minutes), "hour_of_day": "8"}
    rows = spark.createDataFrame([("d", json.dumps(body))] * n, "dataset string, row string")
    return documents.segment_rows(rows).withColumn("route_id", F.lit("Q"))


@pytest.mark.parametrize(
    "minutes, n, speed, status",
    [(15.96, 20, "15.0", "ok"), (15.96 * 60, 20, "15.0", "unit changed"), (16.2, 20, "15.0", "ok"),
     (15.96, 3, "15.0", "too few rows"), (5, 50, "0", "too few rows"), (5, 50, "fast", "too few rows")],
)
def test_segment_units(spark, minutes, n, speed, status):
    report = guards.segment_unit_report(segment(spark, minutes, n, speed=speed), ["dataset", "route_id"])
    assert report.first().status == status
    if status != "ok":
        with pytest.raises(guards.GuardFailure):
            guards.enforce(report)


# ---- zones and cells -----------------------------------------------------------


def test_zone_lines_and_reportable_zones(spark):
    lines = ["1,EWR,Newark Airport,x", "132,Queens,JFK Airport,x", "138,Queens,LaGuardia Airport,x",
             "161, Manhattan ,Midtown Center,x", "264,Unknown,,x", "265,N/A,Outside of NYC,x", "bad,Queens,Nowhere,x", "300,,Somewhere,x"]
    zones = documents.zone_dimension(spark.createDataFrame([(line,) for line in lines], "line string"))
    rows = {r.zone: (r.name, r.borough) for r in zones.collect()}
    assert rows[264] == ("Unknown zone 264", "Unknown") and rows[161] == ("Midtown Center", "Manhattan")
    assert rows[300] == ("Somewhere", "Unknown") and len(rows) == 7
    assert [r.zone for r in cells.reportable_zones(zones, [1, 132, 138]).collect()] == [161]


def test_thin_cells_and_the_floor(spark):
    hist = [(1, 7, "", "am", 30, 30), (1, 7, "", "pm", 40, 29), (1, 8, "", "am", 10, 29), (1, 99, "", "am", 10, 500)]
    time = spark.createDataFrame(hist, "airport int, origin int, company string, block string, minutes int, n bigint")
    fare = spark.createDataFrame([(1, 7, "am", 50, 30)], "airport int, origin int, block string, dollars int, n bigint")
    zones = spark.createDataFrame([(7, "A", "X"), (8, "B", "X"), (99, "C", "Unknown")], "zone int, name string, borough string")
    found = {(r.origin, r.grain): (r.n, r.p50, r.fare) for r in cells.car_cells(time, fare, zones, [1]).collect()}
    assert found == {(7, "am"): (30, 30, 50), (7, "day"): (59, 30, 50)}
    thin = cells.thin_cells(time, zones, [1]).first()
    assert (thin.zones, thin.thin) == (1, 4)


# ---- segments, journeys, comparison ---------------------------------------------


def test_the_link_tables(spark):
    links = plans.link_table(spark).collect()
    assert [(r.airport, r.link_pos) for r in links] == [("JFK", 0), ("JFK", 1), ("LGA", 0), ("LGA", 1)]
    for link in links:
        assert 0 <= link.wait_low < link.wait_high
        assert (link.ride_low is None) == (link.airport == "LGA")
    assert {r for row in RAIL_LINKS for r in row[1]} == set("AEJZ7FMR")
    assert plans.leg_table(spark).count() == 2 and plans.fare_table(spark).count() == 2 and plans.evidence_table(spark).count() == 2


def route(directions):
    return json.dumps({"directions": directions})


def direction(names, pairs, waits):
    return {"stations": [{"id": n, "name": n, "km": 1.0} for n in names], "pairs": pairs, "waits": waits}


def ride(p50, p90, n=100):
    return {"n": n, "p50": p50, "p90": p90}


def test_journeys_follow_the_published_rules(spark):
    a = route({
        "north": direction(["P", "Q", "HUB", "R"], {"0-2": {"am": ride(20, 30), "pm": ride(25, 35)}, "1-2": {"am": ride(5, 9, 29)}},
                           {"0": {"am": 5.0, "pm": 2.5}, "1": {"am": 1.0}}),
        "other": direction(["X", "Y"], {"0-1": {"am": ride(1, 1)}}, {"0": {"am": 1.0}}),
        "loop": direction(["P", "HUB"], {"0-1": {"am": ride(50, 60)}}, {"0": {"am": 5.0}}),
    })
    b = route({"south": direction(["P", "Q", "HUB"], {"0-2": {"am": ride(50, 60)}, "1-2": {"am": ride(10, 12)}}, {"0": {"am": 5.0}})})
    docs = spark.createDataFrame([("A", a), ("B", b)], "route string, document string")
    links = spark.createDataFrame([("JFK", 0, ["A", "B"], "HUB", "rail", 10, 15, 0, 10, 3, 8), ("LGA", 0, ["A"], "HUB", "bus", None, None, 0, 12, 3, 8)], plans.LINK_COLUMNS)
    ranges = spark.createDataFrame([("pm", 9, 12)], "block string, seg_low int, seg_high int")
    best = plans.transit_journeys(documents.route_directions(docs), links, ranges)
    rows = {(r.airport, r.station): r for r in best.collect()}
    # Q has too few rides on A and no wait on B; the bus has no range in the morning and A's later direction has no evening.
    assert set(rows) == {("JFK", "P"), ("LGA", "P")}
    jfk = rows["JFK", "P"]
    # The loop overwrote the quicker direction of route A; B is equally slow and listed later.
    assert jfk.route == "A" and [(c.block, c.ride_p50) for c in jfk.blocks] == [("am", 50)]
    assert [(c.block, c.ride_p50) for c in rows["LGA", "P"].blocks] == [("pm", 25)]
    sums = sorted(min(i + j + k + m, 180) for i in range(11) for j in range(3, 9) for k in range(11) for m in range(10, 16))
    at = [sums[-(-len(sums) * q // 10) - 1] for q in (5, 9)]
    assert [jfk.blocks[0].overhead_p50, jfk.blocks[0].overhead_p90] == at
    assert jfk.blocks[0].door_p90 == 60 + at[1]


def test_comparison_rules(spark):
    cell = "airport string, origin int, grain string, n bigint, mean double, p50 int, p90 int, p95 int, fare int, fare_p90 int"
    car = spark.createDataFrame(
        [("JFK", 7, "day", 100, 50.0, 40, 70, 80, 60, 90), ("JFK", 7, "am", 90, 50.0, 45, 75, 80, 61, 90),
         ("JFK", 8, "day", 100, 50.0, 40, 70, 80, None, None), ("JFK", 8, "am", 90, 50.0, 45, 50, 80, None, None),
         ("EWR", 9, "day", 40, 50.0, 40, 70, 80, 60, 90)], cell)
    block = "struct<block: string, n: bigint, ride_p50: int, ride_p90: int, overhead_p50: int, overhead_p90: int, door_p50: int, door_p90: int>"
    trips = [("JFK", "S", 0, 0, "A", "HUB", "rail", [("am", 50, 1, 1, 1, 1, 50, 71), ("pm", 50, 1, 1, 1, 1, 40, 60)], 45.0),
             ("JFK", "T", 0, 0, "B", "HUB", "rail", [("am", 50, 1, 1, 1, 1, 50, 99)], 45.0)]
    journeys_ = spark.createDataFrame(trips, f"airport string, station string, link_pos int, route_pos int, route string, connector string, link string, blocks array<{block}>, typical double")
    mapping = spark.createDataFrame([(7, "T", 5), (7, "S", 2), (7, "S", 9), (11, "S", 1)], "zone int, station string, pos bigint")
    zones = spark.createDataFrame([(7, "Seven", "X")], "zone int, name string, borough string")
    df = plans.comparison_report(car, journeys_, mapping, zones, plans.fare_table(spark), plans.evidence_table(spark))
    rows = {(r.airport, r.zone, r.block): r for r in df.collect()}
    assert set(rows) == {("JFK", 7, "am"), ("JFK", 7, "pm"), ("JFK", 8, "am")}
    both = rows["JFK", 7, "am"]
    assert (both.station, both.verdict, both.lead_minutes, both.margin, both.car_buffer, both.transit_fare) == ("S", "too close to call", 71, 4, 30, 11.75)
    assert (rows["JFK", 7, "pm"].verdict, rows["JFK", 7, "pm"].lead_minutes) == ("transit only", 60)
    alone = rows["JFK", 8, "am"]
    assert (alone.verdict, alone.name, alone.borough, alone.station, alone.transit_evidence) == ("car only", "8", "", None, None)
    tally = compare.verdict_tally(df).collect()
    assert [(r.airport, r.block, r.car, r.transit, r.draw) for r in tally] == [("JFK", "am", 0, 0, 1)]
    opened = {(r.block, r.zone, r.gap) for r in compare.default_zone(df).collect()}
    assert opened == {("am", 7, 4)} | {(block, 7, None) for block in ("early", "midday", "pm", "evening")}
    cover = compare.coverage_counts(df).first()
    assert (cover.zones, cover.with_transit) == (2, 1)
    back = {(r.zone, r.block): r for r in reports.read_comparison_documents(
        reports.comparison_documents(df)).collect()}
    assert back[7, "am"].verdict == "too close to call" and back[8, "am"].transit_p90 is None


def test_leg_floor_and_ranges(spark):
    def rows(hour, values):
        return [("d", "Q", "N", 2, "2025-01", "Tuesday", hour, 1.0, float(v), 1.0, 20) for v in values]

    schema = "dataset string, route_id string, direction string, stop_order int, year_month string, day_of_week string, hour_of_day int, road_distance double, average_travel_time double, average_road_speed double, bus_trip_count int"
    df = spark.createDataFrame(rows(8, range(10, 21)) + rows(12, range(9)) + [("d", "Q", "N", 2, "2025-02", "Sunday", 8, 1.0, 99.0, 1.0, 5)], schema)
    summary = segments.leg_summary(df).collect()
    assert [(r.block, r.cells, r.typical, r.low, r.high, r.worst_cell, r.buses_per_cell, r.months, r.buses_observed) for r in summary] == [
        ("am", 11, 15.0, 11.0, 19.0, 20.0, 20.0, 1, 400)
    ]
    ranges = segments.ride_ranges(segments.leg_blocks(df)).first()
    assert (ranges.seg_low, ranges.seg_high) == (11, 19)


def test_cohort_report(spark):
    minutes = [38, 57, 58, 60]
    at = [(MONDAY, m) for m in minutes[:2]] + [(MONDAY + timedelta(days=35), m) for m in minutes[2:]]
    trips = conform(ride_hail(spark, [(161, 132, a, m * 60, 50.0, 0.0) for a, m in at] + [(161, 132, MONDAY + timedelta(hours=1), 60, 9.0, 0.0)]), RIDE_HAIL)
    rows = {r.month: r for r in cohort.cohort_medians(cohort.cohort_trips(trips, 132, origins=[161])).collect()}
    # Halves go to the even minute: 47.5 -> 48, 57.5 -> 58.
    assert {m: (r["median"], r.trips) for m, r in rows.items()} == {"2026-03": (48, 2), "2026-04": (59, 2), "all": (58, 4)}
    assert rows["all"].span == "Mar to Apr 2026" and rows["all"].months == 2 and rows["all"].change == pytest.approx(58 / 38 - 1)


def test_shading(spark):
    df = spark.createDataFrame([("J", "am", z, v) for z, v in enumerate([10, 20, 20, 30, 40, 50, 60, None])], "airport string, block string, zone int, v int")
    rows = {r.zone: (r.step, r.legend_low, r.legend_high) for r in mapview.shade(df, F.col("v")).collect()}
    ordered = [10, 20, 20, 30, 40, 50, 60]
    breaks = [ordered[int(q * 6)] for q in (0.2, 0.4, 0.6, 0.8)]
    assert rows == {z: (sum(v > b for b in breaks), 10, 60) for z, v in enumerate(ordered)}


def test_routed_links_keep_positions(spark):
    rows = journeys.routed_links(plans.link_table(spark)).where("airport = 'JFK'").collect()
    assert [(r.link_pos, r.route_pos, r.route) for r in rows] == [(0, 0, "A"), (1, 0, "E"), (1, 1, "J"), (1, 2, "Z")]


def test_cells_without_any_fares(spark, tmp_path):
    out = str(tmp_path / "facts")
    row = [("time", 132, 161, "", "am", 40, 50, "fhvhv", "2026-03")]
    schema = "fact string, airport bigint, origin bigint, company string, block string, bin int, n bigint, source string, year_month string"
    spark.createDataFrame(row, schema).write.partitionBy("fact", "source", "year_month").parquet(out)
    zones = spark.createDataFrame([(161, "Midtown", "M")], "zone int, name string, borough string")
    found = {(r.grain, r.n, r.fare, r.fare_p90) for r in plans.car_report(spark, out, "fhvhv", zones, [132]).collect()}
    assert found == {("am", 50, None, None), ("day", 50, None, None)}


# ---- ingest that is cut off, empty or forced ------------------------------------


def test_a_half_stored_month_is_stored_again(spark, tmp_path):
    out, wanted = str(tmp_path / "facts"), months.month_range(spark, "2026-03")
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [132], out)
    months._clear(spark, out, ["1999-01"])  # nothing to clear is no error
    fare = next((tmp_path / "facts").glob("fact=fare/source=*/year_month=*"))
    for file in fare.iterdir():
        file.unlink()
    fare.rmdir()
    assert months.stored_months(spark, out).isEmpty()
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [132], out)
    assert months.stored_counts(spark, out).first().fare_trips == 40


def test_a_month_without_usable_trips_is_named(spark, tmp_path):
    out, wanted = str(tmp_path / "facts"), months.month_range(spark, "2026-03")
    for _ in range(2):
        report = months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [999], out)
        assert [tuple(r) for r in report.collect()] == [("2026-03", months.NO_ROWS)]
        assert months.stored_months(spark, out).isEmpty()
    cover = months.coverage(wanted, months.stored_months(spark, out), wanted, unusable=report)
    assert [tuple(r) for r in cover.collect()] == [("2026-03", months.NO_ROWS)]


def test_force_clears_a_month_that_became_empty(spark, tmp_path):
    out, wanted = str(tmp_path / "facts"), months.month_range(spark, "2026-03")
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [132], out)
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [999], out)
    assert months.stored_counts(spark, out).first().trips == 40
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [999], out, force=True)
    assert months.stored_counts(spark, out).count() == 0


def test_every_failing_row_is_named(spark):
    report = spark.createDataFrame([(f"m{i}", "unit changed") for i in range(9)], "year_month string, status string")
    with pytest.raises(guards.GuardFailure, match="9 failing.*m8"):
        guards.enforce(report)


def test_unreadable_numbers_fail_the_guard(spark):
    body = {"road_distance": "4", "average_road_speed": "15", "average_travel_time": "16", "hour_of_day": "8", "bus_trip_count": "3"}
    rows = [json.dumps(body)] * 12 + [json.dumps(body | {"average_travel_time": "sixteen"})]
    typed = documents.segment_rows(spark.createDataFrame([("d", r) for r in rows], "dataset string, row string")).withColumn("route_id", F.lit("Q"))
    wanted = spark.createDataFrame([("d", "Q"), ("e", "Q")], "dataset string, route_id string")
    report = {r.dataset: (r.usable, r.unparsed, r.status) for r in guards.segment_unit_report(typed, ["dataset", "route_id"], wanted).collect()}
    assert report == {"d": (12, 1, "unparsed rows"), "e": (0, 0, "too few rows")}


# ---- versions of what is stored --------------------------------------------------


def stored(spark, out):
    return sorted(tuple(r) for r in months._stored(spark, out).select("fact", "year_month", "airport", "n").collect())


def two_months(spark, n):
    later = ride_hail(spark, [(161, 132, MONDAY + timedelta(days=35), 1500, 50.0, 0.0)] * n)
    return conform(april(spark, n).unionByName(later), RIDE_HAIL)


def test_a_reader_sees_the_old_state_while_partitions_are_replaced(spark, tmp_path, monkeypatch):
    out, wanted = str(tmp_path / "facts"), months.month_range(spark, "2026-03", "2026-04")
    months.ingest(two_months(spark, 40), wanted, [132], out)
    before = stored(spark, out)
    assert {r[1] for r in before} == {"2026-03", "2026-04"}

    def cut_off(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(months, "_publish", cut_off)
        with pytest.raises(RuntimeError, match="lost"):
            months.ingest(two_months(spark, 55), wanted, [132], out, force=True)
    new = manifest.stored_files(spark, out, months.PARTITIONS) - set(manifest.current(spark, out).files)
    assert len(new) == 4 and stored(spark, out) == before
    (tmp_path / "facts" / min(new)).unlink()  # cut off between two partitions
    assert stored(spark, out) == before
    months.ingest(two_months(spark, 55), wanted, [132], out, force=True)
    assert {r[3] for r in stored(spark, out)} == {55}


def test_a_reader_that_has_begun_finishes_on_its_version(spark, tmp_path):
    out, wanted = str(tmp_path / "facts"), months.month_range(spark, "2026-03")
    months.ingest(conform(april(spark, 40), RIDE_HAIL), wanted, [132], out)
    begun = months.stored_counts(spark, out)
    months.ingest(conform(april(spark, 55), RIDE_HAIL), wanted, [132], out, force=True)
    assert begun.first().trips == 40 and months.stored_counts(spark, out).first().trips == 55
    assert manifest.sweep(spark, out, months.PARTITIONS) == []
    months.ingest(conform(april(spark, 60), RIDE_HAIL), wanted, [132], out, force=True)
    gone = manifest.sweep(spark, out, months.PARTITIONS)
    assert len(gone) == 2 and months.stored_counts(spark, out).first().trips == 60


def test_a_second_writer_is_refused(spark, tmp_path):
    out = str(tmp_path / "facts")
    first = manifest.publish(spark, out, ["a"], None)
    manifest.publish(spark, out, ["b"], first)
    with pytest.raises(RuntimeError, match="someone else"):
        manifest.publish(spark, out, ["c"], first)
    assert manifest.current(spark, out) == manifest.Version(1, ("b",))
