"""All jobs in a row on files in the published formats."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import jobs, reports
from tidemark.sources.trips import RIDE_HAIL, conform, usable_trips

MONDAY = datetime(2026, 3, 2, 8, 15)
FIELDS = "hvfhs_license_num string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_time int, base_passenger_fare double, tolls double, bcf double, sales_tax double, congestion_surcharge double, airport_fee double, cbd_congestion_fee double"


def trips(spark, n, minutes):
    rows = [
        ("HV0003", MONDAY, MONDAY + timedelta(minutes=minutes + i % 10), 161, 132, 60 * (minutes + i % 10), 50.0, None if i % 2 else 6.0, 1.0, 2.0, 2.5, 2.5, 1.5)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, FIELDS)


def square(x, y, size):
    return [[x, y], [x, y + size], [x + size, y + size], [x + size, y], [x, y]]


def test_from_files_to_comparison(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("raw", "facts", "car", "seg", "transit", "map", "cmp", "cohort", "draw")}
    trips(spark, 60, 40).write.parquet(f"{p['raw']}/fhvhv_tripdata_2026-03.parquet")
    trips(spark, 40, 60).drop("cbd_congestion_fee").withColumnRenamed("airport_fee", "Airport_fee").write.parquet(f"{p['raw']}/fhvhv_tripdata_2026-04.parquet")
    (tmp_path / "zones.csv").write_text(
        '"LocationID","Borough","Zone","service_zone"\n161,"Manhattan","Midtown Center","Yellow"\n132,"Queens","JFK Airport","Airports"\nx,"Q","bad","z"\n'
    )
    bus = [
        {"route_id": "Q70+", "direction": "N", "stop_order": "2", "timestamp": f"2025-{m:02d}-01T00:00:00.000", "day_of_week": "Tuesday", "hour_of_day": str(h),
         "road_distance": "4", "average_travel_time": "16", "average_road_speed": "15", "bus_trip_count": "27"}
        for m in range(1, 7) for h in (7, 8, 9)
    ]
    (tmp_path / "bus.json").write_text(json.dumps(bus))
    routes = tmp_path / "routes"
    routes.mkdir()
    station = [{"id": n, "name": n, "km": 1.0} for n in ("Midtown", "Sutphin Blvd-Archer Av-JFK Airport")]
    doc = {"directions": {"out": {"stations": station, "pairs": {"0-1": {"am": {"n": 100, "p50": 30, "p90": 38}}}, "waits": {"0": {"am": 3.0}}}}}
    (routes / "E.json").write_text(json.dumps(doc))
    with pytest.raises(RuntimeError, match="no document for route"):
        empty = spark.createDataFrame([], "block string, low int, high int")
        reports.require_inputs(reports.link_table(spark), spark.createDataFrame([("E",)], "route string"), empty)
    for other in {r for row in reports.link_table(spark).collect() for r in row.routes} - {"E"}:
        (routes / f"{other}.json").write_text(json.dumps({"directions": {}}))
    shapes = [
        {"locationid": "161", "zone": "Midtown Center", "borough": "Manhattan", "the_geom": {"type": "MultiPolygon", "coordinates": [[square(-74.0, 40.7, 0.1)]]}},
        {"locationid": "1", "zone": "Newark Airport", "borough": "EWR", "the_geom": {"type": "Polygon", "coordinates": [square(-74.3, 40.6, 0.1)]}},
        {"locationid": "2", "zone": "Nowhere", "borough": "Q"},
    ]
    (tmp_path / "shapes.json").write_text(json.dumps(shapes))
    places = [
        {"gtfs_stop_id": "E1", "stop_name": "Midtown", "borough": "M", "daytime_routes": "E  M", "gtfs_longitude": "-73.95", "gtfs_latitude": "40.75"},
        {"gtfs_stop_id": "E2", "stop_name": "Lost", "gtfs_longitude": "40.75", "gtfs_latitude": "-73.95"},
        {"gtfs_stop_id": "E3", "stop_name": "Broken", "gtfs_longitude": "west", "gtfs_latitude": "1"},
    ]
    (tmp_path / "stations.json").write_text(json.dumps(places))

    report = jobs.ingest_job(spark, "fhvhv", p["raw"], p["facts"], "2026-03", "2026-05")
    assert {r.year_month: r.status for r in report.collect()} == {"2026-03": "fetched", "2026-04": "fetched", "2026-05": "skipped"}
    again = jobs.ingest_job(spark, "fhvhv", p["raw"], p["facts"], "2026-03", "2026-04")
    assert {r.status for r in again.collect()} == {"cached"}

    jobs.car_job(spark, "fhvhv", p["facts"], str(tmp_path / "zones.csv"), p["car"])
    jobs.segment_job(spark, {"new": str(tmp_path / "bus.json")}, p["seg"])
    jobs.transit_job(spark, str(routes), p["seg"], p["transit"])
    jobs.mapping_job(spark, str(tmp_path / "shapes.json"), str(tmp_path / "stations.json"), p["map"])
    jobs.comparison_job(spark, p["car"], p["transit"], p["map"], str(tmp_path / "zones.csv"), p["cmp"])
    row = spark.read.parquet(f"{p['cmp']}/comparison").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.airport, row.zone, row.block, row.station, row.route, row.link) == ("JFK", 161, "am", "Midtown", "E", "AirTrain")
    assert (row.car_n, row.car_p50, row.car_p90) == (100, 48, 67)
    assert row.transit_fare == 11.75 and row.verdict == "too close to call"
    document = json.loads(spark.read.json(f"{p['cmp']}/documents").first().document)
    assert document["via"]["station"] == "Midtown" and document["car_evidence"] == "recorded trips"
    corpus = json.loads(spark.read.json(f"{p['car']}/corpus").first().document)
    assert (corpus["months"], corpus["weekday_trips"], corpus["sample_floor"]) == (["2026-03", "2026-04"], 100, 30)
    journey = json.loads(spark.read.json(f"{p['transit']}/documents").where("airport = 'JFK'").first().document)
    assert (journey["station"], journey["transit_fare"]) == ("Midtown", 11.75)

    jobs.cohort_job(spark, p["raw"], {"fhvhv": ("2026-03", "2026-05")}, 132, [161], p["cohort"], hour=8)
    pooled = spark.read.parquet(p["cohort"]).where("month = 'all'").first()
    assert (pooled.source, pooled["median"], pooled.trips, pooled.span) == ("fhvhv", 48, 100, "Mar to Apr 2026")
    cohort = json.loads(spark.read.json(f"{p['cohort']}_documents").first().document)
    assert cohort["months"]["all"]["month_list"] == "2026-03,2026-04"
    with pytest.raises(RuntimeError):
        jobs.cohort_job(spark, p["raw"], {"fhvhv": ("2026-03", "2026-05")}, 132, [7], p["cohort"])

    jobs.map_job(spark, str(tmp_path / "shapes.json"), p["draw"])
    drawn = spark.read.json(f"{p['draw']}/zones").collect()
    assert [(r.zone, r.borough) for r in drawn] == [(161, "Manhattan")] and drawn[0].path.startswith("M0.0 1000.0L")
    audit = reports.fare_audit(spark.read.parquet(f"{p['raw']}/fhvhv_tripdata_2026-03.parquet"), 132, [161], (8, 8)).first()
    assert (audit.trips, audit.base, audit.tolls, audit.taxes, audit.total) == (60, 50.0, 6.0, 5.5, 65.5)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_destination_filter_and_columns_reach_the_scan(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    trips(spark, 5, 40).withColumn("DOLocationID", F.col("DOLocationID").cast(kind)).withColumn("unused", F.lit(1)).write.parquet(path)
    df = usable_trips(conform(spark.read.parquet(path), RIDE_HAIL), [132, 138, 1]).groupBy("airport", "origin").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(DOLocationID, [1,132,138])" in plan and "unused" not in plan
    assert df.first()["count"] == 5
