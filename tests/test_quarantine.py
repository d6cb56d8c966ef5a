"""Records that cannot be used, kept apart with their reason."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timeblocks import named_bounds
from tidemark.operators import cohort
from tidemark.plans import jobs
from tidemark.sources import documents, quarantine


def test_first_reason_counts_and_both_sides_come_from_one_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5", 1), (2, "x", None), (3, None, 3), (4, "7", None)], "id int, number string, kept int")
    judged = quarantine.judged(rows.withColumnRenamed("kept", "mark"), {"no number": F.col("number").try_cast("int").isNull(), "no mark": F.col("mark").isNull()})
    kept, lost = quarantine.sift(judged, "source", str(tmp_path / "out"))
    assert [tuple(r) for r in kept.collect()] == [(1, "5", 1)] and kept.columns == ["id", "number", "mark"]
    assert {(r.source, r.reason, json.loads(r.record)["id"]) for r in lost.collect()} == {
        ("source", "no number", 2), ("source", "no number", 3), ("source", "no mark", 4),
    }
    assert {(r.reason, r.n) for r in quarantine.counts(judged, "source").collect()} == {("kept", 1), ("no number", 2), ("no mark", 1)}


def test_bad_clocks_no_longer_stop_a_leg_report(spark, tmp_path):
    good = {"route_id": "Q70+", "direction": "N", "stop_order": "2", "timestamp": "2025-01-01T00:00:00.000", "day_of_week": "Tuesday",
            "road_distance": "4", "average_travel_time": "16", "average_road_speed": "15", "bus_trip_count": "27"}
    rows = [good | {"timestamp": f"2025-{m:02d}-01T00:00:00.000", "hour_of_day": str(h)} for m in range(1, 7) for h in (7, 8, 9)]
    rows += [good | {"hour_of_day": "25"}, good | {"hour_of_day": "noon"}, {k: v for k, v in good.items() if k != "average_travel_time"} | {"hour_of_day": "8"}]
    (tmp_path / "bus.json").write_text(json.dumps(rows))
    jobs.segment_job(spark, {"new": str(tmp_path / "bus.json")}, str(tmp_path / "out"))
    assert [(r.block, r.cells) for r in spark.read.parquet(f"{tmp_path}/out/legs").collect()] == [("am", 18)]
    lost = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert {r.reason for r in lost} == {"hour beyond the clock", "hour is no number", "no travel time"} and {r.source for r in lost} == {"segments"}


def test_unknown_block_names_fail(spark):
    known = spark.createDataFrame([("am",), ("pm",)], "block string").select(named_bounds(F.col("block")).alias("b")).select("b.*")
    assert [tuple(r) for r in known.collect()] == [(420, 600), (960, 1140)]
    with pytest.raises(Exception, match="unknown part of the day: dusk"):
        spark.createDataFrame([("dusk",)], "block string").select(named_bounds(F.col("block"))).collect()


def test_feeds_without_trips_are_left_out_and_none_at_all_is_an_error(spark):
    trips = spark.createDataFrame([("a", "2026-01"), ("a", "2026-03")], "source string, year_month string")
    found = cohort.windowed_feeds({"a": (trips, "2026-01", "2026-02"), "b": (trips.withColumn("source", F.lit("b")), "2031-01", "2031-02")})
    assert [tuple(r) for r in found.collect()] == [("a", "2026-01")]
    with pytest.raises(RuntimeError, match="no trips in any of a, b"):
        cohort.windowed_feeds({"a": (trips, "2027-01", "2027-02"), "b": (trips, "2031-01", "2031-02")})


def test_zone_faults_name_what_typed_zones_leave_out(spark):
    lines = documents.split_zones(spark.createDataFrame([("1,M,A,x",), ("x,M,B,x",), (",,,",)], "line string"))
    judged = quarantine.judged(lines, documents.zone_faults())
    assert quarantine.quarantined(judged, "zones").count() == 2 and documents.typed_zones(lines).count() == 1
