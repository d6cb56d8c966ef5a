import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import measures, timeblocks
from tidemark.sources.trips import company_name


def test_blocks_tile_the_day(spark):
    report = timeblocks.tiling_report(timeblocks.block_table(spark)).collect()
    assert len(report) == 5 and all(row.tiles for row in report)


@pytest.mark.parametrize(
    "clock, block",
    [("06:59", "early"), ("07:00", "am"), ("09:59", "am"), ("10:00", "midday"), ("15:59", "midday"),
     ("16:00", "pm"), ("18:59", "pm"), ("19:00", "evening"), ("00:00", "early"), ("23:59", "evening")],
)
def test_a_boundary_belongs_to_the_later_block(spark, clock, block):
    ts = F.to_timestamp_ntz(F.lit(f"2026-03-02 {clock}:30"))
    assert spark.range(1).select(timeblocks.block_of(ts)).first()[0] == block


def test_all_minutes_agree_between_case_and_table(spark):
    minutes = spark.range(1440).select(F.col("id").alias("m"), timeblocks.block_of_minute(F.col("id")).alias("b"))
    for row in minutes.collect():
        low, high = timeblocks.block_bounds(row.b)
        assert low <= row.m < high


def test_unknown_block_and_impossible_clock(spark):
    with pytest.raises(KeyError):
        timeblocks.block_bounds("teatime")
    for hour, minute in ((24, 0), (-1, 0), (3, 60)):
        with pytest.raises(PySparkException):
            spark.range(1).select(timeblocks.block_of_clock(F.lit(hour), F.lit(minute))).collect()


def test_working_days(spark):
    # 2 March 2026 is a Monday.
    days = [f"2026-03-0{d} 12:00:00" for d in range(2, 9)]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(
        "d", timeblocks.is_working_day(F.to_timestamp_ntz("d")).alias("w")
    )
    assert [r.w for r in df.orderBy("d").collect()] == [True] * 5 + [False] * 2


def test_verdict_table(spark):
    cases = [
        (102, 71, "transit"), (40, 75, "car"), (50, 50, "too close to call"), (50, 51, "too close to call"),
        (54, 50, "too close to call"), (55, 50, "transit"), (50, 55, "car"),
        (None, 40, "transit only"), (40, None, "car only"), (None, None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "c int, t int, expected string")
    assert all(r.v == r.expected for r in df.select("expected", measures.verdict(F.col("c"), F.col("t")).alias("v")).collect())


def test_rounding_matches_half_even_on_the_binary_value(spark):
    rng = random.Random(3)
    values = [0.15, 0.25, 0.35, 2.5, 12.25, 0.05, 1.45, 99.95, 0.0, -0.15, -2.25]
    values += [rng.randrange(0, 4000) / 20 for _ in range(500)] + [rng.uniform(0, 500) for _ in range(500)]
    values += [math.nextafter(k / 20, 1e9) for k in range(1, 99, 2)] + [math.nextafter(k / 20, 0) for k in range(1, 99, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", measures.round_even_1(F.col("v")).alias("one"), measures.round_even_0(F.col("v")).alias("none")).collect():
        assert row.one == round(row.v, 1), row
        assert row.none == round(row.v), row


def test_bins_and_fares(spark):
    row = spark.range(1).select(
        measures.minute_bin(F.lit(59)).alias("a"), measures.minute_bin(F.lit(60)).alias("b"),
        measures.minute_bin(F.lit(999999)).alias("c"), measures.dollar_bin(F.lit(2.5)).alias("d"),
        measures.dollar_bin(F.lit(450.0)).alias("e"),
        measures.signed_sum([F.lit(10.0), F.lit(None).cast("double")], [F.lit(3.0), F.lit(None).cast("double")]).alias("f"),
    ).first()
    assert tuple(row) == (0, 1, 180, 3, 300, 7.0)


def test_month_spans(spark):
    def span(a, b):
        return spark.range(1).select(measures.month_span(F.lit(a), F.lit(b))).first()[0]

    assert span("2026-01", "2026-01") == "Jan 2026"
    assert span("2026-01", "2026-05") == "Jan to May 2026"
    assert span("2025-11", "2026-05") == "Nov 2025 to May 2026"
    assert span(None, None) == ""


def test_labels(spark):
    row = spark.range(1).select(
        measures.clean_text(F.lit("  "), F.lit("none")).alias("a"), measures.clean_text(F.lit(" x "), F.lit("none")).alias("b"),
        company_name(F.lit("HV0003")).alias("c"), company_name(F.lit("HV0002")).alias("d"),
        measures.implied_minutes(F.lit(3.99), F.lit(15.0)).alias("e"), measures.implied_minutes(F.lit(1.0), F.lit(0.0)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f) == ("none", "x", "Uber", "HV0002", None)
    assert abs(row.e - 15.96) < 1e-9
