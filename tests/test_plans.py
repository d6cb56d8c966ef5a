"""What the plans of the named queries look like before they run."""

from pathlib import Path

import pytest

from tidemark.catalog import QUERIES

SF = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["car_summary", "mode_comparison", "default_zone", "quintile_shade", "segment_leg_summary", "journeys_best", "unit_ratio_guard", "view_box"])
def test_queries_read_the_given_tables_only(spark, name):
    files = QUERIES[name](spark, str(SF)).inputFiles()
    assert files and all(f"{SF}/" in f for f in files)


@pytest.mark.parametrize("name", ["point_in_zone", "nearest_zone"])
def test_exploded_sides_are_not_broadcast(spark, name):
    text = plan(QUERIES[name](spark, str(SF)))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["simplify_rings", "zone_path", "project_frame", "drawing_counts"])
def test_lines_are_simplified_once(spark, name):
    assert plan(QUERIES[name](spark, str(SF))).count("ArrowEvalPython") == 1


def test_both_facts_come_from_one_scan(spark):
    assert plan(QUERIES["car_summary"](spark, str(SF))).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["project_frame", "clipped_zones"])
def test_shapes_are_spread_and_rounded_once(spark, name):
    text = QUERIES[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text
    assert not any("134217729" in line for line in text.split("\n") if "Filter" in line)
