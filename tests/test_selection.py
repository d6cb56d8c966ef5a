"""Exact quantiles of few groups: against sorted values, with groups on both sides of the bracket limit."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort
from tidemark.operators.selection import FEW, few_group_quantiles


def linear(values, q):
    ordered = sorted(values)
    place = q * (len(ordered) - 1)
    low, high = math.floor(place), math.ceil(place)
    return ordered[low] * (1.0 - (place - low)) + ordered[high] * (place - low)


def groups():
    """A hot group of spread values, one of few distinct values, one of a single value, small ones, one without values."""
    rng = random.Random(5)
    return {
        "hot": [rng.gauss(50, 20) for _ in range(30_000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(9_000)],
        "same": [4.0] * 5_000,
        "edge": [rng.random() for _ in range(FEW + 1)],
        "few": [rng.random() for _ in range(FEW)],
        "two": [1.0, 2.0],
        "one": [7.0],
        "none": [],
        None: [3.0, 5.0, 4.0],
    }


QUANTILES = {"least": 0.0, "p10": 0.1, "median": 0.5, "close": 0.501, "p90": 0.9, "greatest": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    held = [(g, v, -v) for g, values in groups().items() for v in values] + [(g, None, None) for g in groups()]
    random.Random(1).shuffle(held)
    return spark.createDataFrame(held, "g string, v double, w double").repartition(7)


def test_quantiles_are_exact(rows):
    wanted = {f"{c}_{name}": (c, q) for c in ("v", "w") for name, q in QUANTILES.items()}
    found = few_group_quantiles(rows, ["g"], {"v": F.col("v"), "w": F.col("w")}, wanted, {"all": F.count(F.lit(1))})
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == set(groups())
    for g, values in groups().items():
        assert got[g]["all"] == len(values) + 1
        for name, q in QUANTILES.items():
            if not values:
                assert got[g][f"v_{name}"] is None and got[g][f"w_{name}"] is None
            else:
                assert got[g][f"v_{name}"] == linear(values, q) and got[g][f"w_{name}"] == linear([-v for v in values], q)


def test_only_a_small_share_of_a_hot_group_is_shuffled(spark, rows):
    found = few_group_quantiles(rows.where("g = 'hot'"), ["g"], {"v": F.col("v")}, {"median": ("v", 0.5), "p90": ("v", 0.9)})
    found.collect()
    plan, sent = found._jdf.queryExecution().executedPlan().toString(), []

    def visit(node):
        if node.nodeName().startswith("Exchange") and "RoundRobin" not in node.simpleString(200):
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        for child in below + [children.apply(i) for i in range(children.size())]:
            visit(child)

    visit(found._jdf.queryExecution().executedPlan())
    assert "HashAggregate" in plan and sent and max(sent) < 0.02 * 30_000


def test_rejects_a_share_beyond_one(rows):
    with pytest.raises(ValueError):
        few_group_quantiles(rows, ["g"], {"v": F.col("v")}, {"q": ("v", 1.5)})


def test_profile_of_an_empty_table(rows):
    assert cohort.profile(rows.where("g = 'nobody'"), "g", {"v": F.col("v")}, {"q": ("v", 0.5)}).count() == 0
