import random

import pytest
from conftest import as_dict
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import histograms
from tidemark.operators.quantiles import LOWER, exact_quantiles


def hist(spark, counts, key="k"):
    return spark.createDataFrame([(key, b, n) for b, n in counts.items()], "k string, bin int, n bigint")


def uniform(low, high):
    return {b: 1 for b in range(low, high + 1)}


def test_samples_are_truncated_and_clipped(spark):
    df = spark.createDataFrame([("k", v) for v in (1.0, 1.9, 3.0, 99.0)], "k string, v double")
    assert as_dict(histograms.from_samples(df, ["k"], "v", 5), "bin", "n") == {1: 2, 3: 1, 5: 1}
    dense = histograms.densify(histograms.from_samples(df, ["k"], "v", 5), ["k"], "bin", 5)
    assert [r.n for r in dense.orderBy("bin").collect()] == [0, 2, 0, 1, 0, 1]


def test_negative_samples_are_refused(spark):
    df = spark.createDataFrame([("k", -1.0)], "k string, v double")
    with pytest.raises(PySparkException):
        histograms.from_samples(df, ["k"], "v").collect()


def test_merge_adds(spark):
    merged = histograms.merge([hist(spark, {0: 1, 2: 2}), hist(spark, {1: 3, 2: 1})], ["k"], "bin")
    assert as_dict(merged, "bin", "n") == {0: 1, 1: 3, 2: 3}


def test_quantiles_take_the_first_bin_that_reaches_the_share(spark):
    row = histograms.summarise(
        hist(spark, uniform(0, 9)), ["k"], "bin", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}, "mean"
    ).first()
    assert (row.n, row.p0, row.p50, row.p90, row.p100, row["mean"]) == (10, 0, 4, 8, 9, 4.5)


def test_array_quantiles_equal_the_window_ones(spark):
    rng = random.Random(8)
    rows = [(f"k{k}", b, rng.randrange(1, 50)) for k in range(30) for b in rng.sample(range(181), rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "k string, bin int, n bigint")
    asked = {"a": 0.01, "b": 0.5, "c": 0.9, "d": 1.0}
    window = {tuple(r) for r in histograms.summarise(df, ["k"], "bin", asked).collect()}
    assert window == {tuple(r) for r in histograms.array_quantiles(df, ["k"], "bin", asked).collect()} and len(window) == 30


@pytest.mark.parametrize("q", [-0.1, 1.1])
def test_quantiles_outside_the_range_are_refused(spark, q):
    with pytest.raises(ValueError):
        histograms.summarise(hist(spark, {1: 1}), ["k"], "bin", {"q": q})


def test_convolution(spark):
    out = histograms.convolve(hist(spark, {0: 1, 1: 2}), hist(spark, {0: 3, 1: 4, 2: 5}), ["k"], "bin", 5)
    assert {b: int(n) for b, n in as_dict(out, "bin", "n").items()} == {0: 3, 1: 10, 2: 13, 3: 10}
    over = histograms.convolve(hist(spark, {4: 1}), hist(spark, {4: 1}), ["k"], "bin", 5)
    assert {b: int(n) for b, n in as_dict(over, "bin", "n").items()} == {5: 1}


def test_convolution_commutes_and_survives_huge_counts(spark):
    a, b = hist(spark, {1: 9_000_000_000_000, 3: 7}), hist(spark, {0: 8_000_000_000_000, 170: 5, 179: 1})
    one = as_dict(histograms.convolve(a, b, ["k"]), "bin", "n")
    assert one == as_dict(histograms.convolve(b, a, ["k"]), "bin", "n")
    assert one[1] == 9_000_000_000_000 * 8_000_000_000_000
    assert one[180] == 9_000_000_000_000 + 7


def test_adding_quantiles_overshoots(spark):
    legs = hist(spark, uniform(0, 10))
    row = histograms.shortcut_error(legs, legs, ["k"]).first()
    assert (row.sum_q, row.shortcut_q, row.overshoot) == (16, 18, 2)


def test_uniform_legs(spark):
    one = spark.createDataFrame([("k", 3, 6)], "k string, lo int, hi int")
    assert as_dict(histograms.uniform_leg(one, ["k"], F.col("lo"), F.col("hi")), "bin", "n") == {3: 1, 4: 1, 5: 1, 6: 1}
    waits = spark.createDataFrame([(0.0,), (0.25,), (0.75,), (1.25,), (5.0,)], "m double")
    assert [r.h for r in waits.select(histograms.headway(F.col("m")).alias("h")).collect()] == [1, 1, 2, 2, 10]


def test_pair_of_uniform_legs_equals_their_convolution(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        a, b = rng.randrange(0, 60), rng.randrange(0, 90)
        rows.append((str(k), a, a + rng.randrange(0, 50), b, b + rng.randrange(0, 60)))
    df = spark.createDataFrame(rows, "k string, a int, b int, c int, d int")
    direct = histograms.uniform_pair(df, ["k"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
    long = histograms.convolve(
        histograms.uniform_leg(df, ["k"], F.col("a"), F.col("b")), histograms.uniform_leg(df, ["k"], F.col("c"), F.col("d")), ["k"]
    )
    found = {(r.k, r.bin): int(r.n) for r in direct.collect()}
    assert found == {(r.k, r.bin): int(r.n) for r in long.collect()}


def test_two_grains(spark):
    df = spark.createDataFrame(
        [(1, "am", 5, 2), (1, "pm", 5, 3), (1, "pm", 7, 1)], "o int, block string, bin int, n bigint"
    )
    rows = {(r.grain, r.bin): r.n for r in histograms.two_grains(df, ["o"], "block", "bin").collect()}
    assert rows == {("am", 5): 2, ("pm", 5): 3, ("pm", 7): 1, ("day", 5): 5, ("day", 7): 1}


def reference_quantile(values, q, method):
    ordered = sorted(values)
    position = q * (len(ordered) - 1)
    low = int(position)
    if method == LOWER or low == position:
        return ordered[low]
    return ordered[low] * (1 - (position - low)) + ordered[low + 1] * (position - low)


def test_exact_quantiles_against_sorting(spark):
    rng = random.Random(11)
    groups = {
        "hot": [rng.choice([rng.gauss(50, 20), 50.0]) for _ in range(3000)],
        "copies": [7.0] * 500,
        "one": [-3.5],
        "two": [1.0, 2.0],
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(300)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = exact_quantiles(
        df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": (0.1, LOWER), "d": (1.0, LOWER), "e": 0.0}, F.floor(F.col("v") / F.lit(3.0))
    )
    rows = {r.k: r for r in found.collect()}
    assert set(rows) == set(groups)
    for k, values in groups.items():
        assert rows[k].n == len(values)
        for name, q, method in (("a", 0.5, None), ("b", 0.9, None), ("c", 0.1, LOWER), ("d", 1.0, LOWER), ("e", 0.0, None)):
            assert rows[k][name] == pytest.approx(reference_quantile(values, q, method), abs=1e-9), (k, name)


def test_weighted_quantiles_equal_repeated_rows(spark):
    weighted = spark.createDataFrame([("k", 1.0, 3), ("k", 9.0, 1), ("k", 4.0, 2)], "k string, v double, w bigint")
    row = exact_quantiles(weighted, ["k"], "v", {"m": 0.5}, F.floor("v"), weight="w").first()
    assert (row.n, row.m) == (6, 2.5)
