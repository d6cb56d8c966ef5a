"""Histograms as dense arrays inside a row, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.binarrays import first_bins, uniform_sum
from tidemark.operators.histograms import convolve, packed, unpacked


def plain_sum(ranges, top):
    counts = [0] * (top + 1)
    for minutes in itertools.product(*(range(a, b + 1) for a, b in ranges)):
        counts[min(sum(minutes), top)] += 1
    return counts


@pytest.mark.parametrize("ranges, top", [([(0, 5)], 9), ([(2, 4), (0, 7)], 6), ([(0, 3), (1, 2), (0, 9), (4, 4)], 12), ([(3, 2), (0, 4)], 8), ([(20, 25), (0, 1)], 10)])
def test_uniform_sum(spark, ranges, top):
    legs = [(F.lit(a), F.lit(b)) for a, b in ranges]
    assert spark.range(1).select(uniform_sum(legs, top)).first()[0] == plain_sum(ranges, top)


def test_first_bins(spark):
    df = spark.createDataFrame([([0, 2, 0, 3, 5],), ([1, 0, 0, 0, 0],)], "c array<bigint>")
    got = [list(r[0]) for r in df.select(first_bins(F.col("c"), (0.0, 0.2, 0.5, 0.51, 1.0))).collect()]
    assert got == [[0, 1, 3, 4, 4], [0, 0, 0, 0, 0]]
    with pytest.raises(ValueError):
        first_bins(F.col("c"), (1.1,))


def test_convolve_matches_loops_and_outgrows_bigint(spark):
    rng, top = random.Random(3), 15
    sides = [[(k, b, rng.choice([1, 7, 10**18])) for k in ("a", "b") for b in rng.sample(range(30), 9)] for _ in range(2)]
    want = {}
    for (k, i, n), (j, b, m) in itertools.product(*sides):
        if k == j:
            at = (k, min(i + b, top))
            want[at] = want.get(at, 0) + n * m
    left, right = (spark.createDataFrame(s, "k string, bin int, n bigint") for s in sides)
    got = {(r["k"], r["bin"]): int(r["n"]) for r in convolve(left, right, ["k"], "bin", top).collect()}
    assert got == want


def test_a_histogram_survives_packing(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 4, 1), ("b", 9, 2), ("b", 30, 5)], "k string, bin int, n bigint")
    rows = packed(df, ["k"], "bin", 9, "counts")
    assert rows.count() == 2
    assert {(r["k"], r["bin"], int(r["n"])) for r in unpacked(rows, ["k"], F.col("counts"), "bin").collect()} == {("a", 0, 3), ("a", 4, 1), ("b", 9, 7)}
