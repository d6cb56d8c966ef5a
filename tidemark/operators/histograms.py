"""Histogram algebra on the long form ``(keys..., bin, n)``.

A histogram is a table: one row per key and non-empty bin. Counting combines on
the map side, so a hot key reaches the shuffle as at most one row per bin and
task. Everything downstream of the count works on at most ``top + 1`` rows per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import TOP_MINUTE, WHOLE_DAY
from tidemark.functions.binarrays import convolved

WEIGHT = "decimal(38,0)"


def count_bins(df: DataFrame, keys: Sequence[str], bin_col: str) -> DataFrame:
    return df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("n"))


def from_samples(df: DataFrame, keys: Sequence[str], value: str, top: int = TOP_MINUTE, bin_col: str = "bin") -> DataFrame:
    """Counts of truncated samples; the query fails on a sample that truncates below zero."""
    whole = F.col(value).cast("double").cast("bigint")
    problem = F.concat(F.lit("negative duration: "), F.col(value).cast("string"))
    checked = F.when(whole < 0, F.raise_error(problem)).otherwise(F.least(whole, F.lit(top)).cast("int"))
    return count_bins(df.select(*keys, checked.alias(bin_col)), keys, bin_col)


def merge(hists: Sequence[DataFrame], keys: Sequence[str], bin_col: str) -> DataFrame:
    """Sum of histograms of the same thing."""
    columns = [*keys, bin_col, "n"]
    stacked = reduce(DataFrame.unionByName, [h.select(*columns) for h in hists])
    return stacked.groupBy(*keys, bin_col).agg(F.sum("n").alias("n"))


def two_grains(hist: DataFrame, keys: Sequence[str], block: str, bin_col: str, grain: str = "grain") -> DataFrame:
    """Per-block and whole-day histograms from one pass over the counts."""
    sets = [[*keys, block, bin_col], [*keys, bin_col]]
    rolled = hist.groupingSets(sets, *keys, block, bin_col).agg(
        F.sum("n").alias("n"), F.grouping(block).alias("_rolled")
    )
    label = F.when(F.col("_rolled") == 1, F.lit(WHOLE_DAY)).otherwise(F.col(block))
    return rolled.select(*keys, label.alias(grain), bin_col, "n")


def densify(hist: DataFrame, keys: Sequence[str], bin_col: str, top: int) -> DataFrame:
    """One row per bin 0..top and key, empty bins as 0. A key gathers at most top + 1 entries."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(bin_col).cast("int"), F.col("n"))))
    return (
        hist.groupBy(*keys)
        .agg(entries.alias("_counts"))
        .select(*keys, "_counts", F.explode(F.sequence(F.lit(0), F.lit(top))).alias(bin_col))
        .select(*keys, bin_col, F.coalesce(F.try_element_at("_counts", F.col(bin_col)), F.lit(0)).alias("n"))
    )


def totals(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hist.groupBy(*keys).agg(F.sum("n").alias("n"))


def first_reaching(bin_col: str, seen: Column, total: Column, q: float) -> Column:
    """Aggregate: lowest bin whose running count reaches q of the total; q = 0 is bin 0."""
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile out of range: {q}")
    if q == 0.0:
        return F.lit(0)
    reached = seen.cast("double") >= total.cast("double") * F.lit(float(q))
    return F.min(F.when(reached, F.col(bin_col)))


def summarise(
    hist: DataFrame, keys: Sequence[str], bin_col: str, quantiles: Mapping[str, float], mean: str | None = None
) -> DataFrame:
    """Total, quantiles and optionally the mean of every key's histogram.

    The running count and the aggregate share one partitioning, so this costs one
    shuffle of the (small) histogram.
    """
    by_bin = Window.partitionBy(*keys).orderBy(bin_col)
    running = by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = hist.select(*keys, bin_col, "n", F.sum("n").over(running).alias("_seen"), F.sum("n").over(whole).alias("_all"))
    found = [
        first_reaching(bin_col, F.col("_seen"), F.col("_all"), q).cast("int").alias(name)
        for name, q in quantiles.items()
    ]
    if mean:
        weighted = F.sum(F.col(bin_col) * F.col("n")).cast("double") / F.sum("n").cast("double")
        found.append(weighted.alias(mean))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *found)


def array_quantiles(hist: DataFrame, keys: Sequence[str], bin_col: str, quantiles: Mapping[str, float]) -> DataFrame:
    """The same quantiles from one array of (bin, n) per key, without a window.

    Takes a histogram with one row per key and bin, so an array has at most top + 1 entries.
    """
    packed = hist.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(bin_col).alias("bin"), F.col("n")))).alias("_bins"), F.sum("n").alias("n")
    )

    def reached(q: float) -> Column:
        target = F.lit(float(q)) * F.col("n").cast("double")

        def step(state: Column, entry: Column) -> Column:
            seen = state["seen"] + entry["n"]
            here = F.when(seen.cast("double") >= target, entry["bin"])
            return F.struct(seen.alias("seen"), F.coalesce(state["at"], here).alias("at"))

        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at"))
        return F.aggregate("_bins", start, step, lambda state: state["at"])

    return packed.select(*keys, "n", *[reached(q).alias(name) for name, q in quantiles.items()])


def packed(hist: DataFrame, keys: Sequence[str], bin_col: str, top: int, name: str) -> DataFrame:
    """One row per key with its histogram as a dense array ``name`` of ``top + 1`` wide counts."""
    capped = F.least(F.col(bin_col).cast("int"), F.lit(top))
    counts = hist.groupBy(*keys, capped.alias("_bin")).agg(F.sum(F.col("n").cast(WEIGHT)).cast(WEIGHT).alias("_n"))
    entries = F.map_from_entries(F.collect_list(F.struct("_bin", "_n")))
    zero = F.lit(0).cast(WEIGHT)
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(top)), lambda i: F.coalesce(F.try_element_at(m, i), zero))
    return counts.groupBy(*keys).agg(entries.alias("_m")).select(*keys, dense(F.col("_m")).alias(name))


def unpacked(rows: DataFrame, keys: Sequence[str], counts: Column, bin_col: str) -> DataFrame:
    """The long form of histograms held as dense arrays, without empty bins."""
    return rows.select(*keys, F.posexplode(counts).alias(bin_col, "n")).where("n > 0")


def convolve(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_col: str = "bin", top: int = TOP_MINUTE) -> DataFrame:
    """Distribution of the sum of two independent legs, overflow in the top bin.

    Each side becomes one array of ``top + 1`` counts per key, and the sum is worked out inside
    the row where the two meet: no pair of bins is ever a row. Weights are wide decimals, as
    products of counts outgrow bigint.
    """
    both = packed(left, keys, bin_col, top, "_left").join(packed(right, keys, bin_col, top, "_right"), list(keys))
    return unpacked(both, keys, convolved(F.col("_left"), F.col("_right"), WEIGHT), bin_col)


def convolve_uniform(
    left: DataFrame, legs: DataFrame, keys: Sequence[str], low: Column, high: Column, bin_col: str = "bin", top: int = TOP_MINUTE
) -> DataFrame:
    """The same where the second leg takes each minute ``low``..``high`` of ``legs`` (one row per key) once.

    A bin of the first leg adds its count from bin + low on and takes it back after
    bin + high, so the sum is a running total over those steps: linear in the bins,
    and no pair of bins is made.
    """
    n = F.col("n").cast(WEIGHT)
    begins = F.struct((F.col(bin_col) + F.col("_low")).alias("at"), n.alias("step"))
    stops = F.struct((F.col(bin_col) + F.col("_high") + 1).alias("at"), (-n).cast(WEIGHT).alias("step"))
    ranges = legs.select(*keys, low.cast("int").alias("_low"), high.cast("int").alias("_high")).where("_high >= _low")
    steps = left.join(ranges, list(keys)).select(*keys, F.explode(F.array(begins, stops)).alias("_s")).select(*keys, "_s.*")
    by_place = Window.partitionBy(*keys).orderBy("at")
    level = F.sum("step").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(WEIGHT)
    runs = (
        steps.groupBy(*keys, "at").agg(F.sum("step").cast(WEIGHT).alias("step"))
        .select(*keys, "at", level.alias("_level"), F.lead("at").over(by_place).alias("_next"))
        .where("_level > 0")
    )
    last = F.least(F.col("_next"), F.lit(top))
    single = F.when(F.col("at") < top, F.transform(F.sequence("at", last - 1), lambda t: F.struct(t.alias("bin"), F.col("_level").alias("n"))))
    past = (F.col("_level") * (F.col("_next") - F.greatest("at", F.lit(top)))).cast(WEIGHT)
    over = F.when(F.col("_next") > top, F.array(F.struct(F.lit(top).alias("bin"), past.alias("n"))))
    none = F.array().cast(f"array<struct<bin:int,n:{WEIGHT}>>")
    pieces = F.concat(F.coalesce(single, none), F.coalesce(over, none))
    return (
        runs.select(*keys, F.explode(pieces).alias("_p"))
        .groupBy(*keys, F.col("_p.bin").alias(bin_col))
        .agg(F.sum("_p.n").cast(WEIGHT).alias("n"))
    )


def uniform_leg(df: DataFrame, keys: Sequence[str], low: Column, high: Column, bin_col: str = "bin", top: int = TOP_MINUTE) -> DataFrame:
    """One observation per minute low..high of every row; ``df`` has one row per key."""
    minutes = F.explode(F.sequence(low.cast("int"), high.cast("int")))
    spread = df.select(*keys, minutes.alias("_minute"))
    return count_bins(spread.select(*keys, F.least("_minute", F.lit(top)).alias(bin_col)), keys, bin_col)


def uniform_pair(
    df: DataFrame,
    keys: Sequence[str],
    first: tuple[Column, Column],
    second: tuple[Column, Column],
    bin_col: str = "bin",
    top: int = TOP_MINUTE,
) -> DataFrame:
    """Two uniform legs convolved in closed form: each sum's count is the overlap of two ranges.

    ``df`` has one row per key; no pair of minutes is ever made.
    """
    (a_low, a_high), (b_low, b_high) = first, second
    total = F.col("_t")
    ways = F.least(a_high, total - b_low) - F.greatest(a_low, total - b_high) + 1
    sums = df.withColumn("_t", F.explode(F.sequence((a_low + b_low).cast("int"), (a_high + b_high).cast("int"))))
    return (
        sums.select(*keys, F.least(total, F.lit(top)).alias(bin_col), ways.cast("bigint").alias("n"))
        .groupBy(*keys, bin_col)
        .agg(F.sum("n").alias("n"))
    )


def headway(median_wait: Column) -> Column:
    """Whole minutes between departures implied by a median wait, at least 1."""
    return F.greatest(F.lit(1), F.rint(median_wait * F.lit(2.0)).cast("int"))


def shortcut_error(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bin_col: str = "bin",
    q: float = 0.9,
    top: int = TOP_MINUTE,
    summed: DataFrame | None = None,
) -> DataFrame:
    """How far adding two quantiles overshoots the quantile of the summed legs.

    ``summed`` is their convolution, where the caller has a cheaper one.
    """
    a = summarise(left, keys, bin_col, {"left_q": q}).drop("n")
    b = summarise(right, keys, bin_col, {"right_q": q}).drop("n")
    c = summarise(convolve(left, right, keys, bin_col, top) if summed is None else summed, keys, bin_col, {"sum_q": q}).drop("n")
    return (
        a.join(b, list(keys)).join(c, list(keys))
        .withColumn("shortcut_q", F.col("left_q") + F.col("right_q"))
        .withColumn("overshoot", F.col("shortcut_q") - F.col("sum_q"))
    )
