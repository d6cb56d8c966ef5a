"""Months: the wanted range, what is stored, and the ingest that adds what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import TOP_DOLLAR, TOP_MINUTE
from tidemark.operators.guards import passed_rows, unit_ratio_report
from tidemark.operators.tripbins import FARE_KEYS, TIME_KEYS, with_bins
from tidemark.sources import manifest
from tidemark.sources.trips import usable_trips

MONTH_KEYS = ["source", "year_month"]
PARTITIONS = ["fact", *MONTH_KEYS]

NO_ROWS = "no usable rows"


def month_range(spark: SparkSession, start: str, end: str | None = None) -> DataFrame:
    """``YYYY-MM`` keys from start to end, both included."""
    first, last = (F.to_date(F.lit(f"{m}-01")) for m in (start, end or start))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return spark.range(1).select(F.explode(months).alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("year_month"))


def spanned_months(rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Every calendar month from the first to the last ``year_month`` of ``rows``, and some around them."""
    day = F.to_date(F.concat("year_month", F.lit("-01")))
    span = rows.agg(F.add_months(F.min(day), -before).alias("_first"), F.add_months(F.max(day), after).alias("_last"))
    months = F.sequence("_first", "_last", F.expr("interval 1 month"))
    return span.where(F.col("_first").isNotNull()).select(F.explode(months).alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("year_month"))


def missing_months(wanted: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    return wanted if force else wanted.join(stored.select("year_month").distinct(), "year_month", "left_anti")


def coverage(
    wanted: DataFrame, stored: DataFrame, available: DataFrame, force: bool = False, unusable: DataFrame | None = None
) -> DataFrame:
    """Every wanted month by name: cached, fetched, without usable rows, or skipped because nobody has it."""
    marks = {"_stored": stored, "_offered": available}
    if unusable is not None:
        marks["_unusable"] = unusable
    marked = wanted
    for name, months in marks.items():
        marked = marked.join(months.select("year_month").distinct().withColumn(name, F.lit(True)), "year_month", "left")
    cached = F.lit(False) if force else F.coalesce("_stored", F.lit(False))
    empty = F.coalesce("_unusable", F.lit(False)) if unusable is not None else F.lit(False)
    status = F.when(cached, "cached").when(empty, NO_ROWS).when(F.col("_offered"), "fetched").otherwise("skipped")
    return marked.select("year_month", status.alias("status"))


def coverage_totals(report: DataFrame) -> DataFrame:
    """Counts by status with the skipped months named; a report has one row per calendar month."""
    return report.groupBy().agg(
        F.count_if(F.col("status") == "fetched").alias("fetched"),
        F.count_if(F.col("status") == "cached").alias("cached"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "skipped", F.col("year_month")))).alias("skipped_months"),
        F.array_sort(F.collect_list(F.when(F.col("status") == NO_ROWS, F.col("year_month")))).alias("empty_months"),
    )


TIME_FACT, FARE_FACT = "time", "fare"


def both_facts(binned: DataFrame) -> DataFrame:
    """Both fact histograms over all months, from one scan and one shuffle."""
    sets = [[*TIME_KEYS, "minutes"], [*FARE_KEYS, "dollars"]]
    fact = F.when(F.grouping("minutes") == 0, TIME_FACT).otherwise(FARE_FACT)
    return binned.groupingSets(sets, *TIME_KEYS, "minutes", "dollars").agg(F.count(F.lit(1)).alias("n"), fact.alias("fact"))


def month_facts(binned: DataFrame) -> DataFrame:
    """Both fact histograms per month from one scan and one shuffle.

    Each trip feeds two grouping sets and is combined with its like on the map side, so
    nothing of trip size is cached, shuffled or read twice.
    """
    sets = [[*MONTH_KEYS, *TIME_KEYS, "minutes"], [*MONTH_KEYS, *FARE_KEYS, "dollars"]]
    fact = F.when(F.grouping("minutes") == 0, TIME_FACT).otherwise(FARE_FACT)
    return binned.groupingSets(sets, *MONTH_KEYS, *TIME_KEYS, "minutes", "dollars").agg(F.count(F.lit(1)).alias("n"), fact.alias("fact"))


def ingest(
    trips: DataFrame,
    wanted: DataFrame,
    airports: Sequence[int],
    out: str,
    force: bool = False,
    top_minute: int = TOP_MINUTE,
    top_dollar: int = TOP_DOLLAR,
) -> DataFrame:
    """Bin the wanted months that are not stored yet into ``out``; what the unit guard said of each.

    The guard reads the trips first; a changed unit stops the run before anything is
    written. A month whose trips cannot be checked is reported as such and not stored;
    ``force`` also takes out what was stored of it. The facts of all months are added as new
    files, and one rename of the manifest makes them count, in place of what they replace:
    a reader sees the state before the run or the one after it, and a run that was cut off
    anywhere is repeated by the next.
    """
    spark = trips.sparkSession
    # A calendar's worth of names; as literals they prune partitions and files.
    todo = [row.year_month for row in missing_months(wanted, stored_months(spark, out), force).collect()]
    months = spark.createDataFrame([(m,) for m in todo], "year_month string")
    if not todo:
        return months.withColumn("status", F.lit("ok"))
    fresh = usable_trips(trips, airports).where(F.col("year_month").isin(*todo))
    checked = passed_rows(unit_ratio_report(fresh, ["year_month"], wanted=months), accepted=("ok", NO_ROWS))
    statuses = {row.year_month: row.status for row in checked}  # a row per wanted month
    good = [m for m, status in statuses.items() if status == "ok"]
    before, lying = _adopted(spark, out), manifest.stored_files(spark, out, PARTITIONS)
    if good:
        (
            month_facts(with_bins(fresh.where(F.col("year_month").isin(*good)), top_minute, top_dollar))
            .select("fact", *MONTH_KEYS, *TIME_KEYS, F.coalesce("minutes", "dollars").alias("bin"), "n")
            .repartition("fact", *MONTH_KEYS)
            .write.mode("append")
            .partitionBy(*PARTITIONS)
            .parquet(out)
        )
    new = manifest.stored_files(spark, out, PARTITIONS) - lying
    _publish(spark, out, before, todo, new)
    return spark.createDataFrame(sorted(statuses.items()), "year_month string, status string")


def _month_of(file: str) -> str:
    return file.rpartition("/")[0].rpartition("=")[2]


def _adopted(spark: SparkSession, out: str) -> manifest.Version:
    """The version that counts; a table stored without one begins with the files that are there."""
    found = manifest.current(spark, out)
    return found or manifest.publish(spark, out, manifest.stored_files(spark, out, PARTITIONS), None)


def _publish(spark: SparkSession, out: str, before: manifest.Version, months: Sequence[str], new: set[str]) -> None:
    """From now on the files of ``new`` count, and of what counted before all but those of the months."""
    stays = {f for f in before.files if _month_of(f) not in months}
    if stays | new != set(before.files):
        manifest.publish(spark, out, stays | new, before)


def _clear(spark: SparkSession, out: str, months: Sequence[str]) -> None:
    """Takes out what is stored of the months."""
    _publish(spark, out, _adopted(spark, out), months, set())


_STORED = "airport bigint, origin bigint, company string, block string, bin int, n bigint, fact string, source string, year_month string"


def _stored(spark: SparkSession, out: str) -> DataFrame:
    """All that counts; ``year_month`` stays text. Empty when nothing is stored there yet.

    A month of which a named file is gone is left out whole.
    """
    version = manifest.current(spark, out)
    if version is not None:
        there = manifest.stored_files(spark, out, PARTITIONS)
        broken = {_month_of(f) for f in version.files if f not in there}
        paths = [f"{out}/{f}" for f in version.files if _month_of(f) not in broken]
        if not paths:
            return spark.createDataFrame([], _STORED)
        return spark.read.schema(_STORED).option("basePath", out).parquet(*paths)
    try:
        return spark.read.schema(_STORED).parquet(out)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def read_fact(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One stored fact; partition pruning reads that fact only."""
    bin_col, keys = ("minutes", TIME_KEYS) if name == TIME_FACT else ("dollars", FARE_KEYS)
    return _stored(spark, out).where(F.col("fact") == name).select(*keys, F.col("bin").alias(bin_col), "n", *MONTH_KEYS)


def stored_months(spark: SparkSession, out: str) -> DataFrame:
    """Months stored with both facts."""
    held = _stored(spark, out).where(F.col("fact").isin(TIME_FACT, FARE_FACT)).groupBy(*MONTH_KEYS).agg(F.countDistinct("fact").alias("facts"))
    return held.where("facts = 2").select("year_month").distinct()


def stored_counts(spark: SparkSession, out: str) -> DataFrame:
    """Bins and trips per stored month of both facts, from one scan."""
    of = lambda name, value: F.when(F.col("fact") == name, value)
    one, n = F.lit(1), F.col("n")
    return _stored(spark, out).groupBy(*MONTH_KEYS).agg(
        F.count(of(TIME_FACT, one)).alias("bins"), F.sum(of(TIME_FACT, n)).alias("trips"),
        F.count(of(FARE_FACT, one)).alias("fare_bins"), F.sum(of(FARE_FACT, n)).alias("fare_trips"),
    )
