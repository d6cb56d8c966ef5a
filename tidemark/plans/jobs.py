"""File-to-file jobs: each reads what the one before it wrote.

Paths may be anything the cluster's file systems understand. Months that nobody
has published yet are named in the coverage report rather than failing the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import AIRPORT_NAMES, COHORT_HOUR
from tidemark.operators.cohort import cohort_medians, cohort_trips
from tidemark.plans import reports as plans
from tidemark.session import fresh_dir
from tidemark.sources import documents, quarantine, reports
from tidemark.sources.months import NO_ROWS, TIME_FACT, coverage, ingest, month_range, read_fact, stored_months
from tidemark.sources.trips import FEEDS, published, read_files

AIRPORT_ZONES = list(AIRPORT_NAMES)


def _months(spark: SparkSession, start: str, end: str | None) -> tuple[DataFrame, list[str]]:
    wanted = month_range(spark, start, end)
    return wanted, [r.year_month for r in wanted.orderBy("year_month").collect()]


def ingest_job(
    spark: SparkSession, feed_name: str, folder: str, facts: str, start: str, end: str | None = None, force: bool = False
) -> DataFrame:
    """Store the wanted months' histograms; returns what happened to every month."""
    wanted, names = _months(spark, start, end)
    place = f"{facts}/{feed_name}"
    before = spark.createDataFrame([(r.year_month,) for r in stored_months(spark, place).collect()], "year_month string")
    files = published(spark, FEEDS[feed_name], folder, names)
    offered = spark.createDataFrame([(f.month,) for f in files], "year_month string")
    held = set() if force else {r.year_month for r in before.collect()}
    fresh = [f for f in files if f.month not in held]
    checked = spark.createDataFrame([], "year_month string, status string")
    if fresh:
        checked = ingest(read_files(spark, fresh), spark.createDataFrame([(f.month,) for f in fresh], "year_month string"), AIRPORT_ZONES, place, force)
    return coverage(wanted, before, offered, force, unusable=checked.where(F.col("status") == NO_ROWS))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(documents.ZONE_LINE_SCHEMA).csv(path, header=True, enforceSchema=False)
    return documents.require_rows(documents.typed_zones(_positioned(rows)), "zones")


def car_job(spark: SparkSession, feed_name: str, facts: str, zones: str, out: str) -> None:
    named = read_zones(spark, zones)
    cells = plans.car_report(spark, f"{facts}/{feed_name}", feed_name, named, AIRPORT_ZONES)
    cells.write.mode("overwrite").parquet(f"{out}/cells")
    reports.write_documents(reports.car_documents(spark.read.parquet(f"{out}/cells"), named), f"{out}/documents")
    reports.write_documents(reports.corpus_document(read_fact(spark, f"{facts}/{feed_name}", TIME_FACT).where(F.col("source") == feed_name)), f"{out}/corpus")


def segment_job(spark: SparkSession, datasets: dict[str, str], out: str) -> None:
    """``datasets`` maps each vintage's name to its JSON rows; rows without a time or a clock hour go to ``quarantine``."""
    raw = plans.stack_vintages(
        [spark.read.schema(documents.SEGMENT_SCHEMA).json(path, multiLine=True).withColumn("dataset", F.lit(name)) for name, path in datasets.items()]
    )
    faults = documents.segment_faults() | documents.clock_faults()
    kept, lost = quarantine.sift(quarantine.judged(raw, faults), "segments", fresh_dir(spark, "segments"))
    lost.write.mode("overwrite").parquet(f"{out}/quarantine")
    rows = [documents.typed_segments(kept)]
    legs = plans.leg_table(spark)
    plans.segment_report(plans.stack_vintages(rows), legs).write.mode("overwrite").parquet(f"{out}/legs")
    reports.write_documents(reports.leg_documents(spark.read.parquet(f"{out}/legs"), legs), f"{out}/documents")


def transit_job(spark: SparkSession, routes: str, segments: str, out: str) -> None:
    """``routes`` is a folder of one JSON document per route, named after it."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    docs = spark.read.text(routes, wholetext=True).select(F.url_decode(name).alias("route"), F.col("value").alias("document"))
    ranges = plans.ride_ranges(spark.read.parquet(f"{segments}/legs").where("route_id = 'Q70+'")).drop("route_id")
    links = plans.link_table(spark)
    plans.require_inputs(links, docs, ranges)
    journeys = plans.transit_journeys(documents.route_directions(docs), links, ranges)
    journeys.write.mode("overwrite").parquet(f"{out}/journeys")
    reports.write_documents(reports.journey_documents(spark.read.parquet(f"{out}/journeys"), plans.fare_table(spark)), f"{out}/documents")


def _sifted(spark: SparkSession, rows: DataFrame, faults: dict[str, Column], source: str) -> tuple[DataFrame, DataFrame]:
    return quarantine.sift(quarantine.judged(rows, faults), source, fresh_dir(spark, "sifted"))


def mapping_job(spark: SparkSession, polygons: str, stations: str, out: str, cell: float = 0.02, band: float = 0.002) -> None:
    """Stations placed in zones, stored as one document per zone; unreadable records go to ``<out>_quarantine``."""
    shapes, points = (_sifted(spark, *read) for read in ((_shape_rows(spark, polygons), documents.shape_faults(), "zone shapes"), (_station_rows(spark, stations), documents.station_faults(), "stations")))
    shapes[1].union(points[1]).write.mode("overwrite").parquet(f"{out}_quarantine")
    zones = documents.require_rows(documents.zone_shapes(shapes[0]), "zone shapes")
    points = documents.require_rows(documents.typed_stations(points[0]), "stations")
    reports.write_documents(reports.station_documents(plans.station_mapping(points, zones, cell, band)), out)


def _positioned(rows: DataFrame) -> DataFrame:
    """Rows of a listing with a position that follows its order: by file, then within the file."""
    return rows.withColumn("pos", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def _shape_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("locationid string, zone string, borough string, the_geom string").json(path, multiLine=True)
    return _positioned(rows).withColumnRenamed("zone", "name")


def _station_rows(spark: SparkSession, path: str) -> DataFrame:
    return _positioned(spark.read.schema(documents.STATION_SCHEMA).json(path, multiLine=True))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return documents.require_rows(documents.zone_shapes(_shape_rows(spark, path)), "zone shapes")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return documents.require_rows(documents.typed_stations(_station_rows(spark, path)), "stations")


def comparison_job(spark: SparkSession, car: str, transit: str, mapping: str, zones: str, out: str) -> None:
    """The flagship table and its documents."""
    cells = plans.named_airports(spark.read.parquet(f"{car}/cells"))
    stations = reports.read_station_documents(spark.read.schema("zone bigint, document string").json(mapping))
    table = plans.comparison_report(
        cells, spark.read.parquet(f"{transit}/journeys"), stations, read_zones(spark, zones), plans.fare_table(spark), plans.evidence_table(spark)
    )
    table.write.mode("overwrite").parquet(f"{out}/comparison")
    reports.write_documents(reports.comparison_documents(spark.read.parquet(f"{out}/comparison")), f"{out}/documents")


def cohort_job(
    spark: SparkSession, folder: str, windows: dict[str, tuple[str, str]], airport: int, origins: list[int], out: str, hour: int = COHORT_HOUR
) -> None:
    """Medians of one hour per feed, each over its own window. A feed without trips is left out; none at all is an error."""
    files = [f for name, (start, end) in windows.items() for f in published(spark, FEEDS[name], folder, _months(spark, start, end)[1])]
    if not files:
        raise RuntimeError("none of the wanted months is there")
    cohort_medians(cohort_trips(read_files(spark, files), airport, hour, origins)).write.mode("overwrite").parquet(out)
    found = documents.require_rows(spark.read.parquet(out), "trips of the cohort")
    reports.write_documents(reports.cohort_documents(found), f"{out}_documents")


def map_job(spark: SparkSession, polygons: str, out: str) -> None:
    shapes = read_shapes(spark, polygons)
    outlines, box = plans.map_shapes(shapes)
    outlines.join(shapes.select("pos", "borough"), "pos").write.mode("overwrite").json(f"{out}/zones")
    box.write.mode("overwrite").json(f"{out}/box")
