"""Histograms kept up to date from a file stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.histograms import count_bins


def run_histogram(
    stream: DataFrame,
    binned: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    bin_col: str,
    out: str,
    checkpoint: str,
) -> None:
    """Count each micro-batch and store its counts under its batch id.

    Histograms merge by addition, so no state is kept between batches. A batch that
    is run again after a failure replaces its own folder and cannot count twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        count_bins(binned(batch), keys, bin_col).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _folders(spark: SparkSession, out: str) -> dict[tuple[int, int], str]:
    """Complete folders by the first and last batch they hold: single batches, merged spans, and all up to one."""
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs, {}
    for kind in ("batch_id", "span", "upto"):
        pattern = hadoop.Path(f"{out}/{kind}=*/_SUCCESS")
        files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.globStatus(pattern) or []:
            path = status.getPath().getParent().toString()
            first, _, last = path.rpartition("=")[2].rpartition("-")
            found[int(first or last) if kind != "upto" else 0, int(last)] = path
    return found


def _cover(folders: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The widest folders that hold every batch once; folders nest or lie apart."""
    chosen: list[tuple[int, int]] = []
    for first, last in sorted(folders, key=lambda f: (f[0], -f[1])):
        if not chosen or first > chosen[-1][1]:
            chosen.append((first, last))
    return chosen


def _current(spark: SparkSession, out: str) -> list[str]:
    """What counts."""
    found = _folders(spark, out)
    return [found[f] for f in _cover(found)]


def read_histogram(spark: SparkSession, keys: Sequence[str], bin_col: str, out: str, schema: str | None = None) -> DataFrame:
    """The sum of all batches stored so far; before the first, an empty table of ``schema``."""
    paths = _current(spark, out)
    stored = spark.read.parquet(*paths) if paths or schema is None else spark.createDataFrame([], schema)
    return stored.groupBy(*keys, bin_col).agg(F.sum("n").alias("n"))


def _sum_of(spark: SparkSession, keys: Sequence[str], bin_col: str, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths).groupBy(*keys, bin_col).agg(F.sum("n").alias("n"))


def merge_tiers(spark: SparkSession, keys: Sequence[str], bin_col: str, out: str, fan: int = 10) -> None:
    """Merges ``fan`` folders in a row into one, and ``fan`` of those again, while the stream and readers go on.

    A span is named after the batches it holds and counts from the moment it is complete;
    what it holds stays in place, so a reader that has begun finishes on what it saw.
    Every batch is written once per tier. ``sweep`` deletes what has been merged.
    """
    if fan < 2:
        raise ValueError("a tier merges two folders at least")
    found, width = _folders(spark, out), fan
    newest = max((last for _, last in found), default=-1)
    while width <= newest + 1:
        for first in range(0, newest + 2 - width, width):
            inner = [f for f in _cover(found) if first <= f[0] and f[1] < first + width]
            held = sum(last - start + 1 for start, last in inner)
            if len(inner) > 1 and held == width:
                path = f"{out}/span={first}-{first + width - 1}"
                _sum_of(spark, keys, bin_col, [found[f] for f in inner]).write.mode("overwrite").parquet(path)
                found[first, first + width - 1] = path
        width *= fan


def sweep(spark: SparkSession, out: str) -> None:
    """Deletes folders that a wider one holds; run it when no reader from before the merge is left."""
    found = _folders(spark, out)
    _delete(spark, [path for f, path in found.items() if f not in _cover(found)])


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        old = hadoop.Path(path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def compact(spark: SparkSession, keys: Sequence[str], bin_col: str, out: str) -> None:
    """Merges all stored batches into one folder at once and deletes them; run it while nothing reads or writes."""
    found = _folders(spark, out)
    cover = _cover(found)
    if len(cover) < 2:
        return
    last = cover[-1][1]
    _sum_of(spark, keys, bin_col, [found[f] for f in cover]).write.mode("overwrite").parquet(f"{out}/upto={last}")
    _delete(spark, [path for path in found.values() if not path.endswith(f"/upto={last}")])


def run_daily_totals(stream: DataFrame, ts: str, keys: Sequence[str], out: str, checkpoint: str) -> None:
    """Counts per ``day`` of event time, complete after every run: late rows add to their day.

    Read with ``read_histogram(spark, keys, "day", out)``.
    """
    run_histogram(stream, lambda batch: batch.select(*keys, F.date_format(ts, "yyyy-MM-dd").alias("day")), keys, "day", out, checkpoint)


def run_daily_counts(stream: DataFrame, ts: str, keys: Sequence[str], out: str, checkpoint: str, delay: str = "1 day") -> None:
    """The same with state and a watermark: a day is written once, when the watermark has passed its end.

    Days still open when the stream ends are not written; rows later than ``delay`` are dropped.
    """
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    days = (
        timed.groupBy(F.window("_at", "1 day").alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), *keys, "n")
    )
    query = (
        days.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
