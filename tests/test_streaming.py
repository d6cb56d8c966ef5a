from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import incremental

START = datetime(2026, 3, 2)
SCHEMA = "ts timestamp_ntz, kind string, value double"


def write_day(spark, folder, day, n):
    rows = [(START + timedelta(days=day, minutes=i), "ab"[i % 2], float(i % 7)) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def binned(batch):
    return batch.select("kind", F.floor("value").cast("int").alias("bin"))


def test_new_files_are_added_and_nothing_is_counted_twice(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        incremental.run_histogram(stream, binned, ["kind"], "bin", out, marks)
        return {(r.kind, r.bin): r.n for r in incremental.read_histogram(spark, ["kind"], "bin", out).collect()}

    def batch():
        return {(r.kind, r.bin): r["count"] for r in binned(spark.read.schema(SCHEMA).parquet(str(source))).groupBy("kind", "bin").count().collect()}

    write_day(spark, source, 0, 50)
    assert run() == batch()
    write_day(spark, source, 1, 31)
    assert run() == batch()
    assert run() == batch()
    incremental.compact(spark, ["kind"], "bin", out)
    incremental.compact(spark, ["kind"], "bin", out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["upto=1"]
    write_day(spark, source, 2, 12)
    assert run() == batch()


def test_nothing_stored_yet(spark, tmp_path):
    empty = incremental.read_histogram(spark, ["kind"], "bin", str(tmp_path / "none"), "kind string, bin int, n bigint")
    assert empty.count() == 0


def test_all_days_with_late_rows(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    for day, n in ((3, 50), (0, 20), (1, 30)):
        write_day(spark, source, day, n)
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        incremental.run_daily_totals(stream, "ts", ["kind"], out, marks)
    rows = incremental.read_histogram(spark, ["kind"], "day", out).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    assert [(r.day, r.n) for r in rows] == [("2026-03-02", 20), ("2026-03-03", 30), ("2026-03-05", 50)]


def test_closed_days_only(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    for day, n in enumerate((20, 30, 40, 50)):
        write_day(spark, source, day, n)
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    incremental.run_daily_counts(stream, "ts", ["kind"], out, marks)
    rows = spark.read.parquet(out).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    assert [(r.day, r.n) for r in rows] == [("2026-03-02", 20), ("2026-03-03", 30)]


def store_batches(spark, out, numbers):
    """Batches as a stream stores them; batch n counts n + 1 for one of three kinds."""
    for n in numbers:
        spark.createDataFrame([("abc"[n % 3], n % 2, n + 1)], "kind string, bin int, n bigint").coalesce(1).write.parquet(f"{out}/batch_id={n}")


def total(df):
    return df.agg(F.sum("n")).first()[0]


def test_a_hundred_batches_are_merged_during_a_read(spark, tmp_path):
    out = str(tmp_path / "out")
    store_batches(spark, out, range(100))
    begun = incremental.read_histogram(spark, ["kind"], "bin", out)
    incremental.merge_tiers(spark, ["kind"], "bin", out, fan=10)
    after = incremental.read_histogram(spark, ["kind"], "bin", out)
    assert total(begun) == total(after) == 5050
    assert len(begun.inputFiles()) == 100 and {f.rpartition("/")[0].rpartition("/")[2] for f in after.inputFiles()} == {"span=0-99"}
    incremental.sweep(spark, out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["span=0-99"]
    store_batches(spark, out, range(100, 112))
    incremental.merge_tiers(spark, ["kind"], "bin", out, fan=10)
    found = incremental.read_histogram(spark, ["kind"], "bin", out)
    assert total(found) == 112 * 113 // 2
    assert sorted({f.rpartition("/")[0].rpartition("/")[2] for f in found.inputFiles()}) == ["batch_id=110", "batch_id=111", "span=0-99", "span=100-109"]


def test_an_unfinished_span_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    store_batches(spark, out, range(4))
    spark.createDataFrame([("a", 0, 999)], "kind string, bin int, n bigint").write.parquet(f"{out}/span=0-3")
    (tmp_path / "out" / "span=0-3" / "_SUCCESS").unlink()
    assert total(incremental.read_histogram(spark, ["kind"], "bin", out)) == 10
    incremental.merge_tiers(spark, ["kind"], "bin", out, fan=2)
    assert total(incremental.read_histogram(spark, ["kind"], "bin", out)) == 10
    incremental.compact(spark, ["kind"], "bin", out)
    assert total(incremental.read_histogram(spark, ["kind"], "bin", out)) == 10


def test_a_row_later_than_the_delay_is_dropped(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        incremental.run_daily_counts(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", ["kind"], out, marks)
        rows = spark.read.parquet(out).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
        return [(r.day, r.n) for r in rows]

    write_day(spark, source, 0, 20)
    write_day(spark, source, 1, 30)
    run()
    write_day(spark, source, 1, 4)  # late, but its day is open
    write_day(spark, source, 6, 50)
    assert run() == [("2026-03-02", 20), ("2026-03-03", 34)]
    write_day(spark, source, 1, 7)  # its day is closed
    write_day(spark, source, 9, 8)
    assert run() == [("2026-03-02", 20), ("2026-03-03", 34), ("2026-03-08", 50)]
