"""Records a reader cannot use: kept apart with the reason, from the same scan as the others.

A reader names its faults as conditions on the raw record; the first that holds is the record's
reason. Readers take what has none. ``sift`` writes both sides in one pass, so what a source
lost can be looked up by source and reason beside what it gave.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

REASON = "_reason"

QUARANTINED = "source string, reason string, record string"


def judged(rows: DataFrame, faults: Mapping[str, Column]) -> DataFrame:
    """The rows with their reason: the first fault that holds, NULL for a usable record."""
    held = [F.when(F.coalesce(fault, F.lit(False)), F.lit(reason)) for reason, fault in faults.items()]
    return rows.withColumn(REASON, F.coalesce(*held, F.lit(None).cast("string")))


def usable(judged: DataFrame) -> DataFrame:
    return judged.where(F.col(REASON).isNull()).drop(REASON)


def quarantined(judged: DataFrame, source: str) -> DataFrame:
    """``source, reason, record`` (the raw record as JSON) of what cannot be used."""
    record = F.to_json(F.struct(*[c for c in judged.columns if c != REASON]))
    return judged.where(F.col(REASON).isNotNull()).select(F.lit(source).alias("source"), F.col(REASON).alias("reason"), record.alias("record"))


def counts(judged: DataFrame, source: str) -> DataFrame:
    """``source, reason, n``; usable records count under the reason ``kept``."""
    reason = F.coalesce(F.col(REASON), F.lit("kept")).alias("reason")
    return judged.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "reason", "n")


def sift(judged: DataFrame, source: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Writes the judged rows once under ``out`` and returns the usable ones and the quarantine."""
    spark, columns = judged.sparkSession, judged.columns
    judged.withColumn("kept", F.col(REASON).isNull()).write.mode("overwrite").partitionBy("kept").parquet(out)
    stored = spark.read.schema(StructType([*judged.schema, StructField("kept", BooleanType())])).parquet(out)
    return stored.where("kept").select(*columns).drop(REASON), quarantined(stored.where("not kept").select(*columns), source)
