"""Small helpers the operators share: texts, words, row ids, checkpoints and checked broadcasts."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only after a count has shown at most so many rows.
BROADCAST_ROWS = 20_000


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a key that no other row has: the hash of its file's path, and its place in the file.

    The key is the same whenever the table is scanned, however the scan is split and whatever
    executors come or go in between. A frame that is no scan of files has no such place; its
    rows are numbered by partition, which holds while its partitions do, so write it first.
    """
    place = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        return df.withColumn(name, F.struct(place[0].alias("file"), place[1].alias("at")))
    except AnalysisException:
        return df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared checkpoint folder: lineage is cut and lost executors cost nothing.

    The folder is ``spark.checkpoint.dir``; where that is unset, one under the warehouse,
    which all executors reach as well.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and the shuffle files of the steps before it let go.

    Spark deletes the files of a finished step once the driver's JVM has collected what stood
    for it, which a driver that does little else may put off for half an hour. The events of
    the last run hold its plan for a moment, so it is asked more than once.
    """
    kept = checkpointed(df)
    del df
    gc.collect()
    for seconds in (0.2, 0.5, 1.0):
        time.sleep(seconds)
        kept.sparkSession._jvm.System.gc()
    return kept


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into groups of ``rows`` rows, so a worker unpacks few texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; otherwise left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
