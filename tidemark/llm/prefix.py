"""Running sums over a table of any size, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.rows import checkpointed, small


def running_sums(rows: DataFrame, value: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds ``before`` (sum of ``value`` in earlier rows) and ``position`` (earlier rows), per ``within`` key.

    Rows are dealt into ranges of ``within`` and ``order`` and kept there. Each range is
    summed on its own; only the totals, one row per range and key, are summed across
    ranges. A key with most of the rows takes many ranges. ``order`` must settle all ties
    and ``within`` must not be null.
    """
    within = within or []
    ranged = rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    placed = checkpointed(ranged)
    totals = placed.groupBy(*within, "_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier_parts = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *within,
        "_part",
        F.coalesce(F.sum("_sum").over(earlier_parts), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier_parts), F.lit(0)).alias("_rows_before"),
    )
    local = W.partitionBy(*within, "_part").orderBy(*order)
    return (
        placed.withColumn("_sum_here", F.coalesce(F.sum(value).over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rows_here", F.row_number().over(local) - 1)
        .join(small(starts), [*within, "_part"])
        .withColumn("before", F.col("_sum_before") + F.col("_sum_here"))
        .withColumn("position", F.col("_rows_before") + F.col("_rows_here"))
        .drop("_part", "_sum_before", "_rows_before", "_sum_here", "_rows_here")
    )
