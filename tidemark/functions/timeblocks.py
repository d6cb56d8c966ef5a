"""Parts of the day: half-open minute ranges; a boundary belongs to the later block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import TIME_BLOCKS

Blocks = Sequence[tuple[str, int, int]]


def block_names(blocks: Blocks = TIME_BLOCKS) -> list[str]:
    return [name for name, _, _ in blocks]


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def block_of_minute(minute: Column, blocks: Blocks = TIME_BLOCKS) -> Column:
    """NULL when no block covers the minute."""
    (name, start, end), *later = blocks
    arms = F.when((minute >= start) & (minute < end), F.lit(name))
    for name, start, end in later:
        arms = arms.when((minute >= start) & (minute < end), F.lit(name))
    return arms


def block_of(ts: Column, blocks: Blocks = TIME_BLOCKS) -> Column:
    return block_of_minute(minute_of_day(ts), blocks)


def block_of_clock(hour: Column, minute: Column | None = None, blocks: Blocks = TIME_BLOCKS) -> Column:
    """Block of a clock reading; the query fails on a reading no clock shows."""
    minute = F.lit(0) if minute is None else minute
    valid = hour.between(0, 23) & minute.between(0, 59)
    problem = F.concat(F.lit("clock out of range: "), hour.cast("string"), F.lit(":"), minute.cast("string"))
    return F.when(valid, block_of_minute(hour * 60 + minute, blocks)).otherwise(F.raise_error(problem))


def block_position(block: Column, blocks: Blocks = TIME_BLOCKS) -> Column:
    """0-based order of a block within the day."""
    return (F.array_position(F.array(*[F.lit(b) for b in block_names(blocks)]), block) - 1).cast("int")


def is_working_day(ts: Column) -> Column:
    """Monday to Friday (``weekday`` counts Monday as 0)."""
    return F.weekday(ts) < 5


def block_table(spark: SparkSession, blocks: Blocks = TIME_BLOCKS) -> DataFrame:
    rows = [(pos, name, start, end) for pos, (name, start, end) in enumerate(blocks)]
    return spark.createDataFrame(rows, "block_pos int, block string, start_min int, end_min int")


def block_bounds(name: str, blocks: Blocks = TIME_BLOCKS) -> tuple[int, int]:
    for block, start, end in blocks:
        if block == name:
            return start, end
    raise KeyError(name)


def named_bounds(block: Column, blocks: Blocks = TIME_BLOCKS) -> Column:
    """Struct of the first minute of a block and the minute after its last; the query fails on an unknown name."""
    bounds = F.create_map(*[x for name, start, end in blocks for x in (F.lit(name), F.struct(F.lit(start).alias("start_min"), F.lit(end).alias("end_min")))])
    unknown = F.raise_error(F.concat(F.lit("unknown part of the day: "), F.coalesce(block, F.lit("NULL"))))
    return F.coalesce(F.try_element_at(bounds, block), unknown.cast("struct<start_min:int,end_min:int>"))


def tiling_report(table: DataFrame) -> DataFrame:
    """Each block with the block that starts where it ends; the last one wraps to 0."""
    following = table.select(F.col("start_min").alias("_next_start"), F.col("block").alias("next_block"))
    wrapped = F.col("end_min") % 1440
    return (
        table.join(following, wrapped == F.col("_next_start"), "left")
        .select("block_pos", "block", "start_min", "end_min", "next_block", F.col("next_block").isNotNull().alias("tiles"))
    )
