"""Contiguous shards of nearly equal bytes.

Rows stand in the order of their id. The bytes before each row come from per-range totals
and a running sum inside the range; the shard of a row is where its middle byte falls when
all bytes are cut at equal targets, so no cut is off by more than half a row.

Nulls: a text that is null has no bytes (size 1, checksum 0); rows without id stand first.
Repeated ids and rows are each placed once, in file order. An empty table gives no rows.
Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import text_of, with_row


def byte_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row``, key, ``size`` (bytes plus one), ``text_crc32``, ``shard``, ``slot`` (gapless per shard)."""
    slim = with_row(docs).select(
        "_row",
        F.col(key).alias("_key"),
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
    )
    placed = running_sums(slim, "size", ["_key", "_row"])
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = f"((2 * before + size) * {shards}L) div {2 * total}L"
    cut = placed.withColumn("shard", F.expr(middle).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("position").alias("_first"))  # a row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "_row", F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id", text: str = "text", folder: str = "shard_id") -> None:
    """Whole rows into one folder ``shard_id=k`` each, in slot order within and across its files."""
    places = byte_shards(docs, shards, key, text).select("_row", "shard", "slot")
    rows = with_row(docs.select(F.struct("*").alias("_doc")))
    placed = rows.join(places, "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("_doc.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
