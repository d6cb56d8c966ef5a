"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are the lines of a text. A leaf is the SHA-256 of a paragraph. A section ends
after a paragraph whose hash starts with 0, 4, 8 or c (every fourth on average), so an
inserted paragraph moves no other section; a section's hash is that of its leaves, the root
that of the sections. Equal roots mean equal texts; where roots differ, only sections that
differ are opened. Below the leaves, 64-bit hashes of blocks of 32 characters place edits
inside long paragraphs and give the likeness of two texts: twice the shared blocks over
all blocks (distinct ones; 1 for two texts without any).

Nulls: a null text is empty, as one empty paragraph. Everything happens within a row, so
repeated rows and extra columns make no difference; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import let
from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import text_of, with_row

BLOCK = 32


def merkle_tree(text: Column) -> Column:
    """Struct of ``root``, ``sections`` (hash and ``leaves`` of each) and ``blocks``."""
    paragraphs = F.split(text, "\n", -1)
    leaves = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    blocks = F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    return let(
        _sections(leaves),
        lambda s: F.struct(
            F.sha2(F.array_join(F.transform(s, lambda x: x["hash"]), ""), 256).alias("root"),
            s.alias("sections"),
            F.array_distinct(F.transform(blocks, lambda b: F.xxhash64(b))).alias("blocks"),
        ),
    )


def _sections(leaves: Column) -> Column:
    def cut(h: Column) -> Column:
        closing = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.substr(h[i - 1], F.lit(1), F.lit(1)).isin("0", "4", "8", "c"))
        bounds = F.array_distinct(F.array_append(closing, F.size(h)))
        return let(bounds, lambda ends: F.transform(ends, lambda e, j: section(h, F.coalesce(F.get(ends, j - 1), F.lit(0)), e)))

    def section(h: Column, start: Column, end: Column) -> Column:
        return let(F.slice(h, start + 1, end - start), lambda part: F.struct(F.sha2(F.array_join(part, ""), 256).alias("hash"), part.alias("leaves")))

    return let(leaves, cut)


def likeness(a: Column, b: Column) -> Column:
    """Shared blocks of two trees' ``blocks``, from 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a, b)) / both).otherwise(1.0)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Hashes of the paragraphs of tree ``a`` that tree ``b`` lacks; equal roots and sections are not opened."""
    known = F.transform(b["sections"], lambda s: s["hash"])
    other = F.flatten(F.transform(b["sections"], lambda s: s["leaves"]))
    opened = F.filter(a["sections"], lambda s: ~F.array_contains(known, s["hash"]))
    nothing = F.array().cast("array<string>")
    return F.when(a["root"] == b["root"], nothing).otherwise(F.array_except(F.flatten(F.transform(opened, lambda s: s["leaves"])), other))


def tail_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row``, key, ``text`` and ``edited`` with ``next_blocks``, the next document's tree blocks.

    ``edited`` has the last quarter of the code points replaced by the first as many (or all)
    of the next document by key, the first after the last. Which document that is comes from
    the slim table of keys; then only the asked prefix of each text travels to its neighbour.
    """
    texts = with_row(docs).select("_row", text_of(text).alias("text"))
    slim = with_row(docs).select("_row", F.col(key).alias("_key"), F.length(text_of(text)).cast("long").alias("n"))
    placed = running_sums(slim, "n", ["_key", "_row"])
    rows = placed.count()
    following = F.expr(f"(position + 1) % {max(rows, 1)}L")
    takers = placed.select(F.col("_row").alias("_taker"), "_key", F.expr("n div 4").alias("_k"), following.alias("_at"))
    pairs = takers.join(placed.select("_row", F.col("position").alias("_at")), "_at").drop("_at")
    given = texts.join(pairs, "_row").select(
        F.col("_taker").alias("_row"),
        "_key",
        "_k",
        F.substr("text", F.lit(1), F.col("_k").cast("int")).alias("_given"),
        merkle_tree(F.col("text"))["blocks"].alias("next_blocks"),
    )
    kept = F.substr("text", F.lit(1), F.length("text") - F.col("_k").cast("int"))
    return texts.join(given, "_row").select("_row", F.col("_key").alias(key), "text", F.concat(kept, "_given").alias("edited"), "next_blocks")
