"""From raw documents to tokens: five stages, each one operator of ``tidemark.llm``.

Every stage takes the documents its predecessor kept, as a written table, and returns a
table of the same columns; the last returns tokens. Rows with nulls, empty tables and extra
columns pass through as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, line_dedup, mixing, near_copies
from tidemark.llm.rows import with_row
from tidemark.session import staged

#: Least cosine with the nearest language, by the letters of a text's distinct words. A text of another
#: language has a cosine spread by chance around 0 with deviation 1/sqrt(512) = 0.044, and above that what
#: letter threes it shares. Fewer letters tell less; texts with under 64 are kept. All labelled rows lie above.
LEAST_SCORES = [(256, 0.25), (64, 0.15)]

WEIGHTS, CAP = [5, 2, 1], 3.0


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that are near no language. Learns from labelled rows."""
    known = language.profile(docs.select("text", "lang"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = language.identify(docs.select(rest.alias("_doc"), F.col("text").alias("_text")), known, text="_text")
    letters = F.length(F.array_join(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+")), ""))
    least = F.coalesce(*(F.when(letters >= n, score) for n, score in LEAST_SCORES), F.lit(0.0))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(
        *((F.col("_text") if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns)
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of line runs; a document that consists of repeats goes. ``n_chars`` follows."""
    left = line_dedup.dedup_lines(docs.select(F.struct("*").alias("_doc"), "doc_id", "text"))
    stays = left.where(F.col("removed_lines").isNull() | (F.length("text") > 0))
    n_chars = F.when(F.col("removed_lines").isNull(), F.col("_doc.n_chars")).otherwise(F.length("text"))
    new = {"text": F.col("text"), "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return stays.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays."""
    rows = with_row(docs.select(F.struct("*").alias("_doc"), "doc_id", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    found = near_copies.groups(rows.select(place.alias("_place"), "text"), key="_place")
    stays = found.where(F.col("_place") == F.col("component_id")).select(F.col("_place._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by output shard and in the order of its draws."""
    return mixing.shuffled(mixing.mixed(docs, WEIGHTS, cap=CAP)).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, packed ``ids`` and what they decode to."""
    import public_tokenizers

    automaton = bpe.spread(spark, bpe.load_automaton(public_tokenizers.path("word_bpe_49k.json")))
    return bpe.encode_and_back(docs.select("doc_id", "lang", "source", "text"), automaton).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Fingerprints, language profiles and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
