"""Line dedup: later repeats of line runs of ``min_words`` words or more are deleted.

A line goes if it lies in a run of consecutive lines with at least ``min_words`` words that
occurs earlier in the corpus (order: id, then file position, then line; runs may overlap).
The first copy of every line stays, whatever happens to later ones.

Method. From each line on, the shortest run that reaches ``min_words`` is a window, and so is
the shortest run up to each line. The line of the smallest hash in a window is its
fingerprint. Where lines repeat, windows repeat, and so do their fingerprints: any repeated
run that is long enough shares one. Fingerprints are counted first; only windows whose
fingerprint is found at two places or more are joined by their whole content with the
window's first place. A match grows forwards by the windows that start in it and backwards
by those that end in it, as long as each is itself a repeat; merged, these are exactly the
longest repeated runs. No pairs of copies are made: every later copy meets the first only.

Windows are compared by 128 bits of hashes of their lines. Nulls: a null or empty text stays
as it is; rows with null id come last. Repeated rows are documents of their own, so all but
the first lose their long runs. A text that loses all lines becomes empty. An empty table
gives no rows. All columns are kept, but one named ``removed_lines`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import let
from tidemark.llm.rows import WORD, checkpointed, small, with_row
from tidemark.session import ship_package

MIN_WORDS = 50

#: Odd, so that powers can be undone modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def _sums(hashes: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum(hashes * _powers(_BASE, len(hashes))[:-1], dtype=np.uint64))


def line_windows(h1: np.ndarray, h2: np.ndarray, words: np.ndarray, offsets: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """All windows of a batch of texts whose lines stand one after the other.

    ``offsets``: where each text begins, and the end. Places are counted over the batch.
    """
    lines = len(h1)
    total = np.append(0, np.cumsum(words, dtype=np.int64))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    here = np.arange(lines)
    ends = np.searchsorted(total, total[:-1] + min_words, "left")
    forward = ends <= offsets[owner + 1]
    starts = np.searchsorted(total, total[1:] - min_words, "right") - 1
    backward = (starts >= offsets[owner]) & (total[1:] >= min_words)
    pairs = np.unique(
        np.concatenate([np.column_stack([here, ends])[forward], np.column_stack([starts, here + 1])[backward]]).reshape(-1, 2), axis=0
    )
    start, end = pairs[:, 0], pairs[:, 1]
    out = {"owner": owner[start], "start": start, "end": end}
    if not len(start):
        return out | {"anchor": h1[:0], "first": np.zeros(0, bool), "w1": h1[:0], "w2": h1[:0]}
    unsigned = h1.view(np.uint64)
    least = np.minimum.reduceat(np.append(unsigned, np.uint64(0xFFFFFFFFFFFFFFFF)), pairs.ravel())[::2]
    values, rank = np.unique(unsigned, return_inverse=True)
    places = np.sort(rank * lines + here)
    chosen = places[np.searchsorted(places, np.searchsorted(values, least) * lines + start)] % lines
    first = np.zeros(len(start), bool)
    first[np.unique(chosen, return_index=True)[1]] = True
    back = _powers(_BASE_BACK, lines)
    for name, hashes in (("w1", unsigned), ("w2", h2.view(np.uint64))):
        sums = _sums(hashes)
        out[name] = (((sums[end] - sums[start]) * back[start]) * np.uint64(_BASE) + (end - start).astype(np.uint64)).view(np.int64)
    return out | {"anchor": least.view(np.int64), "first": first}


def _windows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """A row per window: ``_key``, ``_row``, lines ``start`` to ``end``, ``anchor`` and content hashes."""
    lines = F.split(F.col(text), "\n", -1)
    hashed = docs.where(F.length(text) > 0).select(
        F.col(key).alias("_key"),
        "_row",
        F.transform(lines, lambda x: F.xxhash64(x)).alias("h1"),
        F.transform(lines, lambda x: F.xxhash64(x, F.lit(1))).alias("h2"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, words = (batch.column(i) for i in (2, 3, 4))
            offsets = np.append(0, np.cumsum(np.diff(h1.offsets.to_numpy())))
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (h1, h2, words)]
            w = line_windows(*flat, offsets, min_words)
            base = offsets[w["owner"]]
            owner = pa.array(w["owner"])
            columns = [(w["start"] - base).astype(np.int32), (w["end"] - base).astype(np.int32), w["anchor"], w["first"], w["w1"], w["w2"]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *map(pa.array, columns)], names=schema.names)

    found = {"start": "int", "end": "int", "anchor": "long", "first": "boolean", "w1": "long", "w2": "long"}
    schema = hashed.select("_key", "_row", *(F.lit(None).cast(kind).alias(name) for name, kind in found.items())).schema
    return hashed.mapInArrow(run, schema)


def _merge(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Bounds s0, e0, s1, e1, ... of the disjoint runs that the given runs make together."""
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order])
    opens = np.nonzero(np.append(True, s[1:] > reach[:-1]))[0]
    return np.column_stack([s[opens], reach[np.append(opens[1:], len(s)) - 1]]).ravel()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` and ``runs`` (bounds of the lines to delete) of each text with repeats; ``docs`` has ``_row``."""

    @F.pandas_udf("array<int>")
    def merged(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_merge(s, e) for s, e in zip(starts, ends, strict=True)])

    ship_package(docs.sparkSession)
    windows = _windows(docs, key, text, min_words)
    shared = checkpointed(windows.where("first").groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"))
    met = checkpointed(windows.join(small(shared), "anchor").select("_key", "_row", "start", "end", "w1", "w2"))
    place = F.struct(F.col("_key").isNull().alias("_no_key"), "_key", "_row", "start")
    firsts = met.groupBy("w1", "w2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = checkpointed(firsts.select("w1", "w2", F.col("_first._row").alias("_first_row"), F.col("_first.start").alias("_first_start")))
    later = met.join(firsts, ["w1", "w2"]).where((F.col("_row") != F.col("_first_row")) | (F.col("start") != F.col("_first_start")))
    runs = later.groupBy("_row").agg(F.collect_list("start").alias("_s"), F.collect_list("end").alias("_e"))
    return runs.select("_row", merged("_s", "_e").alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeats deleted from ``text``, then ``removed_lines``: bounds of the deleted runs, or null."""
    rows = with_row(docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text")))
    runs = repeated_runs(rows, min_words, "_key", "_text")
    lines = F.split("_text", "\n", -1)
    bounds = lambda x: F.concat(F.array(F.lit(0)), F.col("runs"), F.array(F.size(x)))
    pairs = lambda b: F.sequence(F.lit(0), (F.size(b) / 2).cast("int") - 1)
    kept = let(
        lines,
        lambda x: let(
            bounds(x),
            lambda b: F.flatten(F.transform(pairs(b), lambda i: F.slice(x, b[2 * i] + 1, b[2 * i + 1] - b[2 * i]))),
        ),
    )
    new = F.when(F.col("runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(runs, "_row", "left")
    columns = [new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns if c != "removed_lines"]
    return joined.select(*columns, F.col("runs").alias("removed_lines"))
