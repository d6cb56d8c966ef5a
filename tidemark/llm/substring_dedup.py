"""Substring dedup: words inside later copies of ``window`` words or more are deleted.

A window is ``window`` consecutive words of one text. A word goes if it lies in a window whose
words also start earlier in the corpus (order: id, then file position, then word; windows may
overlap and are judged on the input, so the first copy of a passage always stays whole).

Method: fixed-block anchors. A block is half a window, ``(window + 1) // 2`` words; wherever a
window lies, it holds a whole block that starts at a multiple of the block's length. These
non-overlapping blocks are the index. Every rolling block of every text probes it. An indexed
block is hit if its words also occur elsewhere, at whatever offset. In both copies of a window
all indexed blocks it holds are hit. Hits are then extended to either side, as far as a window
reaches over hit blocks alone, and compared with all other extended hits by content at once:
the first place of each content is the copy that stays, and what lies later is a repeat. Repeats
that touch merge into the maximal exact repeats of a text. No pairs of copies are made.

Index and probes never travel as rows of their own. Texts form batches of ``BATCH`` rows. A
batch sends each bucket of the hash range one row with its distinct hashes, so a block that a
third of all texts share costs a bucket one entry per batch. The bucket answers each batch with
the batch's own indexed blocks that are hit. The number of buckets follows the number of texts, so that a bucket
holds a few million hashes. Only windows of hit blocks become rows, one per content and batch.

Hits are found by 36 bits or more of a block's hash, which may find too many; repeats are decided
by 96 bits over 64-bit hashes of the words. A batch's texts are in memory together.

Words are ``[^\\x20\\x09-\\x0D]+``. Nulls: a null or empty text has no words; rows with null id
come last. Repeated rows are documents of their own, so all but the first lose what is long
enough. Texts shorter than a window stay. An empty table gives no rows. All columns are kept,
but those named as the added ones (``ADDED``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import checkpointed, released, slices, with_row
from tidemark.session import ship_package

WINDOW = 20

#: Texts of a batch, and texts a bucket is meant for.
BATCH, BUCKET_TEXTS = 512, 4096

ADDED = ("n_words", "n_removed", "removed_words", "kept_text")

#: Bits of a block's hash that tell blocks of one bucket apart; with two flags they fill 32.
_REST = 30

#: Odd, so that powers can be undone modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """64-bit hashes of words; the frequent ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text begins (and the last one ends)."""
    known, parts = _Hashes(), []
    for text in texts:
        parts.append(np.array([known[w] for w in (text or "").encode("utf-8", "replace").split()], np.uint64))
    offsets = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, from running sums of a polynomial modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = lambda b, k: np.cumprod(np.append(np.uint64(1), np.full(k - 1, b, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64))
    value = (sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n)
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def _fits(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each place a run of ``width`` words starts at, and whether it ends inside its text."""
    n = max(0, int(offsets[-1]) - width + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    return owner, np.arange(n) + width <= offsets[owner + 1]


def block_hashes(texts: Iterable[str | None], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the rolling blocks of a batch, sorted, and two flags: 2 indexed, 1 met more than once."""
    block = (window + 1) // 2
    hashes, offsets = word_hashes(texts)
    owner, inside = _fits(offsets, block)
    indexed = (np.arange(len(owner)) - offsets[owner]) % block == 0
    value, indexed = rolling(hashes, block, _BASES[0])[inside], indexed[inside]
    order = np.argsort(value)
    value, indexed = value[order], indexed[order]
    if not len(value):
        return value, np.zeros(0, np.uint32)
    first = np.nonzero(np.append(True, value[1:] != value[:-1]))[0]
    many = np.diff(np.append(first, len(value))) > 1
    return value[first], np.logical_or.reduceat(indexed, first) * np.uint32(2) + many.astype(np.uint32)


def shared_hashes(messages: list[bytes]) -> list[np.ndarray]:
    """Of the indexed blocks of each of a bucket's messages those that occur at a second place."""
    sent = [np.frombuffer(m, np.uint32) for m in messages]
    all_, source = np.concatenate(sent), np.repeat(np.arange(len(sent), dtype=np.int32), [len(s) for s in sent])
    order = np.argsort(all_ >> np.uint32(2), kind="stable")
    value, flags, source = all_[order] >> np.uint32(2), all_[order] & np.uint32(3), source[order]
    first = np.nonzero(np.append(True, value[1:] != value[:-1]))[0]
    counts = np.diff(np.append(first, len(value)))
    hit = np.repeat((counts > 1) | (flags[first] & 1 > 0), counts) & (flags & 2 > 0)
    value, source = value[hit], source[hit]
    order = np.argsort(source, kind="stable")
    return np.split(value[order], np.searchsorted(source[order], np.arange(1, len(sent))))


def hit_windows(texts: list[str | None], shared: np.ndarray, shift: int, window: int) -> dict[str, np.ndarray]:
    """Windows of hit blocks of a batch whose texts are in corpus order.

    ``owner``, ``pos``, ``again`` (starts in a row of windows met earlier in the batch, or 0) and
    ``w1``, ``w2``. Of what the batch has not met earlier each window is listed.
    """
    block = (window + 1) // 2
    hashes, offsets = word_hashes(texts)
    value = rolling(hashes, block, _BASES[0]) >> np.uint64(shift)
    owner, whole = _fits(offsets, block)
    indexed = np.nonzero(whole & ((np.arange(len(owner)) - offsets[owner]) % block == 0))[0]
    missed = np.zeros(len(value) + 1, np.int32)
    missed[indexed + 1] = ~np.isin(value[indexed], shared)
    missed = np.cumsum(missed)
    owner, inside = _fits(offsets, window)
    start = np.nonzero(inside)[0]
    start = start[missed[start + window - block + 1] == missed[start]]
    w1, w2 = rolling(hashes, window, _BASES[0])[start].view(np.int64), (rolling(hashes, window, _BASES[1])[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((start, w2, w1))
    again = np.zeros(len(start), bool)
    if len(start):
        again[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
    later = start[again]
    opens = np.nonzero(np.append(True, (np.diff(later) > 1) | (np.diff(owner[later]) > 0)))[0] if len(later) else np.zeros(0, int)
    places = np.concatenate([start[~again], later[opens]])
    own = owner[places]
    alone = np.zeros(len(opens), np.int32)
    fresh = int((~again).sum())
    return {
        "owner": own,
        "pos": (places - offsets[own]).astype(np.int32),
        "again": np.concatenate([np.zeros(fresh, np.int32), np.diff(np.append(opens, len(later))).astype(np.int32)]),
        "w1": np.concatenate([w1[~again], later[opens]]),
        "w2": np.concatenate([w2[~again], alone]),
    }


def _index(rows: DataFrame, bits: int, window: int) -> DataFrame:
    """``bucket`` and ``hits`` of each batch: the answers of the buckets to the probes of all texts."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    keep = np.uint64((1 << _REST) - 1)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            cuts = np.nonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0))[0] + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                value, flags = block_hashes(batch.column(2).slice(start, end - start).to_pylist(), window)
                rest = ((value >> np.uint64(64 - bits - _REST)) & keep).astype(np.uint32) << np.uint32(2) | flags
                at = [*np.searchsorted(value, edges), len(value)]
                full = [i for i in range(1 << bits) if at[i] < at[i + 1]]
                columns = [
                    pa.array(full, pa.int32()),
                    *(pa.array(np.full(len(full), k[start]), pa.int64()) for k in keys),
                    pa.array([rest[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "file", "batch", "sent"])

    def answer(table: pa.Table) -> pa.Table:
        found = shared_hashes(table.column("sent").to_pylist())
        some = pa.array([len(f) > 0 for f in found])
        out = table.select(["file", "batch", "bucket"]).append_column("hits", pa.array([f.tobytes() for f in found], pa.binary()))
        return out.filter(some)

    sent = rows.select("_file", "_batch", "_text").mapInArrow(send, "bucket int, file long, batch long, sent binary")
    return sent.groupBy("bucket").applyInArrow(answer, "file long, batch long, bucket int, hits binary")


def _windows(rows: DataFrame, places: DataFrame, hits: DataFrame, bits: int, window: int) -> DataFrame:
    """The windows of hit blocks (see ``hit_windows``), with the ``rank`` of their text in place of ``owner``."""
    shift = 64 - bits - _REST

    def extend(texts: pa.Table, told: pa.Table) -> pa.Table:
        rank, shared = {}, [np.zeros(0, np.uint64)]
        for bucket, found, ranks in zip(*(told.column(c).to_pylist() for c in ("bucket", "hits", "ranks")), strict=True):
            if ranks is not None:
                rank |= {r["at"]: r["rank"] for r in ranks}
            else:
                shared.append(np.frombuffer(found, np.uint32).astype(np.uint64) | np.uint64(bucket << _REST))
        own = np.array([rank[at] for at in texts.column("_at").to_pylist()], np.int64)
        order = np.argsort(own)
        found = hit_windows(texts.column("_text").take(pa.array(order)).to_pylist(), np.unique(np.concatenate(shared)), shift, window)
        found["rank"] = own[order][found.pop("owner")]
        return pa.table({c: found[c] for c in ("w1", "w2", "rank", "pos", "again")})

    ranks = places.groupBy("_file", "_batch").agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("position").alias("rank"))).alias("ranks"))
    told = hits.select("file", "batch", "bucket", "hits", F.lit(None).cast(ranks.schema["ranks"].dataType).alias("ranks")).union(
        ranks.select("_file", "_batch", F.lit(None).cast("int"), F.lit(None).cast("binary"), "ranks")
    )
    texts = rows.select("_file", "_batch", "_at", "_text").groupBy("_file", "_batch")
    return texts.cogroup(told.groupBy("file", "batch")).applyInArrow(extend, "w1 long, w2 int, rank long, pos int, again int")


def _merge(starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Bounds s0, e0, s1, e1, ... of the disjoint runs of words under the windows that start at these places."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate((starts + counts - 1 + window)[order])
    opens = np.nonzero(np.append(True, s[1:] > reach[:-1]))[0]
    return np.column_stack([s[opens], reach[np.append(opens[1:], len(s)) - 1]]).ravel()


def _repeated_runs(windows: DataFrame, window: int) -> DataFrame:
    """``rank`` and ``runs`` of the texts that hold windows met earlier."""

    @F.pandas_udf("array<int>")
    def merged(starts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_merge(s, n, window) for s, n in zip(starts, counts, strict=True)])

    sure = F.col("again") > 0
    nth = F.row_number().over(W.partitionBy("w1", "w2", sure).orderBy("rank", "pos"))
    later = windows.withColumn("_nth", nth).where(sure | (F.col("_nth") > 1))
    runs = later.groupBy("rank").agg(F.collect_list("pos").alias("_s"), F.collect_list(F.greatest("again", F.lit(1))).alias("_n"))
    return runs.select("rank", merged("_s", "_n").alias("runs"))


def repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` and ``runs`` (bounds of the words to delete) of each text with repeats; ``docs`` has ``_row``."""
    ship_package(docs.sparkSession)
    at = F.col("_row.at")
    rows = docs.select(
        F.col("_row.file").alias("_file"), F.floor(at / BATCH).alias("_batch"), at.alias("_at"), F.col(key).alias("_key"), F.col(text).alias("_text")
    )
    order = rows.select("_file", "_batch", "_at", "_key", F.col("_key").isNull().alias("_no_key"), F.lit(1).alias("_one"))
    places = running_sums(order, "_one", ["_no_key", "_key", "_file", "_at"]).select("_file", "_batch", "_at", "position")
    places = checkpointed(places)
    bits = max(6, (max(1, places.count()) // BUCKET_TEXTS).bit_length())
    hits = released(_index(rows, bits, window))
    found = released(_repeated_runs(_windows(rows, places, hits, bits, window), window))
    return found.join(places, found["rank"] == places["position"]).select(F.struct(F.col("_file").alias("file"), F.col("_at").alias("at")).alias("_row"), "runs")


def kept_words(text: str | None, runs: Iterable[int] | None) -> tuple[int, int, str]:
    """Number of words, how many of them ``runs`` delete, and the rest joined by one space."""
    words = (text or "").encode("utf-8", "replace").split()
    bounds, n = list(runs or ()), len(words)
    for start, end in reversed(list(zip(bounds[::2], bounds[1::2], strict=True))):
        del words[start:end]
    return n, n - len(words), b" ".join(words).decode()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed_words`` (bounds of deleted runs, or null) and ``kept_text``."""
    rows = with_row(docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text")))
    joined = rows.join(repeats(rows, window, "_key", "_text"), "_row", "left").select("_doc", "_text", F.col("runs").alias("_runs"))
    cut = "n_words long, n_removed long, kept_text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [kept_words(t, r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*made, strict=True) if made else ((), (), ())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=schema.names)

    typed = joined.select("_doc", "_runs", *(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in cut.split(", "))))
    schema = typed.schema
    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in ADDED), "n_words", "n_removed", F.col("_runs").alias("removed_words"), "kept_text")
