"""Phrase collocation mining: phrases whose words meet far more often than apart.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. Within a language, f(phrase) counts all its occurrences inside pieces, overlaps
included. A candidate is a phrase of 2 to ``LONGEST`` words with a = f >= ``LEAST``. Cut after its
first k words into parts with counts l and r it scores floor(2000000*a/(l+r)); the cut of the
lowest score counts, the smallest k on ties. A candidate goes if it lies inside a longer
candidate that occurs at least 0.8 times as often; the best ``TOP`` of each language stay.

Method: count streams in prefix and in suffix order. Every word position gives one record, the up
to four words from it on. Records are dealt into ranges of their order, so a range holds
neighbours; sorted, the count of any phrase is the sum over the records that begin with it, so
one pass counts all lengths. Only phrases on the border of a range, and those with ``LEAST``
occurrences, leave it; borders are added up afterwards. The counts are then kept as two
streams, sorted by their words from the first on, and from the last on. Each is read once in
step: the phrases a phrase begins with (or ends with) came just before it and lie on a stack,
so their counts are at hand, and an extension by one word reports its count back to the top of the
stack. What a range needs from the range before is at most three counts, looked up first.
Phrases meet their counts by order alone; there is no table of phrases in memory.

A longer candidate that holds a phrase holds one of one word more as well, which is no rarer, so
extensions by one word decide what goes.

Skew: equal records of a batch are one with a count, so a frequent phrase costs a range one
entry per batch. Ranges follow the number of texts and are cut at equal distances in a sorted
sample of records; the sample decides balance, never results. A batch holds about ``HELD``
records, however long its texts are.

Nulls: a null text has no words, a null language is ``und``. Repeated rows count again. A
text without words, or an empty table, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import checkpointed, slices
from tidemark.session import ship_package

LEAST, LONGEST, TOP = 30, 4, 2000

#: A longer candidate takes a phrase's place from this share of its occurrences on.
COVERED = (80, 100)

#: Texts a range is meant for, records a batch holds.
RANGE_TEXTS, HELD = 1024, 300_000

#: The sample that cuts ranges: so many texts per range, and of those every so manieth record.
SAMPLED_TEXTS, SAMPLED_EVERY = 8, 16

#: Between the words of a record; below all else, so that what begins with a phrase follows it directly.
_GAP = b"\x00"

_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece; NUL and SOH are escaped, as NUL stands between words."""
    data = (text or "").encode("utf-8", "replace").lower().translate(_PIECES)
    if b"\x00" in data or b"\x01" in data:
        data = data.replace(b"\x01", b"\x01\x03").replace(b"\x00", b"\x01\x02")
    for piece in data.split(b"\n"):
        words = piece.split()
        if words:
            yield words


def _plain(record: bytes) -> str:
    """A record as a phrase: words separated by a space, escapes undone."""
    phrase = record.replace(_GAP, b" ")
    if b"\x01" in phrase:
        phrase = phrase.replace(b"\x01\x02", b"\x00").replace(b"\x01\x03", b"\x01")
    return phrase.decode()


def _records(words: list[bytes]) -> list[bytes]:
    return [_GAP.join(words[i : i + LONGEST]) for i in range(len(words))]


def _cuts(docs: DataFrame, ranges: int) -> list[tuple[str, bytes]]:
    """Sorted cuts between ranges: (language, record), at equal distances in a sample; one per range reaches the driver."""
    share = min(1.0, SAMPLED_TEXTS / RANGE_TEXTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(lang, r) for lang, text in told for r in _records([w for p in pieces(text) for w in p])[::SAMPLED_EVERY]]
            langs, records = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(records, pa.binary()), pa.array([1] * len(langs))], names=["lang", "record", "one"])

    sample = docs.sample(share, seed=3).mapInArrow(run, "lang string, record binary, one long")
    placed = checkpointed(running_sums(sample, "one", ["lang", "record"]).select("lang", "record", "position"))
    step = max(1, placed.count() // ranges)
    chosen = placed.where((F.col("position") > 0) & (F.col("position") % step == 0)).select("lang", "record").distinct()
    return sorted((r["lang"], bytes(r["record"])) for r in chosen.collect())


def _sent(docs: DataFrame, shared) -> DataFrame:
    """The records of all texts: sorted, with counts, a row per batch, range and language."""

    def rows(held: dict[str, Counter]) -> pa.RecordBatch:
        out, cuts = [], shared.value
        for lang, counter in held.items():
            records = sorted(counter)
            low = bisect_left(cuts, (lang, b""))
            at = 0
            for part in range(low, len(cuts) + 1):
                end = bisect_left(records, cuts[part][1], at) if part < len(cuts) and cuts[part][0] == lang else len(records)
                if end > at:
                    mine = records[at:end]
                    out.append((part, lang, b"\n".join(mine), np.array([counter[r] for r in mine], np.int32).tobytes()))
                at = end
                if at == len(records):
                    break
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "lang", "records", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for words in pieces(text):
                    held.setdefault(lang, Counter()).update(_records(words))
                    n += len(words)
                    if n >= HELD:
                        yield rows(held)
                        held, n = {}, 0
        yield rows(held)

    return docs.select("_lang", "_text").mapInArrow(run, "part int, lang string, records binary, counts binary")


def prefix_counts(records: pa.Array, weights: np.ndarray, least: int, borders: set[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """Phrase, its number of words and its count in these records, for counts of ``least`` on and for ``borders``."""
    split = pc.split_pattern(records, _GAP)
    offsets, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
    codes, lengths = words.indices.to_numpy().astype(np.int64), np.diff(offsets)
    names = words.dictionary
    matrix = np.zeros((LONGEST, len(lengths)), np.int64)
    for k in range(LONGEST):
        has = lengths > k
        matrix[k, has] = codes[offsets[:-1][has] - offsets[0] + k] + 1
    order = np.lexsort((matrix[2] << 32 | matrix[3], matrix[0] << 32 | matrix[1]))
    matrix, weights = matrix[:, order], weights[order]
    known = {w: names.index(pa.scalar(w, pa.binary())).as_py() + 1 for b in borders for w in b.split(_GAP)}
    wanted = {tuple(known[w] for w in b.split(_GAP)) for b in borders}
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for k in range(LONGEST):
        changed[1:] |= matrix[k, 1:] != matrix[k, :-1]
        first = np.nonzero(changed)[0]
        total = np.add.reduceat(weights, first)
        keep = total >= least
        for w in wanted:
            if len(w) == k + 1:
                keep |= np.all(matrix[: k + 1, first] == np.array(w)[:, None], axis=0)
        keep &= matrix[k, first] > 0
        spelled = [names.take(pa.array(matrix[j, first[keep]] - 1)).to_pylist() for j in range(k + 1)]
        for phrase, n in zip(zip(*spelled, strict=True), total[keep].tolist(), strict=True):
            yield _GAP.join(phrase), k + 1, n


def _begins(record: bytes) -> list[bytes]:
    words = record.split(_GAP)
    return [_GAP.join(words[: k + 1]) for k in range(len(words))]


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``words`` and ``f`` of all phrases of 1 to 4 words with ``least`` occurrences; ``lang`` and ``n``."""
    spark = docs.sparkSession
    ship_package(spark)
    read = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))
    cuts = _cuts(read, max(8, read.count() // RANGE_TEXTS))
    shared = spark.sparkContext.broadcast(cuts)  # one record per range

    def count(table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        near = shared.value[max(0, part - 1) : part + 1]
        for own in sorted(set(table.column("lang").to_pylist())):
            mine = table.filter(pc.equal(table.column("lang"), own))
            records = pc.split_pattern(mine.column("records").combine_chunks(), b"\n").flatten()
            weights = np.concatenate([np.frombuffer(c, np.int32) for c in mine.column("counts").to_pylist()]).astype(np.int64)
            borders = {p for cut_lang, cut in near if cut_lang == own for p in _begins(cut)}
            out += [(own, _plain(p).split(" "), f) for p, _, f in prefix_counts(records, weights, least, borders)]
            out.append((own, [], int(weights.sum())))
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "words", "f"])

    partial = _sent(read, shared).groupBy("part").applyInArrow(count, "lang string, words array<string>, f long")
    counts = checkpointed(partial.groupBy("lang", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.size("words") == 0)))
    return counts.where(F.size("words") > 0), counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))


def in_step(rows: Iterable[tuple[str, list[str], int]], before: dict) -> Iterator[tuple[str, list[str], int | None, list[int], int]]:
    """Reads a stream of counts in order: path, count, counts of the shorter paths it begins with, best extension.

    ``before`` has the counts of the shorter paths that came in an earlier range; those are
    returned too, without a count, for the extensions met here.
    """
    stack: list[list] = []  # language, path, count, shorter counts, extension
    for lang, path, f in rows:
        while stack and (stack[-1][0] != lang or path[: len(stack[-1][1])] != stack[-1][1]):
            yield tuple(stack.pop())
        for k in range(len(stack) + 1, len(path)):
            stack.append([lang, path[:k], None, [before[lang, *path[:j]] for j in range(1, k)], 0])
        shorter = [s[2] if s[2] is not None else before[lang, *s[1]] for s in stack]
        if stack:
            stack[-1][4] = max(stack[-1][4], f)
        stack.append([lang, path, f, shorter, 0])
    while stack:
        yield tuple(stack.pop())


def _stream(counts: DataFrame, path: Column) -> DataFrame:
    """``lang``, ``path``, ``f``, ``shorter`` and ``extended`` of the counts, read in the order of ``path``."""
    order = ["lang", "path"]
    kept = checkpointed(counts.select("lang", path.alias("path"), "f").repartitionByRange(*order).sortWithinPartitions(*order))
    heads = kept.select(*order, F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.min(F.struct(*order)).alias("_head")).select("_head.*")
    shorter = heads.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"))
    found = kept.hint("merge").join(shorter.distinct(), order).collect()  # at most four rows per range
    before = kept.sparkSession.sparkContext.broadcast({(r["lang"], *r["path"]): r["f"] for r in found})
    names = ["lang", "path", "f", "shorter", "extended"]
    kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []
        for row in in_step(rows, before.value):
            held.append(row)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return kept.mapInArrow(run, "lang string, path array<string>, f long, shorter array<long>, extended long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``, best first."""
    counts, totals = phrase_counts(docs, lang, text, least)
    forward, backward = _stream(counts, F.col("words")), _stream(counts, F.reverse("words"))
    none = F.lit(None).cast("array<long>")
    both = forward.select("lang", F.col("path").alias("words"), "f", "extended", F.col("shorter").alias("lefts"), none.alias("rights")).union(
        backward.select("lang", F.reverse("path"), "f", "extended", none, "shorter")
    )
    known = F.col("f").isNotNull()
    met = both.groupBy("lang", "words").agg(
        F.max("f").alias("a"),
        F.max("extended").alias("_longer"),
        F.max(F.when(known, F.col("lefts"))).alias("_lefts"),
        F.max(F.when(known, F.col("rights"))).alias("_rights"),
    )
    exact = lambda c: c.cast("decimal(38,0)")
    size = F.size("words")
    stays = (size > 1) & (exact(F.col("_longer")) * COVERED[1] < exact(F.col("a")) * COVERED[0])

    def cut(k: Column) -> Column:
        l, r = F.col("_lefts")[k - 1], F.col("_rights")[size - k - 1]  # noqa: E741
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * F.col("a").cast("decimal(19,0)"), exact(l + r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut)).alias("_cut")
    scored = met.where(stays).select("lang", F.array_join("words", " ").alias("phrase"), "a", best)
    order = W.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("_nth").cast("long").alias("rank"), "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
