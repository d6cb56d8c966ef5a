"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A conversation is legal if the first letters of its roles read ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant in turns, or nothing at all. A row's first fault counts: ``blank``
(no character but ``[\\x20\\x09-\\x0D]``), ``duplicate`` (role and text seen earlier in the
conversation) or ``truncated`` (its last such character is none of ``.!?``). Edits: Keep costs 0,
Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an
empty user or assistant row 3, anywhere. A truncated row that is not deleted costs 3 more. Of
the cheapest repairs that with the ASCII-least audit (the initials of its edits in order) counts.

Method: depth-first branch and bound over the rows with an explicit stack. A node is the number of
rows used and the last role given. Suffix bounds, summed from the last row back, say what the rows
left cost at least after that role. The incumbent is the least (cost, audit) so far; a node is
cut if cost and bound pass the incumbent's cost, or meet it with an audit that is already
greater. Each node has a dominance table entry, the least (cost, audit) it was reached with;
worse prefixes are cut. The search ends when the stack is empty: then the incumbent is proved.
That is safe: of two prefixes of one cost to one node neither continues the other (what is
longer by inserts costs more), so the order of audits is settled before any common ending.

Long conversations: rows are numbered by a running sum over ranges and cut into blocks of
``BLOCK``. A block is searched for each role it can begin and end with, on any worker; a
conversation then takes the best chain of its blocks. So one conversation may hold a third of all
rows. Only letters and hashes travel to the search. Texts meet their audit once, block by block;
the digest of a conversation of several blocks reads them as a stream.

Order: turn, null first, then role, then a hash of the text. Nulls in role and text are one space; null ids are
one conversation. A role that is empty or has another initial is never kept as it is. Repeated
rows are duplicates. A conversation without rows has cost 0 and an empty audit. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sums
from tidemark.llm.rows import checkpointed, with_row
from tidemark.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Rows searched together, unless said otherwise.
BLOCK = 256

#: The last role given: none yet, system, user, assistant. A repair may end in ``FINAL``.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)

_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}

_SPACE = r"\x20\x09-\x0D"

#: A conversation's key: whether its id is null, and the id as text.
_KEY = ["_none", "_conv"]


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, if it may."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _NEXT[state] if initial and _NAME[_NEXT[state]][0] == initial else None


def _row_moves(state: int, initial: str, fault: str) -> list[tuple[int, str, int]]:
    """Cost, initial and next state of each edit that uses up a row."""
    moves = [(DELETE, "D", state)]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        moves.append((REROLE + more, "R", _NEXT[state]))
        kept = _kept(state, initial)
        if kept is not None:
            moves.append((KEEP + more, "K", kept))
    return moves


def suffix_bounds(initials: str, faults: str, accept: tuple[int, ...]) -> list[list[float]]:
    """For each number of rows used and each state, the least that what is left can cost."""
    below = [0.0 if s in accept else inf for s in range(4)]
    bounds = []
    for i in range(len(initials), -1, -1):
        if i < len(initials):
            below = [min(cost + below[to] for cost, _, to in _row_moves(s, initials[i], faults[i])) for s in range(4)]
        for _ in range(2):  # one insert, then two; more come back to the same role
            below = [min(below[s], INSERT + below[_NEXT[s]]) for s in range(4)]
        bounds.append(below)
    return bounds[::-1]


@lru_cache(1 << 14)
def search(initials: str, faults: str, start: int = START, accept: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start`` to a state of ``accept``; ``faults`` has b, d, t or - for each row."""
    n, bound = len(initials), suffix_bounds(initials, faults, accept)
    incumbent, reached = None, {}
    stack = [(0, start, 0, "")] if bound[0][start] < inf else []
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            least = cost + bound[i][state]
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)]):
                continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in accept and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        moves = [(INSERT, "I", _NEXT[state], i)]
        if i < n:
            moves += [(*m, i + 1) for m in _row_moves(state, initials[i], faults[i])]
        moves = [m for m in moves if bound[m[3]][m[2]] < inf]
        moves.sort(key=lambda m: (m[0] + bound[m[3]][m[2]], m[1]), reverse=True)
        stack += [(used, to, cost + paid, audit + edit) for paid, edit, to, used in moves]
    return incumbent


def block_options(block: int, initials: str, faults: str, size: int = BLOCK) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) for every way through a block; a first block that is not full is the only one."""
    if block == 0 and len(initials) < size:
        return [(START, ASSISTANT, *search(initials, faults))]
    ways = ((s, e, search(initials, faults, s, (e,))) for s in ((START,) if block == 0 else range(4)) for e in range(4))
    return [(s, e, *found) for s, e, found in ways if found is not None]


def chain(blocks: list[dict]) -> tuple[int, str, list[dict]]:
    """Cost, audit and the audit of each block of the best chain of a conversation's blocks, in order."""
    best = {START: (0, "", [])}
    for b in blocks:
        new = {}
        for o in b["options"]:
            if o["start"] in best:
                cost, audit, parts = best[o["start"]]
                found = (cost + o["cost"], audit + o["audit"])
                if o["end"] not in new or found < new[o["end"]][:2]:
                    new[o["end"]] = (*found, [*parts, {"block": b["block"], "start": o["start"], "audit": o["audit"]}])
        best = new
    return min((best[e] for e in FINAL if e in best), key=lambda x: x[:2])


def _lines(start: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of a block's rows after the edits of ``audit``."""
    out, state, at = [], start, 0
    for edit in audit:
        if edit == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = _kept(state, roles[at][:1])
        elif edit in "RI":
            state = _NEXT[state]
            out.append(f"{_NAME[state]}:{texts[at] if edit == 'R' else ''}")
        at += edit != "I"
    return out


def _keyed(turns: DataFrame, conv: str) -> DataFrame:
    return turns.withColumns({"_none": F.col(conv).isNull(), "_conv": F.coalesce(F.col(conv).cast("string"), F.lit(""))})


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``_row`` and ``versions`` (the rows, of ``role`` and ``text``, that damage leaves of each row)."""
    kind = F.crc32(F.concat_ws(":", _spaced(F.col("conv_id")), _spaced(F.col("turn"))).cast("binary")) % 20
    role, text = _spaced(F.col("role")), _spaced(F.col("text"))
    row = F.struct(
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    versions = F.array_repeat(row, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)).alias("versions")
    return with_row(turns.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "_row", versions)


def numbered(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Key, ``_row``, ``_copy``, ``position`` in the conversation, ``block``, ``initial`` and ``fault`` (b, d, t or -); no texts."""
    text = F.col("text")
    letter = F.when(~text.rlike(f"[^{_SPACE}]"), "b").when(~text.rlike(rf"[.!?][{_SPACE}]*\z"), "t").otherwise("-")
    slim = rows.select(
        *_KEY, "_row", "_copy", F.col("turn").isNotNull().alias("_dated"), F.coalesce("turn", F.lit(0)).alias("_turn"), "role",
        F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2"), letter.alias("_letter"), F.lit(1).alias("_one"),
    )
    placed = running_sums(slim, "_one", ["_dated", "_turn", "role", "_h1", "_h2"], within=_KEY)
    same = [*_KEY, "role", "_h1", "_h2"]
    firsts = placed.groupBy(*same).agg(F.min("position").alias("_first"))
    fault = F.when(F.col("_letter") == "b", "b").when(F.col("position") > F.col("_first"), "d").otherwise(F.col("_letter"))
    initial = F.substring(F.concat("role", F.lit("?")), 1, 1)
    return placed.join(firsts, same).select(
        *_KEY, "_row", "_copy", "position", F.floor(F.col("position") / size).cast("long").alias("block"), initial.alias("initial"), fault.alias("fault")
    )


_OPTIONS = "array<struct<start:int,end:int,cost:long,audit:string>>"


def _searched(rows: DataFrame, size: int) -> DataFrame:
    """A row per block: ``initials``, ``faults`` and ``options``."""
    blocks = rows.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list(F.struct("position", "initial", "fault"))).alias("_rows"))
    text = lambda f: F.array_join(F.transform("_rows", lambda r: r[f]), "")
    letters = blocks.select(*_KEY, "block", text("initial").alias("initials"), text("fault").alias("faults"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(batch.column(c).to_pylist() for c in ("block", "initials", "faults")), strict=True)
            found = [[dict(zip(("start", "end", "cost", "audit"), o, strict=True)) for o in block_options(*b, size)] for b in told]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "options"])

    return letters.mapInArrow(run, letters.withColumn("options", F.lit(None).cast(_OPTIONS)).schema)


def audits(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Key, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``parts`` (the audit by block)."""
    ship_package(rows.sparkSession)
    blocks = _searched(rows, size).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("block", "initials", "faults", "options"))).alias("blocks"))
    part = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("audit", pa.string())]))
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("blocks").to_pylist():
                faults, initials = "".join(b["faults"] for b in own), "".join(b["initials"] for b in own)
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
                out.append((*map(faults.count, "bdt"), illegal, *chain(own)))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.string(), part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*_KEY, *names])

    typed = ["bigint"] * 5 + ["string", "array<struct<block:bigint,start:int,audit:string>>"]
    schema = blocks.select(*_KEY, *(F.lit(None).cast(k).alias(n) for n, k in zip(names, typed, strict=True))).schema
    return blocks.select(*_KEY, "blocks").mapInArrow(run, schema)


def repaired_blocks(texts: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Key, ``block``, ``alone`` (the conversation's only one), ``lines`` (the repaired ``role:text``) and their ``digest``."""
    alone = (F.size("parts") == 1).alias("alone")
    parts = found.select(*_KEY, alone, F.explode("parts").alias("_part")).select(*_KEY, "alone", "_part.*")
    placed = texts.select("_row", "_copy", "role", "text").join(rows.select(*_KEY, "_row", "_copy", "position", "block"), ["_row", "_copy"])
    held = placed.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("_rows"))
    both = held.join(parts, [*_KEY, "block"]).select(*_KEY, "block", "alone", "start", "audit", F.col("_rows.role").alias("roles"), F.col("_rows.text").alias("texts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                lines = [_lines(*t) for t in zip(*(some.column(c).to_pylist() for c in ("start", "audit", "roles", "texts")), strict=True)]
                columns = [pa.array(lines, pa.list_(pa.string())), pa.array([hashlib.sha256("\n".join(x).encode()).hexdigest() for x in lines], pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], *columns], names=[*_KEY, "block", "alone", "lines", "digest"])

    return both.mapInArrow(run, both.select(*_KEY, "block", "alone", F.col("texts").alias("lines"), F.col("audit").alias("digest")).schema)


def digests(blocks: DataFrame) -> DataFrame:
    """Key and ``repaired_sha256`` of each conversation's lines, joined by newlines.

    The only block of a conversation brings its digest; several are read in order as a stream.
    """
    streams = blocks.select(*_KEY, "block", "digest", F.when(~F.col("alone"), F.col("lines")).alias("lines")).repartition(*_KEY).sortWithinPartitions(*_KEY, "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun = None, None, False
        for batch in batches:
            done = []
            for none, conv, alone, lines in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "digest", "lines")), strict=True):
                if key is not None and key != (none, conv):
                    done.append((*key, digest.hexdigest()))
                    key = None
                if lines is None:
                    done.append((none, conv, alone))
                    continue
                if key is None:
                    key, digest, begun = (none, conv), hashlib.sha256(), False
                for line in lines:
                    digest.update((("\n" if begun else "") + line).encode())
                    begun = True
            yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    return streams.mapInArrow(run, "_none boolean, _conv string, repaired_sha256 string")


def _digest_rows(done: list[tuple[bool, str, str]]) -> pa.RecordBatch:
    columns = zip(*done, strict=True) if done else ((), (), ())
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.bool_(), pa.string(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*_KEY, "repaired_sha256"])


def repair(turns: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For rows ``conv_id``, ``turn`` and ``versions`` (as ``damage`` gives them; ``_row``, if there, tells rows apart): a summary of each conversation
    (``conv_id``, ``gaps``, counts of faults, ``cost``, ``audit``, ``repaired_sha256``), and the repaired blocks."""
    keyed = _keyed(turns, "conv_id")
    there = F.when(F.size("versions") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0)).cast("long")
    known = keyed.groupBy(*_KEY, "conv_id").agg(gaps.alias("gaps"))
    kept = with_row(keyed) if "_row" not in keyed.columns else keyed
    texts = kept.select(*_KEY, "_row", "turn", F.posexplode("versions").alias("_copy", "_v")).select(
        *_KEY, "_row", "turn", "_copy", _spaced(F.col("_v.role")).alias("role"), _spaced(F.col("_v.text")).alias("text")
    )
    rows = checkpointed(numbered(texts, size))
    found = checkpointed(audits(rows, size))
    blocks = repaired_blocks(texts, rows, found)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    summary = known.join(found.drop("parts"), _KEY, "left").join(digests(blocks), _KEY, "left").select(
        "conv_id",
        "gaps",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return summary, blocks
