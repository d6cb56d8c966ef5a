"""Conversation repair: the search against a shortest path, the whole operator against a plain one."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair
from tidemark.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def shortest(initials, faults, start=0, accept=(0, 3)):
    """Least (cost, audit) by trying prefixes in that order; independent of the search's bounds."""
    heap, done = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(initials) and state in accept:
            return cost, audit
        role, to = ("a", 3) if state == 2 else ("u", 2)
        ways = [(3, "I", i, to)]
        if i < len(initials):
            ways.append((4, "D", i + 1, state))
            if faults[i] not in "bd":
                more = 3 if faults[i] == "t" else 0
                ways.append((3 + more, "R", i + 1, to))
                if initials[i] == role:
                    ways.append((more, "K", i + 1, to))
                if initials[i] == "s" and state == 0:
                    ways.append((more, "K", i + 1, 1))
        for paid, edit, at, last in ways:
            heapq.heappush(heap, (cost + paid, audit + edit, at, last))
    return None


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_least_cost_and_audit(seed):
    rng = random.Random(seed)
    for n in [0, 1, 2, 3, 5, 8, 13] * 40 + [150]:
        letters, kinds = rng.choice(["uuua", "sua?", "ua", "s", "aaau"]), rng.choice(["bdt-----", "t", "-", "bd"])
        initials, faults = ("".join(rng.choice(x) for _ in range(n)) for x in (letters, kinds))
        assert repair.search(initials, faults) == shortest(initials, faults)
        for start in range(4):
            for end in range(4):
                assert repair.search(initials, faults, start, (end,)) == shortest(initials, faults, start, (end,))


def plain_damage(rows):
    """Conversation id to the (turn, role, text) that are left, as the contract says."""
    left = {}
    for conv, turn, role, text in rows:
        kept = left.setdefault(conv, [])
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return left


def plain_repair(rows):
    out = {}
    for conv, kept in plain_damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), ""
        for _, role, text in kept:
            body = text.rstrip(WHITE)
            faults += "b" if not body.strip(WHITE) else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = "".join((r[1] or "?")[0] for r in kept)
        turns = {r[0] for r in kept if r[0] is not None}
        cost, audit = shortest(initials, faults)
        lines, state, at = [], None, 0
        for edit in audit:
            due = "assistant" if state == "user" else "user"
            if edit == "K":
                lines.append(f"{kept[at][1]}:{kept[at][2]}")
                state = {"s": "system", "u": "user", "a": "assistant"}[kept[at][1][0]]
            elif edit in "RI":
                lines.append(f"{due}:{kept[at][2] if edit == 'R' else ''}")
                state = due
            at += edit != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(seed, convs=60):
    """Ordinary and odd ones, and one that holds a third of all rows."""
    rng, rows = random.Random(seed), []
    sayings = ["Yes.", "No", "", "  \t", "Why?  \n", "Über.", None, "x", "a.b", "\u0085", "!"]
    for c in range(convs):
        n = 0 if c % 9 == 8 else rng.randint(1, 9)
        for t in range(n):
            rows.append((None if c == 4 else c, t * rng.choice([1, 1, 1, 2]) if c != 5 else t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "ux"]), rng.choice(sayings)))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", rng.choice(["Ja.", f"{t}.", f"{t}"])) for t in range(len(rows) // 2)]
    rows += [(2000, None, "user", "Lost."), (2001, 7, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, size", [(1, 256), (2, 4), (3, 1)])
def test_repair_matches_a_plain_one(spark, tmp_path, seed, size):
    rows = conversations(seed)
    spark.createDataFrame(rows, SCHEMA).select("*", F.lit("own").alias("_row"), F.lit(1).alias("position")).repartition(3).write.parquet(f"{tmp_path}/c")
    summary, blocks = repair.repair(repair.damage(spark.read.parquet(f"{tmp_path}/c")), size)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in summary.collect()}
    assert got == plain_repair(rows)
    assert size > 4 or blocks.where("block > 2 and not alone").count() > 0


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    kept = repair.with_row(spark.read.parquet(f"{tmp_path}/c"))
    whole = kept.select("conv_id", "turn", "_row", F.array(F.struct("role", "text")).alias("versions"))
    row = repair.repair(whole)[0].first()
    assert (row["duplicate"], row["cost"], row["audit"]) == (4, 16, "KDDDKD")
    assert row["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e")
    assert repair.repair(repair.damage(spark.read.parquet(f"{tmp_path}/e")))[0].count() == 0


def test_query_reads_all_conversations(spark, tmp_path):
    rows = conversations(9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == plain_repair(rows)
