"""Secret scans over a trigram index.

From each rule's regex a Boolean query of trigrams is derived that every text with a match
satisfies: runs of literals, also through groups, alternatives and optional parts, must
occur, hence all their trigrams. The index holds a posting (trigram, text) for each trigram
that some rule asks for, case folded; texts are known by their 64-bit hash, so copies share
postings. Postings of a text are merged, the queries are answered on them, and only the
texts found are verified with the regex. A rule without a mandatory trigram scans all texts.
A hash shared by different texts can only add a candidate, which verification settles.

Nulls: a null text is empty. Repeated rows are scanned each. An empty table gives no rows.
Extra columns are not read; spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import let, running
from tidemark.llm.rows import checkpointed, small, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost without overlap, whose ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int


#: The patterns of the base kinds and their least lengths.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: At most so many literal runs are told apart in one place of a pattern.
_RUNS = 64

#: A query is a list of clauses that must all hold; a clause is a list of alternatives,
#: each a set of trigrams that must all be there.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """The trigrams any match of ``pattern`` must hold; no clause if there is none."""
    runs, query = _runs(re._parser.parse(pattern))
    return query + _clause(runs or {""})


def _clause(runs: set[str]) -> Query:
    shortest = [r for r in runs if not any(o != r and o in r for o in runs)]
    if min(map(len, shortest)) < 3:
        return []
    return [[frozenset(r[i : i + 3] for i in range(len(r) - 2)) for r in sorted(shortest)]]


def _runs(items) -> tuple[set[str] | None, Query]:
    """The literal strings a part can be (None if not few), and clauses found before."""
    runs, query, exact = {""}, [], True
    for kind, value in items:
        kind, options, inner = str(kind), None, []
        if kind == "LITERAL":
            options = {chr(value).lower()}
        elif kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            options = {chr(v).lower() for _, v in value}
        elif kind == "SUBPATTERN":
            options, inner = _runs(value[-1])
        elif kind == "BRANCH":
            branches = [_runs(b) for b in value[1]]
            if all(o is not None for o, _ in branches):
                options = set().union(*(o for o, _ in branches))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = value
            once, more = _runs(part)
            if (low, high) == (0, 1) and once is not None:
                options = once | {""}
            elif low >= 1:
                inner = more + (_clause(once) if once is not None else [])
        if options is not None and len(runs) * len(options) <= _RUNS:
            runs = {a + b for a, b in product(runs, options)}
        else:
            query += _clause(runs) + inner
            runs, exact = options or {""}, False
            if options is None:
                continue
    if exact:
        return runs, query
    return None, query + _clause(runs)


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """One row per text (``_text``: its hash) that has any of ``trigrams``, with the ``held`` ones.

    Postings (trigram, text) are merged by text. Kept in the checkpoint folder.
    """
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    postings = texts.select(F.xxhash64("text").alias("_text"), F.explode(found).alias("trigram"))
    return checkpointed(postings.groupBy("_text").agg(F.collect_set("trigram").alias("held")))


def _holds(query: Query) -> Column:
    """Whether the postings in ``held`` satisfy the query."""
    clauses = [[F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(need))))) == len(need) for need in clause] for clause in query]
    met = F.lit(True)
    for clause in clauses:
        met = met & (clause[0] if len(clause) == 1 else F.array_max(F.array(*clause)))
    return met


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rule, end) of a rule's matches in one text.

    The texts between matches and the matches themselves alternate; their lengths add up to
    the places of the matches.
    """
    regex = F.lit(rule.pattern)
    found = F.struct(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("kept"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def spans(x: Column) -> Column:
        lengths = F.flatten(F.transform(x["whole"], lambda m, i: F.array(F.length(x["between"][i]), F.length(m))))

        def placed(ends: Column) -> Column:
            span = lambda k, i: (ends[2 * i].alias("start"), F.lit(rank).alias("rule"), ends[2 * i + 1].alias("end"), F.length(k).alias("kept"))
            return F.transform(x["kept"], lambda k, i: F.struct(*span(k, i)))

        return F.filter(let(running(lengths), placed), lambda s: s["kept"] >= rule.least)

    return let(found, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans`` (array of start, rule index, end, kept; by start, then rule) of every document."""
    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for need in clause for t in need})
    if trigrams:
        asked = [i for i, q in enumerate(queries) if q]
        index = trigram_index(texts, trigrams)
        flags = F.array_compact(F.array(*(F.when(_holds(queries[i]), F.lit(i)) for i in asked)))
        candidates = index.select("_text", flags.alias("_rules")).where(F.size("_rules") > 0)
        texts = texts.withColumn("_text", F.xxhash64("text")).join(small(candidates), "_text", "left")
    none = F.array().cast("array<struct<start:int,rule:int,end:int,kept:int>>")
    parts = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        wanted = F.array_contains("_rules", i) if query else F.rlike("text", F.lit(rule.pattern))
        parts.append(F.when(wanted, match_spans(F.col("text"), rule, i)).otherwise(none))
    return texts.select(F.col("_key").alias(key), F.array_sort(F.concat(*parts)).alias("spans"))
