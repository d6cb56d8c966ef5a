"""Substring dedup and phrase collocations against brute force, with messy, hot and empty tables."""

import math
import random
import re
from collections import Counter

import pytest
from llm_tables import messy, written  # noqa: F401  (fixtures)

from tidemark.llm import collocations, substring_dedup
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_kept(docs, window):
    """Words of each text left when all windows met earlier are struck out."""
    seen, out = set(), {}
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i)):
        words = WORD.findall(docs[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            run = tuple(words[s : s + window])
            if run in seen:
                gone |= set(range(s, s + window))
            seen.add(run)
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return [out[i] for i in range(len(docs))]


def copied_texts(seed, n=120):
    """Texts of few words with passages of others at any offset, a hot passage, whole copies and long runs of one word."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(33)]
    for i in range(n):
        words = [rng.choice(["a", "b", "c", f"w{rng.randrange(400)}"]) for _ in range(rng.randint(0, 60))]
        if rows and rng.random() < 0.6:
            other = WORD.findall(rng.choice(rows)[1] or "")
            start = rng.randint(0, len(other))
            at = rng.randint(0, len(words))
            words[at:at] = other[start : start + rng.randint(0, 40)]
        if rng.random() < 0.4:
            words += passage[rng.randint(0, 5) :]
        if rng.random() < 0.1:
            words += ["same"] * rng.randint(5, 50)
        text = rng.choice([" ", "\n", " \t "]).join(words)
        rows.append((i if rng.random() < 0.95 else None, text if rng.random() < 0.97 else None, "en", None, None))
    return rows


@pytest.mark.parametrize("seed, window, batch", [(1, 20, 512), (2, 6, 16), (3, 7, 1), (4, 1, 32), (5, 2, 50)])
def test_substring_dedup_matches_brute_force(written, monkeypatch, seed, window, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    df = written(copied_texts(seed), files=1)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(df, window).collect()]
    assert sorted(got) == sorted(brute_kept(docs, window))
    assert seed > 3 or 0 < sum(n for _, n, _ in got)


def test_substring_dedup_of_a_messy_table(written, messy):
    docs = written(messy, clash=True)
    got = substring_dedup.dedup_substrings(docs)
    assert set(got.columns) == set(docs.columns) | set(substring_dedup.ADDED) and got.count() == len(messy)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[5]["kept_text"] == "" and by[5]["n_removed"] == by[5]["n_words"] > 5_000 and by[5]["removed_words"] == [0, by[5]["n_words"]]
    assert by[2]["n_words"] == 0 and by[2]["text"] is None and by[2]["kept_text"] == "" and by[4]["removed_words"] != [0, by[4]["n_words"]]
    assert by[1]["_row"] == "own _row" and by[1]["n_removed"] == 0
    assert substring_dedup.dedup_substrings(written([])).count() == 0


def test_a_passage_in_most_texts_stays_once(written):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"x{i} {passage} y{i}", None, None, None) for i in range(300)] + [(900, "z " * 19, None, None, None)] * 3
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(written(rows, files=7)).collect()}
    assert got == {(0, 0), (900, 0)} | {(i, 25) for i in range(1, 300)}


def test_substring_query_reads_all_rows(written, spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in copied_texts(8) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op11_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: k[:2] for (d, *_), k in zip(rows, brute_kept(rows, 20))}


# ---- phrases ---------------------------------------------------------------------


def brute_collocations(rows, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    inside = {
        (lang, words[i : i + m])
        for (lang, words), f in candidates.items()
        for m in range(2, len(words))
        for i in range(len(words) - m + 1)
        if 100 * f >= 80 * counts[lang, words[i : i + m]]
    }
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in inside:
            cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            row = (" ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score)
            found.setdefault(lang, []).append(row)
    out = set()
    for lang, phrases in found.items():
        phrases.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, n, *r) for n, r in enumerate(phrases[:top], 1)}
    return out


def spoken(seed, n=300):
    """Texts with frequent phrases, a pair that is everywhere, control characters and words in each other's order."""
    rng = random.Random(seed)
    phrases = ["new york city", "New York", "of the", "in spite of the", "a\x00b c\x01d", "a\x01 b", "a b", "é\u0085 日本", "x x x x x", "the of", "a\x01\x02 c"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.6 else rng.choice("the of a b new x".split()) for _ in range(rng.randint(0, 25))]
        text = "".join(p + rng.choice([" ", " ", "\t", ", ", ".\n", "  "]) for p in parts)
        rows.append((rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.fixture
def split_finely(spark, monkeypatch):
    """Many ranges, small batches, and no partitions put together."""
    monkeypatch.setattr(collocations, "RANGE_TEXTS", 9)
    monkeypatch.setattr(collocations, "HELD", 150)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed, least, top", [(1, 3, 2000), (2, 30, 5), (3, 1, 40)])
def test_collocations_match_brute_force(written, split_finely, seed, least, top):
    rows = spoken(seed)
    df = written([(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)], clash=True)
    got = {tuple(r) for r in collocations.collocations(df, least=least, top=top).collect()}
    assert got == brute_collocations(rows, least, top) and got


def test_collocations_in_one_range(written):
    rows = spoken(7, 60)
    df = written([(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)])
    assert {tuple(r) for r in collocations.collocations(df, least=2).collect()} == brute_collocations(rows, 2, 2000)


def test_collocations_of_messy_and_empty_tables(written, messy):
    want = brute_collocations([(r[1], r[2]) for r in messy], 2, 2000)
    assert {tuple(r) for r in collocations.collocations(written(messy, clash=True), least=2).collect()} == want
    assert collocations.collocations(written([])).count() == 0
    assert collocations.collocations(written([(1, None, None, None, None)])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**13
    counts = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big + 1), ("en", ["a", "b"], big - 1)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (counts, totals))
    row = collocations.collocations(counts).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1) and (row.l, row.r, row.n) == (big, big + 1, 9 * big)
    assert math.log2(2_000_000 * big) > 63
