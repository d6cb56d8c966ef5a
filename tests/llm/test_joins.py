import random
import re

import numpy as np
import pytest
import xxhash
from llm_tables import messy, written  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from tidemark.llm import components, line_dedup, mih, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(docs, least):
    """Every run of lines with enough words, checked against every earlier one."""
    lines = [(t or "").split("\n") for _, t in docs]
    first, runs, gone = {}, [], [set() for _ in docs]
    for d in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i)):
        words = [len(WORD.findall(x)) for x in lines[d]]
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                if sum(words[s:e]) >= least:
                    run = tuple(lines[d][s:e])
                    first.setdefault(run, (d, s))
                    runs.append((d, s, e, run))
    for d, s, e, run in runs:
        if first[run] != (d, s):
            gone[d] |= set(range(s, e))
    return [t if not g else "\n".join(x for i, x in enumerate(ls) if i not in g) for (_, t), ls, g in zip(docs, lines, gone)]


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 9)])
def test_line_dedup_matches_brute_force(written, seed, least):
    rng, vocabulary, rows = random.Random(seed), ["a b", "c", "", "d e f", "g h i j k l", "m", "x y z"], []
    for i in range(90):
        lines = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        if rows and rng.random() < 0.5:
            other = (rows[rng.randrange(len(rows))][1] or "").split("\n")
            a = rng.randrange(len(other) + 1)
            at = rng.randint(0, len(lines))
            lines[at:at] = other[a : rng.randint(a, len(other))]
        rows.append((i if rng.random() < 0.95 else None, "\n".join(lines) if rng.random() < 0.97 else None, None, None, None))
    df = written(rows, files=1)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = [r.text for r in line_dedup.dedup_lines(df, least).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_dedup(docs, least)))


def test_line_dedup_of_a_messy_table(written, messy):
    docs = written(messy, clash=True)
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == len(messy)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[5]["text"] == "" and by[4]["removed_lines"] is None and by[2]["text"] is None and by[1]["text"] == messy[0][1]
    assert line_dedup.dedup_lines(written([])).count() == 0
    short = "one two\nthree four"
    assert {r.text for r in line_dedup.dedup_lines(written([(1, short, None, None, 1), (1, short, None, None, 1)]), 3).collect()} == {short, ""}


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points):
    roots = list(range(len(points)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                roots[b] = a
    return [root(i) for i in range(len(points))]


def test_simhash_matches_brute_force(written, messy):
    rng = random.Random(4)
    rows = list(messy)
    for i in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([0, 1, 2, 3, 80, 300]))]
        rows.append((100 + 4 * i, " ".join(words), None, None, None))
        for k in range(1, rng.randint(1, 4)):
            edited = [w if rng.random() > 0.01 else "edit" for w in words]
            rows.append((100 + 4 * i + k, "  ".join(edited).upper(), None, None, None))
    got = simhash.groups(written(rows, clash=True)).collect()
    points = [plain_fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    roots = brute_groups(points)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), p, str(least.get(r))) for i, p, r in zip(ids, points, roots))
    assert sorted((str(r["doc_id"]), r["bits"] & (1 << 64) - 1, str(r["component_id"])) for r in got) == want
    assert simhash.groups(written([])).count() == 0


@pytest.mark.parametrize("kind", ["random", "dense", "one half"])
def test_trees_find_all_groups(kind):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    if kind == "dense":
        points = points[:1] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    if kind == "one half":
        points = points & np.uint64(0xFFFFFFFF)
    near = points[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([points, near]))
    parent, place = np.arange(len(points)), {int(p): i for i, p in enumerate(points)}
    for metric in (0, 1):
        shards = []
        tree = simhash.build(rng.permutation(points)[:300], metric, 3, shards)
        for _, members in simhash.deal(points, tree):
            a, b = simhash.links(members, metric)
            simhash._union(parent, np.array([place[int(x)] for x in members[a]], int), np.array([place[int(x)] for x in members[b]], int))
    got = simhash._roots(parent)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = np.arange(len(points))
    simhash._union(want, *np.nonzero(close))
    assert np.array_equal(got, simhash._roots(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 240)] + [(5, 5), (7, 6), (300, 299), (299, 301)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 200 for i in range(200, 240)} | {299: 299, 300: 299, 301: 299}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def test_search_recall_and_order(written):
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((1200, 16)).astype(np.float32)
    matrix[300:340] = matrix[7]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(matrix)]
    got = mih.search(written(rows, VECTORS), F.col("vec_id") % 20 == 0, k=20).collect()
    exact, by, hits = matrix.astype(float), {}, 0
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1200, 20))
    for q, found in by.items():
        found.sort()
        scores = exact @ exact[q]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and q not in {f[1] for f in found}
        hits += len({f[1] for f in found} & {i for i in np.lexsort((np.arange(1200), -scores)) if i != q and scores[i] >= np.sort(np.delete(scores, q))[-20]})
    assert hits / (20 * len(by)) >= 0.9


def test_block_finds_all_codes_within_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 16, (3000, mih.PARTS), dtype=np.uint16)
    codes[1:400] = codes[0]
    for i in range(1, 400):
        for _ in range(i % 40):
            codes[i, rng.integers(0, mih.PARTS)] ^= np.uint16(1 << rng.integers(0, 16))
    block = mih.Block(codes)
    for radius in (0, 3, 8, 15, 30, 60):
        want = np.nonzero(mih.hamming(codes, codes[0]) <= radius)[0]
        assert np.array_equal(block.within(codes[0], radius), want)


def test_search_of_messy_vectors(written):
    good = [(i, [float(i % 7), 1.0, float(i % 3)], 0) for i in range(30)]
    bad = [(40, None, 0), (60, [0.0, 0.0, 0.0], 0), (80, [1.0, None, 0.0], 0), (100, [float("nan"), 1.0, 1.0], 0), (120, [float("inf"), 1.0, 1.0], 0), (140, [1.0], 0), (160, [], 0)]
    rows = good + bad + [(None, [9.0, 9.0, 9.0], None), (20, [5.0, 5.0, 5.0], None), (20, [5.0, 5.0, 5.0], None)]
    got = mih.search(written(rows, VECTORS, clash=True), F.col("vec_id") % 20 == 0, k=40).collect()
    assert {r["query_id"] for r in got} == {0, 20}
    assert sum(r["query_id"] == 0 for r in got) == 32  # all candidates but itself
    assert any(r["vec_id"] is None for r in got)
    for q in ([], [(1, [1.0, 2.0], 0)], [(20, [1.0, 2.0], 0)]):
        assert mih.search(written(q, VECTORS), F.col("vec_id") % 20 == 0, k=5).count() == 0
