"""Near copies of the pipeline: links by the Jaccard similarity of five-word shingles."""

import random

import numpy as np

from llm_tables import written  # noqa: F401  (fixture)

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.components import components


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    sets, roots = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and roots[i] != roots[j]:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def corpus():
    """Texts with copies edited until they are similar, hardly similar or no more; a hot group; a shared passage."""
    rng, texts = random.Random(9), []
    fresh = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    passage, base = fresh(60), fresh(160)
    for _ in range(60):
        words = fresh(rng.choice([3, 5, 80, 120, 300]))
        texts.append(" ".join(words))
        for edits in range(1, rng.randint(1, 6)):
            edited = list(words)
            for _ in range(edits):
                edited[rng.randrange(len(edited))] = "edit"
            texts.append("  ".join(edited).upper())
    for _ in range(150):  # each is near the base, not all are near each other
        edited = list(base)
        for at in rng.sample(range(160), rng.randint(1, 3)):
            edited[at] = f"e{rng.randrange(99)}"
        texts.append(" ".join(edited))
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(60)] + ["a b", "a  B", ""]
    return texts


def test_groups_match_brute_force(written):
    texts = corpus()
    want = brute_groups(texts)
    got = near_copies.groups(written([(i, t, None, None, None) for i, t in enumerate(texts)], clash=True)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert len(set(want)) < len(texts) - 150 and near_copies.groups(written([])).count() == 0


def test_stage_drops_copies_beyond_three_bits(spark, written):
    rng = random.Random(2)
    words = [f"w{rng.randrange(9000)}" for _ in range(120)]
    near, far = list(words), list(words)
    for at in (30, 80):
        near[at] = "edit"
    for at in range(10, 120, 12):
        far[at] = "edit"
    docs = written([(i, " ".join(t), "en", "a", None) for i, t in enumerate((words, near, far))])
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == {0, 2}


def test_trees_find_alike_fingerprints_across_shards(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARD", 200)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (400, near_copies.WORDS)).astype(np.uint64)
    flipped = base.copy()
    for row in flipped:
        for at in rng.choice(64 * near_copies.WORDS, 27, replace=False).tolist():
            row[at // 64] ^= np.uint64(1 << at % 64)
    both = np.concatenate([base, flipped]).view(np.int64).tolist()
    points = spark.createDataFrame([(i, *row) for i, row in enumerate(both)], ", ".join(["point long", *(f"{s} long" for s in near_copies.SIGNS)]))
    edges = {tuple(sorted(r)) for r in near_copies.alike_edges(points.repartition(3)).collect()}
    assert edges <= {(i, i + 400) for i in range(400)} and len(edges) >= 396


def test_large_classes_are_led_to_the_same_groups(written, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(near_copies, "TOGETHER", 20)
    got = near_copies.groups(written([(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute_groups(texts)))


def counted(monkeypatch, name):
    """Counts the calls of a helper of ``near_copies``."""
    calls, real = [], getattr(near_copies, name)
    monkeypatch.setattr(near_copies, name, lambda *args: (calls.append(1), real(*args))[1])
    return calls


def alike_texts(n, edits):
    rng = random.Random(7)
    base, texts = [f"w{rng.randrange(9000)}" for _ in range(300)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(300), edits):
            words[at] = f"e{rng.randrange(9000)}"
        texts.append(" ".join(words[: 300 - i % 40]))
    return texts


def test_steps_do_not_grow_with_a_class(written, monkeypatch):
    for name, value in {"TOGETHER": 5, "MOST_LEADERS": 4, "BLOCK": 16, "LED": 20}.items():
        monkeypatch.setattr(near_copies, name, value, raising=False)
    steps, turns = counted(monkeypatch, "checkpointed"), counted(monkeypatch, "released")
    for texts in (alike_texts(100, 7), alike_texts(100, 4)):  # alike: most are similar to none, or all hang together
        want = brute_groups(texts)
        del steps[:], turns[:]
        got = near_copies.groups(written([(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
        assert len(steps) <= 30 and len(turns) <= 8


def test_blocks_and_leaders_not_broadcast_give_the_same_groups(written, monkeypatch):
    texts = corpus() + alike_texts(60, 6)
    for name, value in {"TOGETHER": 10, "LED": 0, "BLOCK": 8, "BLOCK_HASHES": 900, "LEAD_HASHES": 0}.items():
        monkeypatch.setattr(near_copies, name, value)
    got = near_copies.groups(written([(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute_groups(texts)))


def test_components_in_one_task_are_those_of_rounds(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(900, 960)]
    for some in (edges, []):
        table = spark.createDataFrame(some, "a long, b long").repartition(5)
        assert sorted(components(table, 10**6).collect()) == sorted(components(table).collect())
