import random
import re
import zlib

import pytest
from llm_tables import messy, written  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_match_a_running_sum(written):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60), "en", "s", 1) for i in range(300)]
    got = {r["doc_id"]: r for r in sharding.byte_shards(written(rows), 8).collect()}
    total, before, slots = sum(len(r[1]) + 1 for r in rows), 0, {}
    for i, text, *_ in rows:
        size = len(text) + 1
        shard = (2 * before + size) * 8 // (2 * total)
        assert (got[i]["size"], got[i]["shard"], got[i]["slot"]) == (size, shard, slots.get(shard, 0))
        assert got[i]["text_crc32"] == zlib.crc32(text.encode())
        slots[shard] = slots.get(shard, 0) + 1
        before += size


def test_shards_of_a_messy_table(written, messy, spark, tmp_path):
    docs = written(messy, clash=True)
    got = sharding.byte_shards(docs, 4).collect()
    assert len(got) == len(messy)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sharding.write_shards(docs, 4, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(messy) and set(docs.columns) < set(back.columns)
    assert sharding.byte_shards(written([]), 4).count() == 0


def water_fill(sizes, weights, cap):
    target, open_ = {}, set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: weights[s] * level for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mix_reaches_its_targets(written):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 30), "en", rng.choice("aaaaaaaaaabbbc") if i % 50 else None, 1) for i in range(900)]
    rows += [(1000, "tiny", "en", "0", 4)]
    docs = written(rows)
    plan = mixing.mix_plan(docs, [5, 2, 1], cap=3.0, shards=5, blocks_per_shard=16).collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = water_fill(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}, 3.0)
    source_of, taken, shards = {r[0]: r[3] for r in rows}, dict.fromkeys(sizes, 0), {}
    for r in plan:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert len(r["copies"]) <= 3
        taken[source] += r["size"] * len(r["copies"])
        for c in r["copies"]:
            shards[c["shard"]] = shards.get(c["shard"], 0) + r["size"]
    assert all(abs(taken[s] - targets[s]) <= 30 for s in sizes)
    assert set(shards) == set(range(5)) and max(shards.values()) < 1.25 * min(shards.values())
    again = mixing.mix_plan(docs, [5, 2, 1], cap=3.0, shards=5, blocks_per_shard=16).collect()
    assert sorted(plan, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_split_quotas_are_exact(spark, shards):
    quotas = [40, 0, 7, 113]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    parts = mixing.split_quotas(root, shards, seed=3).collect()
    assert sorted(r["shard"] for r in parts) == list(range(shards))
    assert [sum(r["quotas"][i] for r in parts) for i in range(4)] == quotas
    sums = [sum(r["quotas"]) for r in parts]
    assert max(sums) - min(sums) <= 1 and all(n >= 0 for r in parts for n in r["quotas"])


def test_split_is_hypergeometric(spark):
    """Means and variances of one split over many seeds."""
    root = spark.createDataFrame([([30, 70],)], "quotas array<bigint>")
    draws = [[r["quotas"][0] for r in mixing.split_quotas(root, 2, seed).where("shard = 0").collect()][0] for seed in range(60)]
    mean, variance = sum(draws) / 60, sum((d - 15) ** 2 for d in draws) / 60
    assert abs(mean - 15) < 1.5 and 2 < variance < 10  # expected 15 and 5.3


def test_mix_of_a_messy_table(written, messy):
    docs = written(messy, clash=True)
    plan = mixing.mix_plan(docs, [5, 2, 1]).collect()
    assert len(plan) == len(messy)
    mixed = mixing.mixed(docs, [5, 2, 1])
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_draw"]
    assert mixed.count() == sum(len(r["copies"]) for r in plan)
    assert mixing.mix_plan(written([]), [5, 2, 1]).count() == 0
    no_words = mixing.mix_plan(written([(1, "", "en", "a", 0), (2, None, None, None, None)]), [1])
    assert [r["target"] for r in no_words.select("target").distinct().collect()] == [0.0]
    assert no_words.select(F.max(F.size("copies"))).first()[0] == 0
