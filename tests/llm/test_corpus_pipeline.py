"""The pipeline, each stage against a brute-force version of its decisions."""

import random
import struct
from collections import Counter

import pytest
from llm_tables import messy, written  # noqa: F401  (fixtures)
from pyspark.sql import functions as F
from test_joins import WORD, brute_dedup
from test_near_copies import brute_groups

import corpus_pipeline
from tidemark.llm import line_dedup, mixing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    """Two invented languages, copies, near copies, shared passages and texts without letters."""
    rng, rows = random.Random(8), []
    syllables = {"aa": ["ta", "ro", "mi", "lu", "sen"], "bb": ["sch", "ung", "ker", "zen", "ffe"]}

    def word(lang):
        return "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))

    passage = " ".join(word("aa") for _ in range(60))
    for i in range(80):
        lang = "aa" if i % 3 else "bb"
        lines = [" ".join(word(lang) for _ in range(rng.randint(5, 90))) for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append([i, "\n".join(lines), lang, "xyz"[i % 3] if i % 10 else None])
    for i in range(80, 100):
        text = rows[i - 80][1]
        words = text.split(" ")
        words[rng.randrange(len(words))] = "edit"
        rows.append([i, text if i % 2 else " ".join(words), rows[i - 80][2], "x"])
    rows += [[100, "12 34 !!", None, "x"], [101, "", None, "y"], [102, None, None, "y"]]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in rows]


def test_each_stage(spark, written, tmp_path):
    docs, seen = written(corpus(), files=2), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in seen[name][1])

    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {100, 101, 102}

    before, after = seen["line_dedup"]
    left = dict(zip((r.doc_id for r in before), brute_dedup([(r.doc_id, r.text) for r in before], line_dedup.MIN_WORDS)))
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in left.items() if t}
    assert sum(r.text != left[r.doc_id] for r in before) > 10

    before, after = seen["near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    roots = brute_groups([r.text for r in before])
    assert {r.doc_id for r in after} == {before[k].doc_id for k in set(roots)}

    before, after = seen["mixing"]
    rows, taken = {r.doc_id: r for r in before}, Counter(r.doc_id for r in after)
    assert max(taken.values()) <= 3 and all(rows[r.doc_id] == r for r in after)
    words = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    assert abs(sum(n * words[i] for i, n in taken.items()) - sum(words.values())) < 4 * max(words.values())

    before, after = seen["bpe"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in before}
    assert Counter(r.doc_id for r in after) == taken
    for r in after:
        assert bytes(r.ids) == struct.pack(f"<{len(ids[r.doc_id])}I", *ids[r.doc_id]) and r.n_tokens == len(ids[r.doc_id])
        assert r.decoded == library.decode(ids[r.doc_id], skip_special_tokens=False)


def test_mix_rows_stand_by_shard_and_draw(spark, written):
    docs = written(corpus(), files=2)
    mixed = mixing.mixed(docs, corpus_pipeline.WEIGHTS, cap=corpus_pipeline.CAP)
    order = [(r.mix_shard, r.mix_draw, r.doc_id) for r in mixed.collect()]
    staged = corpus_pipeline.mix_sources(spark, docs, "").withColumn("_part", F.spark_partition_id())
    assert [r.doc_id for r in staged.collect()] == [r[2] for r in sorted(order)] and len({r[0] for r in order}) == 8


def strange_words(alphabet, rng, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_unlearned_languages_go_and_labelled_rows_stay(spark, written):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng, rows = random.Random(3), []
    scripts = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "cjk": range(0x4E00, 0x4F00), "latin": range(0x61, 0x7B)}
    alphabets = {name: [chr(c) for c in points] for name, points in scripts.items()} | {"invented": ["ka", "to", "mu", "ri", "shi", "no", "ha", "wo", "tsu", "ke"]}
    for k, alphabet in enumerate(alphabets.values()):
        rows += [(10**6 * (k + 1) + i, strange_words(alphabet, rng, rng.choice([40, 200, 900])), None, "s", None) for i in range(100)]
    docs = known.unionByName(written(rows))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").select("doc_id").collect()}
    labelled = {r.doc_id for r in known.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert labelled <= kept
    for k, name in enumerate(alphabets):
        assert sum(d // 10**6 == k + 1 for d in kept) <= 5, name


def test_workers_get_each_text_once(spark, written):
    docs = written(corpus())
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        if name in ("language_id", "bpe"):
            texts[name] = stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
            assert texts[name].count("MapInArrow") == 1
    assert "struct(doc_id" in texts["language_id"] and ", text, text#" not in texts["language_id"]


def test_run_is_the_stages_in_a_row(spark, written, tmp_path):
    written(corpus()).write.parquet(f"{tmp_path}/sf/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    again = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert found.count() > 0 and Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))


@pytest.mark.parametrize("clash", [True, False])
def test_messy_and_empty_tables(spark, written, messy, tmp_path, clash):
    for k, rows in enumerate((messy, [])):
        docs = written(rows, clash=clash)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}{k}")
            if name != "bpe":
                assert spark.read.parquet(f"{tmp_path}/{name}{k}").columns == docs.columns
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert rows or docs.count() == 0
