"""BPE encoding and decoding with an automaton compiled from the merges.

The automaton's states are "the last token was u" (and a start state); an arc labelled v says
that token v may come next. It starts with every base symbol after every other. The merges
are built in one after the other: the gadget of (a, b) -> c cuts the arc b after a, gives
every state with an arc a an arc c, and gives c the arcs that b had. A merge whose arc is
already cut can never apply and builds nothing. What is kept is which gadget made and cut
which arcs; whether an arc stands is read off those tables by following c back to its parts.
Once all merges are in, exactly one path spells a word, so a word is encoded from left to
right: of the tokens that end at a place, one has an arc from the state at its start.
Decoding emits the labels along the path.

Works for ``tokenizers`` files of the kind: NFC and lower case, words cut by a pattern, byte
level symbols, a suffix at word ends, no decoder. Special tokens are recognised in texts.
Letters are what the workers' Unicode tables call so; a code point that is newer than the
tables of the one library and not of the other can be cut differently.

Ids are packed as little-endian unsigned 32-bit integers in a binary column, as token files
hold them. Nulls: a null text is empty, and an empty text has no ids and decodes to an empty
text; ids that are null decode to null. Repeated rows are encoded each. Extra columns are kept.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import slices
from tidemark.session import ship_package

#: A worker drops encoded words not met since so many others, and arcs beyond so many; both are
#: only a cache.
WORDS_KEPT, ARCS_KEPT = 150_000, 250_000

@dataclass
class Automaton:
    labels: list[str]
    suffix: str
    pattern: str
    special: dict[str, int]
    born: list[int] = field(default_factory=list)  # the gadget that made a token; 0: base symbol
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    cut: dict[tuple[int, int], int] = field(default_factory=dict)  # the gadget that cut an arc
    inner: dict[str, int] = field(default_factory=dict)  # text of a token -> id, not at a word's end
    final: dict[str, int] = field(default_factory=dict)  # the same at a word's end

    @cached_property
    def encoder(self) -> Encoder:
        """One for all tasks of a worker, so that they share what it has looked up."""
        return Encoder(self)

    def follows(self, u: int, v: int, time: int) -> bool:
        """Whether token v may come after u once the first ``time`` gadgets are built in."""
        born, cut = self.born, self.cut
        while cut.get((u, v), time + 1) > time:
            if born[u] > born[v]:
                u, time = self.right[u], born[u] - 1
            elif born[v]:
                v, time = self.left[v], born[v]
            else:
                return True
        return False


def compile_automaton(spec: dict) -> Automaton:
    """The automaton of a ``tokenizers`` file read as JSON."""
    model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"]:
        raise ValueError("not a lower-casing word BPE with byte level symbols")
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [""] * (1 + max([*vocab.values(), *special.values()]))
    for text, i in [*vocab.items(), *special.items()]:
        labels[i] = text
    size = len(labels)
    made = {vocab[a + b] for a, b in model["merges"]}
    live = [i not in made for i in range(size)]
    auto = Automaton(labels, suffix, steps[0]["pattern"]["Regex"], special, [0] * size, [-1] * size, [-1] * size)
    for time, (a, b) in enumerate(model["merges"], 1):
        u, v, c = vocab[a], vocab[b], vocab[a + b]
        if live[u] and live[v] and auto.follows(u, v, time - 1):
            auto.born[c], auto.left[c], auto.right[c], auto.cut[u, v], live[c] = time, u, v, time, True
    for text, i in vocab.items():
        if live[i]:
            known, bare = (auto.final, text.removesuffix(suffix)) if text.endswith(suffix) else (auto.inner, text)
            known[bare] = i
    return auto


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class Encoder(dict):
    """A worker's view of the automaton; as a dict, the packed ids of words already met."""

    def __init__(self, auto: Automaton):
        super().__init__()
        self.auto = auto
        self.arcs: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}
        self.steps: dict[str, list] = {}  # symbol -> [further steps, token here, token here if the word ends]
        for place, known in ((1, auto.inner), (2, auto.final)):
            for label, token in known.items():
                steps = self.steps
                for symbol in label:
                    entry = steps.setdefault(symbol, [{}, -1, -1])
                    steps = entry[0]
                entry[place] = token
        self.symbols = byte_symbols()
        self.find_words = regex.compile(auto.pattern).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(auto.special, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(word)
        if packed is None:
            ids = self.path(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = packed
        return packed

    def arc(self, u: int, v: int) -> bool:
        """Whether the arc v leaves the state after u; what is looked up stays in ``arcs``."""
        if len(self.arcs) >= ARCS_KEPT:
            self.arcs.clear()
        stands = self.arcs[u << 32 | v] = self.auto.follows(u, v, len(self.auto.labels))
        return stands

    def path(self, word: str) -> list[int]:
        """The ids of a word: the one path through the automaton that spells it.

        Longest arcs are tried first. Only one path can reach a place, so a place from which
        no arc leads on is never tried again.
        """
        text = word.encode().decode("latin-1").translate(self.symbols)
        size, arcs = len(text), self.arcs
        whole = self.auto.final.get(text)
        if whole is not None:
            return [whole]
        ids, ends, dead = [], [0], set()
        limit = size  # arcs from the last place must not end beyond this
        while True:
            begin, steps, found = ends[-1], self.steps, []
            for place in range(begin, limit):
                entry = steps.get(text[place])
                if entry is None:
                    break
                steps = entry[0]
                token = entry[1] if place + 1 < size else entry[2]
                if token >= 0:
                    found.append((place + 1, token))
            for end, token in reversed(found):
                if end in dead:
                    continue
                if ids:
                    stands = arcs.get(ids[-1] << 32 | token)
                    if not (self.arc(ids[-1], token) if stands is None else stands):
                        continue
                ids.append(token)
                if end == size:
                    return ids
                ends.append(end)
                limit = size
                break
            else:
                dead.add(ends.pop())
                ids.pop()
                limit = begin - 1

    def words(self, text: str) -> list[str]:
        """Lower-cased letter by letter: a capital sigma has one small form, also at a word's end."""
        return self.find_words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> bytes:
        out, done = [], 0
        for special in self.specials.finditer(text):
            out += [*map(self.__getitem__, self.words(text[done : special.start()])), struct.pack("<I", self.auto.special[special[0]])]
            done = special.end()
        out += map(self.__getitem__, self.words(text[done:] if done else text))
        return b"".join(out)


def load_automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        return compile_automaton(json.load(file))


def encode(docs: DataFrame, automaton, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the packed ids of each whole text. ``automaton``: broadcast by ``spread``."""
    schema, names = docs.withColumn(ids, F.lit("").cast("binary")).schema, docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = automaton.value.encoder
        for batch in slices(batches):
            packed = [encoder.encode(t) if t else b"" for t in batch.column(names.index(text)).to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True)) | {ids: pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, automaton, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the labels of packed ids, joined by spaces, as a file without decoder asks for."""
    schema, names = docs.withColumn(text, F.lit(None).cast("string")).schema, docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(automaton.value.labels, object)
        for batch in slices(batches):
            joined = [spelled(labels, p) for p in batch.column(names.index(ids)).to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True)) | {text: pa.array(joined, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def spelled(labels: np.ndarray, packed: bytes | None) -> str | None:
    """The labels of packed ids, joined by spaces."""
    return None if packed is None else " ".join(labels[np.frombuffer(packed, "<u4")].tolist())


def encode_and_back(docs: DataFrame, automaton, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one worker a task, without the text: it holds one automaton and gets no ids back."""
    schema, names = docs.drop(text).withColumns({ids: F.lit("").cast("binary"), decoded: F.lit(None).cast("string")}).schema, docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, labels = automaton.value.encoder, np.array(automaton.value.labels, object)
        for batch in slices(batches):
            packed = [encoder.encode(t) if t else b"" for t in batch.column(names.index(text)).to_pylist()]
            joined = [spelled(labels, p) for p in packed]
            columns = dict(zip(names, batch.columns, strict=True)) | {ids: pa.array(packed, pa.binary()), decoded: pa.array(joined, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def spread(spark: SparkSession, automaton: Automaton):
    """The automaton on all executors; its size is that of the vocabulary."""
    ship_package(spark)
    return spark.sparkContext.broadcast(automaton)
