"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from its
code point and a seed. Three letters in a row are bound into one vector: the product of
their vectors, the second rolled by one place, the third by two. A text's vector is the sum
over its threes, gaps at both ends included; a language's prototype is the sum of its
training texts' vectors. A text gets the language whose prototype has the highest cosine
with it, ties to the smaller name. Sums are linear, so both count threes first and then
multiply the counts with the bound vectors, a group of texts at a time.

Training sums what tasks have counted, one vector per task and language; the prototypes,
``DIMENSIONS`` numbers per language, are all that the driver sees. Whole texts are used.

Nulls: a text that is null or has no letter is ``und`` with score 0; rows with null text or
language do not train; if nothing trains, every text is ``und``. Repeated rows count each.
The other columns are kept; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import slices
from tidemark.session import ship_package

DIMENSIONS = 512
UNKNOWN = "und"

#: A worker forgets the vectors of letter threes beyond so many; they are only a cache.
_KEPT = 60_000

#: Texts whose vectors are made in one multiplication.
_TOGETHER = 128

#: Vectors of threes are bytes and become floats so many at a time, so a worker's memory does not follow ``_KEPT``.
_BLOCK = 4096


class Binder(dict):
    """Row number of each bound three of letters; ``vectors`` holds the rows."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 5):
        super().__init__()
        self.dimensions, self.seed, self.letters = dimensions, seed, {}
        self.vectors = np.empty((1024, dimensions), np.int8)
        self.is_letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)

    def letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            found = self.letters[point] = np.random.default_rng([self.seed, point]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return found

    def __missing__(self, three: int) -> int:
        row = self[three] = len(self)
        if row == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        a, b, c = three >> 42, three >> 21 & 0x1FFFFF, three & 0x1FFFFF
        self.vectors[row] = self.letter(a) * np.roll(self.letter(b), 1) * np.roll(self.letter(c), 2)
        return row

    def threes(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of the distinct threes of a text and their counts; None without a letter."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        points[~self.is_letter[points]] = 0
        points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
        if len(points) < 3:
            return None
        keys, counts = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        return np.array([self[k] for k in keys.tolist()]), counts

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
        """The vectors of texts given as counted threes."""
        counted = np.zeros((len(texts), len(self)), np.float32)
        for i, found in enumerate(texts):
            if found:
                counted[i, found[0]] = found[1]
        return self.product(counted)

    def product(self, counted: np.ndarray) -> np.ndarray:
        """Counts of the threes by row, times their vectors. The sums are whole numbers, so blocks change no digit."""
        total = np.zeros((*counted.shape[:-1], self.dimensions), counted.dtype)
        for start in range(0, len(self), _BLOCK):
            end = min(start + _BLOCK, len(self))
            total += counted[..., start:end] @ self.vectors[start:end].astype(counted.dtype)
        return total


def profile(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each language in the training rows ``docs``."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, counted, totals = Binder(dimensions), {}, {}

        def multiply() -> None:
            for name, counts in counted.items():
                totals[name] = totals.get(name, 0) + binder.product(np.append(counts, np.zeros(max(0, len(binder) - len(counts)))))
            counted.clear()
            binder.clear()

        for batch in slices(batches):
            for words, name in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                found = binder.threes(words)
                if found:
                    counts = counted.get(name, np.empty(0))
                    if len(counts) < len(binder):
                        counts = counted[name] = np.append(counts, np.zeros(len(binder.vectors) - len(counts)))
                    counts[found[0]] += found[1]
                    if len(binder) > _KEPT:
                        multiply()
        multiply()
        if totals:
            names = [n for n in totals for _ in range(dimensions)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([*range(dimensions)] * len(totals), pa.int32()), pa.array(np.concatenate([*totals.values()]))],
                names=["lang", "place", "total"],
            )

    ship_package(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    found = rows.mapInArrow(sums, "lang string, place int, total double").groupBy("lang", "place").agg(F.sum("total").alias("total")).collect()
    prototypes: dict[str, np.ndarray] = {}
    for r in found:
        prototypes.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["total"]
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(prototypes.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with its prototype, not below 0."""
    added = {"lang_pred": pa.string(), "score": pa.float64()}
    schema = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema
    out_names, names = schema.names, docs.columns
    langs = [*prototypes]
    dimensions = len(next(iter(prototypes.values()))) if langs else DIMENSIONS
    matrix = np.array([*prototypes.values()], np.float32).reshape(len(langs), dimensions)
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(matrix)  # one row per language

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, prototype = Binder(dimensions), model.value
        for batch in slices(batches):
            texts, best = batch.column(names.index(text)).to_pylist(), []
            for start in range(0, len(texts), _TOGETHER):
                best += group(binder, prototype, texts[start : start + _TOGETHER])
                if len(binder) > _KEPT:
                    binder.clear()
            columns = dict(zip(names, batch.columns, strict=True))
            for (name, kind), values in zip(added.items(), zip(*best, strict=True) if best else [(), ()], strict=True):
                columns[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays([columns[n] for n in out_names], names=out_names)

    def group(binder: Binder, prototype: np.ndarray, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [binder.threes(t) if t and langs else None for t in texts]
        if not any(found):
            return [(UNKNOWN, 0.0)] * len(texts)
        vectors = binder.bundle(found)
        cosines = vectors @ prototype.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        at = np.argmax(cosines, axis=1)
        scores = np.clip(cosines[np.arange(len(texts)), at], 0, 1).tolist()
        return [(langs[k], score) if f else (UNKNOWN, 0.0) for f, k, score in zip(found, at.tolist(), scores, strict=True)]

    return docs.mapInArrow(predict, schema)
