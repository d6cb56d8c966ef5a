"""Expressions over rings (``array<struct<x,y>>``) that stay inside the row they arrived in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from tidemark.session import ship_package


def ring_edges(ring: Column) -> Column:
    """Each vertex with the next one; the last is joined to the first."""

    def edge(p: Column, i: Column) -> Column:
        following = F.get(ring, (i + 1) % F.size(ring))
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), following["x"].alias("x2"), following["y"].alias("y2"))

    return F.transform(ring, edge)


def ring_area(ring: Column) -> Column:
    """Shoelace area without its sign."""
    twice = F.aggregate(
        ring_edges(ring), F.lit(0.0), lambda total, e: total + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    )
    return F.abs(twice) / F.lit(2.0)


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of (x, y) meets the edges an odd number of times."""

    def meets(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        slope = F.try_divide(y - e["y1"], e["y2"] - e["y1"])
        return straddles & F.coalesce(e["x1"] + slope * (e["x2"] - e["x1"]) > x, F.lit(False))

    return F.size(F.filter(edges, meets)) % 2 == 1


def inside_rings(edge_rings: Column, x: Column, y: Column) -> Column:
    """Inside the first ring and in none of the others; no rings hold nothing."""
    holes = F.filter(edge_rings, lambda ring, i: (i > 0) & odd_crossings(ring, x, y))
    return (F.size(edge_rings) > 0) & odd_crossings(F.get(edge_rings, F.lit(0)), x, y) & (F.size(holes) == 0)


def inside_parts(parts: Column, x: Column, y: Column) -> Column:
    """Inside any part of a zone."""
    return F.exists(parts, lambda rings: inside_rings(F.transform(rings, ring_edges), x, y))


def _kept_vertices(x: np.ndarray, y: np.ndarray, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker flags for many rings at once, one pass per depth instead of per ring.

    ``starts`` holds each ring's offset and the total length. Every open stretch of
    every ring finds its farthest vertex in the same vector operations.
    """
    keep = np.zeros(len(x), dtype=bool)
    first, last = starts[:-1], starts[1:] - 1
    filled = last >= first
    first, last = first[filled], last[filled]
    keep[first] = True
    keep[last] = True
    while True:
        wide = last - first > 1
        first, last = first[wide], last[wide]
        if not len(first):
            return keep
        inner = last - first - 1
        offsets = np.concatenate(([0], np.cumsum(inner)[:-1]))
        owner = np.repeat(np.arange(len(first)), inner)
        vertex = first[owner] + 1 + np.arange(inner.sum()) - offsets[owner]
        x1, y1, x2, y2 = x[first][owner], y[first][owner], x[last][owner], y[last][owner]
        dx, dy = x2 - x1, y2 - y1
        span = np.hypot(dx, dy)
        flat = span == 0
        to_line = np.abs(dy * x[vertex] - dx * y[vertex] + x2 * y1 - y2 * x1) / np.where(flat, 1.0, span)
        distance = np.where(flat, np.hypot(x[vertex] - x1, y[vertex] - y1), to_line)
        worst = np.maximum.reduceat(distance, offsets)
        far = np.minimum.reduceat(np.where(distance == worst[owner], vertex, len(x)), offsets)
        split = worst > tolerance
        keep[far[split]] = True
        first, last = (
            np.concatenate((first[split], far[split])),
            np.concatenate((far[split], last[split])),
        )


def simplify_ring(ring: Column, tolerance: float) -> Column:
    """The ring without the vertices that lie within the tolerance of the line kept.

    The only Python step: coordinates go out as Arrow lists, one flag per vertex comes back.
    """

    @F.pandas_udf(ArrayType(BooleanType()))
    def flags(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            sizes = xs.map(len).to_numpy(dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            if starts[-1] == 0:
                yield pd.Series([[] for _ in sizes])
                continue
            keep = _kept_vertices(
                np.concatenate(xs.to_list()).astype(float), np.concatenate(ys.to_list()).astype(float), starts, tolerance
            )
            yield pd.Series(np.split(keep, starts[1:-1]))

    ship_package(SparkSession.active())
    # Non-deterministic keeps a filter on the result from running it a second time.
    kept = flags.asNondeterministic()(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))
    return F.transform(
        F.filter(F.arrays_zip(ring.alias("p"), kept.alias("k")), lambda z: z["k"]), lambda z: z["p"]
    )
