"""Zone geometry and the joins of points to zones.

A zone is one row, as its record arrives: parts -> rings -> points. Measuring,
trimming and indexing a zone happen inside that row and move no data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import SLIVER_SHARE
from tidemark.functions.geometry import inside_rings, ring_area, ring_edges


def zone_bounds(zones: DataFrame) -> DataFrame:
    """Box around every coordinate of a zone; a zone without any has none."""
    flat = F.flatten(F.flatten("parts"))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return zones.where(F.size(flat) > 0).select(
        "pos", "zone",
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def part_areas(zones: DataFrame) -> DataFrame:
    """One row per part: its outer ring's area and the zone's largest; slivers are marked."""
    areas = F.transform("parts", lambda rings: ring_area(F.get(rings, F.lit(0))))
    largest = zones.withColumn("_areas", areas).withColumn("largest", F.array_max("_areas"))
    rows = largest.select(
        "pos", "zone", "name", "largest", "_areas", F.posexplode("parts").alias("part", "rings")
    )
    area = F.get("_areas", F.col("part"))
    sliver = (F.col("largest") > 0) & (area < F.col("largest") * F.lit(SLIVER_SHARE))
    return rows.select(
        "pos", "zone", "name", "part", "rings", area.alias("area"), "largest", F.coalesce(sliver, F.lit(False)).alias("sliver")
    )


def edge_rows(zones: DataFrame) -> DataFrame:
    """Every edge of every ring as a row."""
    rings = zones.select("zone", F.posexplode("parts").alias("part", "_rings")).select(
        "zone", "part", F.posexplode("_rings").alias("ring", "_ring")
    )
    return rings.select("zone", "part", "ring", F.posexplode(ring_edges(F.col("_ring"))).alias("seq", "_e")).select(
        "zone", "part", "ring", "seq", "_e.*"
    )


def _banded(zones: DataFrame, cell: float, band: float) -> DataFrame:
    """Parts cut into grid columns and horizontal bands, each with only the edges that reach its band."""
    parts = zones.select("pos", "zone", F.explode("parts").alias("_rings")).where(
        (F.size("_rings") > 0) & (F.size(F.get("_rings", F.lit(0))) > 0)
    )
    outer = F.get("_rings", F.lit(0))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    boxed = parts.select(
        "pos", "zone",
        F.transform("_rings", ring_edges).alias("_edges"),
        F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
        F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"),
    )
    rows = boxed.withColumn(
        "_band", F.explode(F.sequence(F.floor(F.col("min_y") / F.lit(band)), F.floor(F.col("max_y") / F.lit(band))))
    )
    # Points find their band by division; a little room keeps edges that rounding puts on its border.
    room = F.lit(band * 1e-9) + F.abs(F.col("_band") * F.lit(band)) * F.lit(1e-12)
    low, high = F.col("_band") * F.lit(band) - room, (F.col("_band") + 1) * F.lit(band) + room
    reaching = F.transform(
        "_edges",
        lambda ring: F.filter(ring, lambda e: (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low)),
    )
    return rows.withColumn("_edges", reaching).withColumn(
        "_col", F.explode(F.sequence(F.floor(F.col("min_x") / F.lit(cell)), F.floor(F.col("max_x") / F.lit(cell))))
    )


def locate(points: DataFrame, zones: DataFrame, cell: float, band: float) -> DataFrame:
    """``point, zone`` for every point inside a zone; the zone listed first wins.

    An equi-join on grid column and band, then the box and the crossing count on the
    few edges of that band. Estimates do not see how often a zone is filed, so neither
    side is broadcast; a crowded grid cell is split by the adaptive skew join.
    """
    placed = points.withColumn("_col", F.floor(F.col("x") / F.lit(cell))).withColumn("_band", F.floor(F.col("y") / F.lit(band)))
    index = _banded(zones, cell, band)
    boxed = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    found = placed.join(index.hint("merge"), ["_col", "_band"]).where(boxed & inside_rings(F.col("_edges"), F.col("x"), F.col("y")))
    return found.groupBy("point").agg(F.min_by("zone", "pos").alias("zone"))


def nearest(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """The closest centre within the radius of every point, the first listed on a tie.

    Centres are filed under the nine cells around them, so a point meets only
    centres of its own cell. Centres at the same place are reduced to the first before.
    """
    distinct = centres.groupBy("cx", "cy").agg(F.min(F.struct("pos", "zone")).alias("_c"))
    near = F.sequence(F.lit(-1), F.lit(1))
    filed = (
        distinct.withColumn("_dx", F.explode(near))
        .withColumn("_dy", F.explode(near))
        .select(
            "cx", "cy", "_c",
            (F.floor(F.col("cx") / F.lit(radius)) + F.col("_dx")).alias("_col"),
            (F.floor(F.col("cy") / F.lit(radius)) + F.col("_dy")).alias("_row"),
        )
    )
    placed = points.withColumn("_col", F.floor(F.col("x") / F.lit(radius))).withColumn("_row", F.floor(F.col("y") / F.lit(radius)))
    distance = F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"))
    first = Window.partitionBy("point").orderBy("distance", "_pos")
    return (
        placed.join(filed.hint("merge"), ["_col", "_row"])
        .select("point", distance.alias("distance"), F.col("_c.pos").alias("_pos"), F.col("_c.zone").alias("zone"))
        .where(F.col("distance") <= radius)
        .withColumn("_n", F.row_number().over(first))  # limited per point before the shuffle
        .where("_n = 1")
        .select("point", "zone", "distance")
    )
