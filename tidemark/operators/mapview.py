"""Zones as drawable shapes, and the shading of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import FRAME_UNITS, SHADE_BREAKS, SIMPLIFY_TOLERANCE, TAP_RADIUS_PIXELS
from tidemark.functions.geometry import simplify_ring
from tidemark.functions.measures import round_even_1
from tidemark.operators.spatial import part_areas, zone_bounds


def projection(zones: DataFrame) -> Column:
    """One coordinate frame for all zones, as a scalar subquery: scale_x, min_x, max_y, span."""
    bounds = zone_bounds(zones)
    middle = (F.col("min_y") + F.col("max_y")) / F.lit(2.0)
    extent = bounds.agg(
        F.cos(F.radians(F.avg(middle))).alias("scale_x"),
        F.min("min_x").alias("lo_x"), F.max("max_x").alias("hi_x"),
        F.min("min_y").alias("lo_y"), F.max("max_y").alias("hi_y"),
    )
    width = F.col("hi_x") * F.col("scale_x") - F.col("lo_x") * F.col("scale_x")
    return extent.select(
        F.struct(
            "scale_x",
            (F.col("lo_x") * F.col("scale_x")).alias("min_x"),
            F.col("hi_y").alias("max_y"),
            F.greatest(width, F.col("hi_y") - F.col("lo_y")).alias("span"),
        ).alias("frame")
    ).scalar()


def project(ring: Column, frame: Column) -> Column:
    """The ring in frame units, one decimal. Placing comes before rounding, which reads its value many times."""
    units = F.lit(float(FRAME_UNITS))
    placed = F.transform(
        ring,
        lambda p: F.struct(
            ((p["x"] * frame["scale_x"] - frame["min_x"]) / frame["span"] * units).alias("x"),
            ((frame["max_y"] - p["y"]) / frame["span"] * units).alias("y"),
        ),
    )
    return F.transform(placed, lambda p: F.struct(round_even_1(p["x"]).alias("x"), round_even_1(p["y"]).alias("y")))


def drawn_parts(zones: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """Outer rings worth drawing, simplified; parts left with fewer than three points are dropped."""
    kept = part_areas(zones).where(~F.col("sliver"))
    outer = F.get("rings", F.lit(0))
    reduced = kept.select("pos", "zone", "name", "part", "area", F.size(outer).alias("vertices"), outer.alias("_outer"))
    return reduced.withColumn("ring", simplify_ring(F.col("_outer"), tolerance)).drop("_outer").where(F.size("ring") >= 3)


def projected_parts(zones: DataFrame, off_frame: list[int] = (), tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """Drawn parts in frame units; zones off the frame take no part in fitting it."""
    shown = zones.where(~F.col("zone").isin(*off_frame)) if off_frame else zones
    framed = drawn_parts(shown, tolerance).withColumn("_frame", projection(shown))
    return framed.withColumn("ring", project(F.col("ring"), F.col("_frame"))).drop("_frame")


def zone_outlines(parts: DataFrame) -> DataFrame:
    """Path text and area-weighted vertex centre per zone. A zone gathers only its own parts' paths."""
    vertex = F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    path = F.concat(F.lit("M"), F.array_join(vertex, "L"), F.lit("Z"))
    lean = parts.select(
        "pos", "zone", "name", "part", path.alias("_path"),
        F.aggregate("ring", F.lit(0.0), lambda t, p: t + p["x"] * F.col("area")).alias("_x"),
        F.aggregate("ring", F.lit(0.0), lambda t, p: t + p["y"] * F.col("area")).alias("_y"),
        (F.col("area") * F.size("ring")).alias("_w"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("part", "_path")))
    weight = F.nullif(F.sum("_w"), F.lit(0.0))
    return lean.groupBy("pos", "zone", "name").agg(
        F.array_join(F.transform(ordered, lambda e: e["_path"]), "").alias("path"),
        round_even_1(F.sum("_x") / weight).alias("cx"),
        round_even_1(F.sum("_y") / weight).alias("cy"),
    )


def _vertices(parts: DataFrame) -> DataFrame:
    # An inner explode filters by the ring's size first, and so would place and round every ring once more.
    points = parts.select("zone", "name", F.explode_outer("ring").alias("_p")).where(F.col("_p").isNotNull())
    return points.select("zone", "name", "_p.x", "_p.y")


def frame_box(parts: DataFrame, zoom: float = 1.0) -> DataFrame:
    """The view box fitted to what is drawn: one row ``left, top, width, height``."""
    ink = _vertices(parts).agg(
        F.min("x").alias("_l"), F.min("y").alias("_t"), F.max("x").alias("_r"), F.max("y").alias("_b")
    )
    inset = (1 - 1 / zoom) / 2
    width, height = F.col("_r") - F.col("_l"), F.col("_b") - F.col("_t")
    return ink.select(
        round_even_1(F.col("_l") + width * F.lit(inset)).alias("left"),
        round_even_1(F.col("_t") + height * F.lit(inset)).alias("top"),
        round_even_1(width / F.lit(zoom)).alias("width"),
        round_even_1(height / F.lit(zoom)).alias("height"),
    )


def clipped_shares(parts: DataFrame, zoom: float) -> DataFrame:
    """Share of each zone's outline outside the view box, for zones the box cuts."""
    box = frame_box(parts, zoom).select(F.struct("*").alias("box")).scalar()
    vertices = _vertices(parts).withColumn("_b", box)
    outside = (
        (F.col("x") < F.col("_b.left"))
        | (F.col("y") < F.col("_b.top"))
        | (F.col("x") > F.col("_b.left") + F.col("_b.width"))
        | (F.col("y") > F.col("_b.top") + F.col("_b.height"))
    )
    return (
        vertices.groupBy("zone", "name")
        .agg(F.count_if(outside).alias("outside"), F.count(F.lit(1)).alias("vertices"))
        .where(F.col("outside") > 0)
        .withColumn("share", F.col("outside") / F.col("vertices"))
    )


def worst_clipped(shares: DataFrame, k: int = 6) -> DataFrame:
    return shares.orderBy(F.desc("share"), "zone").limit(k)


def drawing_counts(zones: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """Parts and outer vertices before and after trimming and simplifying: one row."""
    rows = part_areas(zones)
    outer = F.get("rings", F.lit(0))
    ring = F.when(~F.col("sliver"), simplify_ring(outer, tolerance))
    sized = rows.select("sliver", F.size(outer).alias("_before"), ring.alias("_ring")).select(
        "sliver", "_before", F.size("_ring").alias("_after")
    )
    kept = ~F.col("sliver")
    return sized.agg(
        F.count_if(F.col("sliver")).alias("parts_dropped"),
        F.count_if(kept & (F.col("_after") >= 3)).alias("parts_drawn"),
        F.sum(F.when(kept, F.col("_before"))).alias("vertices_before"),
        F.sum(F.when(kept & (F.col("_after") >= 3), F.col("_after"))).alias("vertices_after"),
    )


def tap_radius(frame_width: float, screen_width: float, pixels: int = TAP_RADIUS_PIXELS) -> float:
    """The screen distance within which a tap picks the nearest zone, in frame units."""
    return pixels * frame_width / screen_width


def shade(comparison: DataFrame, value: Column) -> DataFrame:
    """Colour step and legend ends per airport, block and zone.

    An airport and block has at most one row per zone; its values are ranked there, and the breaks
    are read off the ranks in the same partitioning: the comparison is worked out once.
    """
    keys = ["airport", "block"]
    whole = Window.partitionBy(*keys)
    ranked = comparison.select(*keys, "zone", value.alias("value")).where(F.col("value").isNotNull()).select(
        *keys, "zone", "value",
        (F.row_number().over(whole.orderBy("value")) - 1).alias("_rank"), F.count(F.lit(1)).over(whole).alias("_n"),
    )
    at_rank = [F.max(F.when(F.col("_rank") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("value"))).over(whole) for q in SHADE_BREAKS]
    breaks = ranked.select(
        *keys, "zone", "value", F.array(*at_rank).alias("_breaks"), F.min("value").over(whole).alias("legend_low"), F.max("value").over(whole).alias("legend_high")
    )
    step = F.size(F.filter("_breaks", lambda b: F.col("value") > b))
    return breaks.select(*keys, "zone", "value", step.alias("step"), "legend_low", "legend_high")
