import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.geometry import _kept_vertices, inside_parts, ring_area, simplify_ring
from tidemark.operators import spatial
from tidemark.sources.documents import POINT, zone_shapes

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
HOLE = [(3.0, 3.0), (3.0, 7.0), (7.0, 7.0), (7.0, 3.0)]
FAR = [(100.0, 100.0), (100.0, 110.0), (110.0, 110.0), (110.0, 100.0)]
NOTCHED = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 7.0), (4.0, 7.0), (4.0, 3.0), (10.0, 3.0), (10.0, 0.0)]
ZONE = f"pos bigint, zone bigint, name string, parts array<array<array<{POINT}>>>"


def zones(spark, *shapes):
    return spark.createDataFrame([(i, i, f"z{i}", parts) for i, parts in enumerate(shapes)], ZONE)


def inside(spark, parts, x, y):
    return zones(spark, parts).select(inside_parts(F.col("parts"), F.lit(x), F.lit(y))).first()[0]


def test_known_shapes(spark):
    assert inside(spark, [[SQUARE]], 5.0, 5.0)
    assert not any(inside(spark, [[SQUARE]], x, y) for x, y in ((15.0, 5.0), (5.0, 15.0), (-1.0, 5.0)))
    assert inside(spark, [[SQUARE, HOLE]], 1.0, 1.0) and not inside(spark, [[SQUARE, HOLE]], 5.0, 5.0)
    assert inside(spark, [[SQUARE], [FAR]], 105.0, 105.0) and not inside(spark, [[SQUARE], [FAR]], 50.0, 50.0)
    assert not inside(spark, [], 1.0, 1.0) and not inside(spark, [[]], 1.0, 1.0)
    assert [inside(spark, [[NOTCHED]], x, y) for x, y in ((2.0, 5.0), (7.0, 5.0), (7.0, 1.0))] == [True, False, True]


def star(rng, cx, cy, corners):
    return [
        (cx + r * math.cos(a), cy + r * math.sin(a))
        for a, r in ((2 * math.pi * i / corners, rng.uniform(2, 12)) for i in range(corners))
    ]


def crossings(ring, x, y):
    """Winding by angle, a test of its own kind."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        a = math.atan2(y2 - y, x2 - x) - math.atan2(y1 - y, x1 - x)
        total += (a + math.pi) % (2 * math.pi) - math.pi
    return abs(total) > math.pi


def test_locate_against_brute_force(spark):
    rng = random.Random(2)
    shapes = [[[star(rng, rng.uniform(0, 60), rng.uniform(-30, 30), rng.randrange(3, 40))]] for _ in range(25)]
    points = [(i, rng.uniform(-10, 70), rng.uniform(-40, 40)) for i in range(1500)]
    expected = {}
    for i, x, y in points:
        for z, parts in enumerate(shapes):
            if crossings(parts[0][0], x, y):
                expected[i] = z
                break
    assert 200 < len(expected) < 1500
    pts = spark.createDataFrame(points, "point bigint, x double, y double")
    for cell, band in ((7.0, 3.0), (50.0, 1.0), (1.5, 25.0)):
        found = spatial.locate(pts, zones(spark, *shapes), cell, band)
        assert {r.point: r.zone for r in found.collect()} == expected


def test_first_zone_wins(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 50.0)], "point bigint, x double, y double")
    found = spatial.locate(pts, zones(spark, [[SQUARE, HOLE]], [[SQUARE]], [[SQUARE]]), 4.0, 4.0)
    assert [(r.point, r.zone) for r in found.collect()] == [(1, 1)]


def test_nearest_against_brute_force(spark):
    rng = random.Random(4)
    centres = [(i, i, rng.randrange(0, 30) * 1.0, rng.randrange(0, 30) * 1.0) for i in range(120)]
    points = [(i, rng.uniform(-5, 35), rng.uniform(-5, 35)) for i in range(800)]
    radius = 1.7
    expected = {}
    for i, x, y in points:
        d, z = min((math.hypot(cx - x, cy - y), z) for _, z, cx, cy in centres)
        if d <= radius:
            expected[i] = z
    found = spatial.nearest(
        spark.createDataFrame(points, "point bigint, x double, y double"),
        spark.createDataFrame(centres, "pos bigint, zone bigint, cx double, cy double"), radius,
    )
    assert {r.point: r.zone for r in found.collect()} == expected


def recursive_keep(points, tolerance):
    if len(points) < 3:
        return points
    (x1, y1), (x2, y2) = points[0], points[-1]
    span = math.hypot(x2 - x1, y2 - y1)

    def away(p):
        if span == 0:
            return math.hypot(p[0] - x1, p[1] - y1)
        return abs((x2 - x1) * (y1 - p[1]) - (x1 - p[0]) * (y2 - y1)) / span

    at = max(range(1, len(points) - 1), key=lambda i: away(points[i]))
    if away(points[at]) <= tolerance:
        return [points[0], points[-1]]
    return recursive_keep(points[: at + 1], tolerance)[:-1] + recursive_keep(points[at:], tolerance)


def test_simplify_against_recursion(spark):
    rng = random.Random(9)
    rings = [star(rng, 0, 0, rng.randrange(1, 120)) for _ in range(60)]
    rings += [r + r[:1] for r in rings[:10]] + [[], [(1.0, 1.0)], [(1.0, 1.0)] * 5]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"id int, ring array<{POINT}>")
    for tolerance in (0.5, 3.0):
        found = {r.id: [tuple(p) for p in r.kept] for r in df.select("id", simplify_ring(F.col("ring"), tolerance).alias("kept")).collect()}
        for i, ring in enumerate(rings):
            assert found[i] == recursive_keep(ring, tolerance), i


def test_kept_vertices_of_nothing():
    assert _kept_vertices(np.array([]), np.array([]), np.array([0]), 1.0).tolist() == []


def test_area_bounds_and_slivers(spark):
    tiny = [(500.0, 0.0), (500.0, 0.3), (500.3, 0.3), (500.3, 0.0)]
    df = zones(spark, [[SQUARE, HOLE], [tiny]], [])
    assert df.where("zone = 0").select(ring_area(F.col("parts")[0][0])).first()[0] == 100.0
    box = spatial.zone_bounds(df).collect()
    assert [tuple(b)[1:] for b in box] == [(0, 0.0, 0.0, 500.3, 10.0)]
    assert [(r.part, r.sliver) for r in spatial.part_areas(df).collect()] == [(0, False), (1, True)]


def test_geojson_kinds(spark):
    rows = [
        (0, "10", "a", '{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1]],[[0.2,0.2],[0.2,0.3],[0.3,0.3]]]}'),
        (1, "11", "b", '{"type":"MultiPolygon","coordinates":[[[[0,0],[0,1],[1,1]]],[[[5,5],[5,6],[6,6]]]]}'),
        (2, "12", "c", '{"type":"Point","coordinates":[5,5]}'),
        (3, "13", "d", None),
        (4, "14", "e", '{"type":"Polygon","coordinates":[]}'),
    ]
    found = zone_shapes(spark.createDataFrame(rows, "pos int, locationid string, name string, the_geom string")).collect()
    assert [(r.zone, r.kind, [len(p) for p in r.parts]) for r in found] == [(10, "Polygon", [2]), (11, "MultiPolygon", [1, 1]), (12, "Point", [])]
