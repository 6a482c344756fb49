import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gabarit.operators.spatial import bad_rings, ear_clip, located, near_pairs, regions_of_points

R = 6371008.8


def haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


def area(ring):
    return abs(sum(ring[k - 1][0] * p[1] - p[0] * ring[k - 1][1] for k, p in enumerate(ring))) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.2, 5.0), min_size=3, max_size=25))
def test_ear_clipping_keeps_the_area(radii):
    ring = [(r * math.cos(2 * math.pi * k / len(radii)), r * math.sin(2 * math.pi * k / len(radii))) for k, r in enumerate(radii)]
    triangles = ear_clip(ring)
    assert sum(area([ring[i] for i in t]) for t in triangles) == pytest.approx(area(ring), rel=1e-9)
    assert ear_clip(ring[::-1])


def test_ear_clipping_of_degenerate_rings():
    assert ear_clip([]) == [] and ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2)]) == []
    straight = [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]
    assert sum(area([straight[i] for i in t]) for t in ear_clip(straight)) == 4


def test_regions_against_brute_force(spark):
    rng = random.Random(1)
    regions = []
    for k in range(25):
        cx, cy, s = rng.uniform(34, 36), rng.uniform(29, 33), rng.choice([0.01, 0.1, 1.0])
        radii = [rng.uniform(0.4, 1.0) for _ in range(rng.randint(3, 12))]
        regions.append((f"r{k}", [[cx + s * r * math.cos(2 * math.pi * i / len(radii)), cy + s * r * math.sin(2 * math.pi * i / len(radii))] for i, r in enumerate(radii)]))
    regions += [("square", [[34.0, 30.0], [35.0, 30.0], [35.0, 31.0], [34.0, 31.0], [34.0, 30.0]]), ("none", None), ("flat", [[1.0, 1.0], [2.0, 2.0]])]
    points = [(f"p{k}", rng.uniform(33.5, 36.5), rng.uniform(28.5, 33.5)) for k in range(400)] + [("diagonal", 34.5, 30.5), ("corner", 34.0, 30.0), ("lost", None, 1.0)]

    def inside(p, ring):
        if ring[0] == ring[-1]:
            ring = ring[:-1]
        odd = False
        for k, (x1, y1) in enumerate(ring):
            x0, y0 = ring[k - 1]
            if (y1 > p[2]) != (y0 > p[2]) and p[1] < (x0 - x1) * (p[2] - y1) / (y0 - y1) + x1:
                odd = not odd
        return odd

    want = {(p[0], r[0]) for p in points[:401] for r in regions[:26] if inside(p, r[1])} | {("corner", "square")}
    want |= {("corner", r[0]) for r in regions[:25] if inside(points[401], r[1])}
    df = regions_of_points(spark.createDataFrame(points + points[:5], "point_id string, x double, y double"), spark.createDataFrame(regions, "region_id string, ring array<array<double>>"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(2)
    points = [(f"i{k:04d}", 35 + rng.uniform(0, 0.01), 31 + rng.uniform(0, 0.01)) for k in range(300)]
    points += [(f"h{k:03d}", 35.5, 32.0) for k in range(40)] + [("far", 0.5, 60.0), ("twice", 35.5, 32.0), ("twice", 35.50001, 32.0)]  # a crowd at one place; one id at two
    want = set()
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if a[0] != b[0] and haversine(a[1:], b[1:]) <= 30:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [(r.id_a, r.id_b) for r in near_pairs(spark.createDataFrame(points, "id string, x double, y double"), 30.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_crowded_nodes_are_split(spark):
    from pyspark.sql import functions as F

    from gabarit.operators.spatial import points_in_triangles

    pts = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(35.0).alias("x"), F.lit(31.0).alias("y"))
    tri = spark.createDataFrame([("a", 0, 34.9, 30.9, 35.1, 30.9, 35.0, 31.2, 10)], "region_id string, tri int, ax double, ay double, bx double, by double, cx double, cy double, level int")
    assert points_in_triangles(pts, tri, [10], hot=50).count() == 500
    many = tri.crossJoin(spark.range(300).select(F.col("id").cast("string").alias("k"))).select(F.concat("region_id", "k").alias("region_id"), *tri.columns[1:])
    assert points_in_triangles(pts, many, [10], hot=50).select("id", "region_id").distinct().count() == points_in_triangles(pts, many, [10], hot=50).count() == 500 * 300


def test_meridian_and_poles(spark):
    points = [("a", 179.99995, 10.0), ("b", -179.99995, 10.0), ("c", 180.0, 10.00001), ("d", -180.0, 10.0001), ("n1", 0.0, 89.9999), ("n2", 180.0, 89.9999), ("n3", 90.0, 89.99995), ("n4", -90.0, 90.0), ("s1", -170.0, -89.9999), ("s2", 10.0, -89.99995), ("m", 0.0, 89.9), ("k", 0.1, 89.9), ("far", 0.0, 0.0)]
    rng = random.Random(11)
    points += [(f"p{k}", rng.uniform(-180, 180), 90 - rng.random() * 0.0004) for k in range(60)] + [(f"w{k}", (180 + rng.uniform(-0.0005, 0.0005)) % 360 - 360 * (rng.random() < 0), 45 + rng.uniform(0, 0.0005)) for k in range(40)]
    points = [(i, x - 360 if x > 180 else x, y) for i, x, y in points]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(points) for b in points[k + 1 :] if haversine(a[1:], b[1:]) <= 30}
    got = [(r.id_a, r.id_b) for r in near_pairs(spark.createDataFrame(points, "id string, x double, y double"), 30.0).collect()]
    assert {("a", "b"), ("n1", "n2"), ("s1", "s2"), ("m", "k")} - {("m", "k")} <= want and len(got) == len(set(got)) and set(got) == want


def test_holes_and_bad_rings(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    regions = [("ring", square(0.0, 10.0), [square(2.0, 4.0), square(6.0, 8.0)[::-1]]), ("bow", [[20.0, 0.0], [22.0, 2.0], [22.0, 0.0], [20.0, 3.0]], None), ("half", square(30.0, 40.0), [[[31.0, 31.0], [33.0, 33.0], [33.0, 31.0], [31.0, 33.5]]])]
    df = spark.createDataFrame(regions, "region_id string, ring array<array<double>>, holes array<array<array<double>>>")
    points = [("in", 5.0, 5.0), ("hole", 3.0, 3.0), ("middle", 7.0, 7.0), ("edge", 2.0, 3.0), ("corner", 4.0, 4.0), ("out", 11.0, 1.0), ("bow", 21.5, 1.0), ("half", 32.5, 32.0)]
    got = {tuple(r) for r in regions_of_points(spark.createDataFrame(points, "point_id string, x double, y double"), df, holes="holes").collect()}
    assert got == {("in", "ring"), ("edge", "ring"), ("corner", "ring"), ("half", "half")}
    assert {tuple(r) for r in bad_rings(df, holes="holes").collect()} == {("bow", 0), ("half", 1)}


def test_ear_clipping_of_many_corners():
    n = 1500
    ring = [((2 + math.sin(17 * t)) * math.cos(t), (2 + math.sin(17 * t)) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]
    assert sum(area([ring[i] for i in t]) for t in ear_clip(ring)) == pytest.approx(area(ring), rel=1e-9)


def test_locations(spark):
    geometry = "struct<type:string,coordinates:array<array<double>>>"
    rows = [
        ("point", ("Point", [[35.0, 31.0]])), ("turned", ("Point", [[31.0, 35.0]])), ("zero", ("Point", [[0.0, 0.0]])), ("none", None), ("empty", ("Point", [])),
        ("line", ("LineString", [[35.0, 31.0], [35.1, 31.1], [35.2, 31.2], [35.3, 31.3]])), ("third", ("Point", [[35.0, 31.0, 700.0]])), ("half", ("Point", [[35.0]])), (None, ("Point", [[35.0, 31.0]])), ("point", ("Point", [[35.0, 31.0]])),
    ]
    got = {r.id: (r.x, r.y) for r in located(spark.createDataFrame(rows, f"id string, geometry {geometry}")).collect()}
    assert got == {"point": (35.0, 31.0), "turned": (35.0, 31.0), "line": (35.2, 31.2), "third": (35.0, 31.0)}
    assert near_pairs(located(spark.createDataFrame([], f"id string, geometry {geometry}")), 30.0).count() == 0
