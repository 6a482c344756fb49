"""Points near points and points in regions.

Regions are triangulated by ear clipping. Their triangles are the leaves of a bounding-volume hierarchy over Morton codes: the
plane is halved again and again in both directions, a node is a Morton prefix, its box the cell of that prefix. A triangle is kept at
the finest level whose cells are no smaller than its box, in the one to four nodes its box meets; a point asks the node that holds it
at every level in use. Both are equi-joins, so nothing is broadcast and no level needs the driver. Candidates are tested exactly and a
point on an edge that triangles share is assigned once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabarit.functions.geo import EARTH_RADIUS_M, haversine_m
from gabarit.session import materialize, small

FINEST = 22  # levels; a cell of level L is 360 / 2**L degrees wide
TRIANGLES = "region_id string, part int, tri int, border int, ax double, ay double, bx double, by double, cx double, cy double"
BAD_RING = -1  # the tri of a ring that is no simple polygon


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (indices into ring) of a simple polygon without its closing vertex, in any orientation; none for under three corners or no area; ValueError for a ring that crosses itself."""
    pts = [tuple(map(float, p[:2])) for p in ring]
    idx = [i for i, p in enumerate(pts) if p != pts[i - 1]] if len(pts) > 1 else []
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    area = sum(pts[idx[k - 1]][0] * pts[i][1] - pts[i][0] * pts[idx[k - 1]][1] for k, i in enumerate(idx))
    if len(idx) >= 3 and area == 0 and any(cross(pts[idx[k - 2]], pts[idx[k - 1]], pts[i]) for k, i in enumerate(idx)):
        raise ValueError("ring is not a simple polygon")
    if len(idx) < 3 or area == 0:
        return []
    if area < 0:
        idx.reverse()
    out, corners = [], np.array(pts)
    k = missed = 0
    while len(idx) > 3:
        n = len(idx)
        k %= n
        i, j, m = idx[k - 1], idx[k], idx[(k + 1) % n]
        a, b, c = pts[i], pts[j], pts[m]
        turn = cross(a, b, c)
        if turn == 0:  # a vertex on a straight edge: drop it without a triangle
            idx.pop(k)
            missed = 0
            continue
        if turn > 0:
            x, y = corners[idx].T  # all corners that are left, at once
            side = lambda p, q: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])  # noqa: B023, E731
            inside = (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0)
            for p in (a, b, c):
                inside &= (x != p[0]) | (y != p[1])
            if not inside.any():
                out.append((i, j, m))
                idx.pop(k)
                missed = 0
                continue
        k, missed = k + 1, missed + 1
        if missed > n:
            raise ValueError("ring is not a simple polygon")
    if cross(*(pts[i] for i in idx)) != 0:
        out.append(tuple(idx))
    covered = sum(abs(cross(*(pts[i] for i in t))) for t in out)
    if abs(covered - abs(area)) > 1e-6 * abs(area):  # triangles of a ring that crosses itself overlap
        raise ValueError("ring is not a simple polygon")
    return out


def _with_borders(triangles: list[tuple[int, int, int]]) -> list[int]:
    """For each triangle, which of its edges ab, bc and ca (1, 2 and 4) no other triangle shares."""
    edges = lambda t: [frozenset(e) for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    seen: dict[frozenset, int] = {}
    for t in triangles:
        for e in edges(t):
            seen[e] = seen.get(e, 0) + 1
    return [sum(2**k for k, e in enumerate(edges(t)) if seen[e] == 1) for t in triangles]


def triangulate(regions: DataFrame, region_id: str = "region_id", ring: str = "ring", holes: str | None = None) -> DataFrame:
    """(region_id, part, tri, border, ax..cy) of regions whose ring is an array of (x, y) arrays; part 0 is the ring, the others are its holes (an array of rings).

    A null or degenerate ring gives no triangle. A ring that is no simple polygon (one that crosses itself) gives one row with tri BAD_RING and no
    corners, so that the others are not lost with it. border: see _with_borders.
    """

    def clip(batches):
        for pdf in batches:
            rows = []
            for rid, rings in zip(pdf["rid"], pdf["rings"]):
                for part, pts in enumerate(rings):
                    pts = [] if pts is None else [tuple(p[:2]) for p in pts if p is not None]
                    if len(pts) > 1 and pts[0] == pts[-1]:
                        pts = pts[:-1]
                    try:
                        found = ear_clip(pts)
                    except ValueError:
                        rows.append((rid, part, BAD_RING, 0, *[None] * 6))
                        continue
                    rows += [(rid, part, k, border, *pts[a], *pts[b], *pts[c]) for k, ((a, b, c), border) in enumerate(zip(found, _with_borders(found)))]
            yield pd.DataFrame(rows, columns=["region_id", "part", "tri", "border", "ax", "ay", "bx", "by", "cx", "cy"])

    of = "array<array<array<double>>>"
    rings = F.array(F.col(ring).cast("array<array<double>>"))
    if holes:
        rings = F.concat(rings, F.coalesce(F.col(holes).cast(of), F.array().cast(of)))
    src = regions.select(F.col(region_id).cast("string").alias("rid"), rings.alias("rings"))
    return src.filter(F.col("rid").isNotNull()).mapInPandas(clip, TRIANGLES)


def bad_rings(regions: DataFrame, region_id: str = "region_id", ring: str = "ring", holes: str | None = None) -> DataFrame:
    """(region_id, part): the rings that are no simple polygons; part 0 is the outer one. regions_of_points knows neither them nor, for a bad outer ring, the region."""
    return triangulate(regions, region_id, ring, holes).filter(F.col("tri") == BAD_RING).select("region_id", "part")


def _cell(v: Column, origin: float, level: Column | int) -> Column:
    return F.floor((v - origin) * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level) / 360.0)


def _node(level: Column, x: Column, y: Column) -> Column:
    """One number for a level and its cell; the level in the top bits, then row and column of the Morton prefix."""
    return F.shiftleft(level.cast("long"), 56) + F.shiftleft(x.cast("long"), 28) + y.cast("long")


def node_level(width: Column) -> Column:
    """The finest level whose cells are at least width wide, within 0 and FINEST."""
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / F.greatest(width, F.lit(1e-12)))))).cast("int")


def spread(triangles: DataFrame) -> DataFrame:
    """triangles (with level, no finer than node_level of their box) once for each node of the hierarchy that they are kept in (at most four)."""
    lo = lambda a: F.least(f"a{a}", f"b{a}", f"c{a}")
    hi = lambda a: F.greatest(f"a{a}", f"b{a}", f"c{a}")
    t = triangles
    cells = lambda a, origin: F.sequence(_cell(F.greatest(lo(a), F.lit(origin)), origin, F.col("level")), _cell(hi(a), origin, F.col("level")))
    t = t.withColumn("nx", F.explode(cells("x", -180.0))).withColumn("ny", F.explode(cells("y", -180.0)))
    return t.withColumn("node", _node(F.col("level"), F.col("nx"), F.col("ny"))).drop("nx", "ny")


def levels_in_use(df: DataFrame) -> list[int]:
    """The levels of df's column level, at most FINEST + 1."""
    return sorted(r[0] for r in df.select("level").distinct().collect())


def _sides(x: Column, y: Column) -> list[Column]:
    """Twice the signed areas that a point makes with the edges ab, bc and ca; 0 on the line of an edge."""
    side = lambda a, b: (F.col(f"{b}x") - F.col(f"{a}x")) * (y - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (x - F.col(f"{a}x"))
    return [side("a", "b"), side("b", "c"), side("c", "a")]


def in_triangle(x: Column, y: Column) -> Column:
    """Exact test against ax..cy, edges included, in either orientation."""
    s = _sides(x, y)
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def points_in_triangles(points: DataFrame, triangles: DataFrame, levels: list[int], hot: int = 5_000) -> DataFrame:
    """points (x, y, ...) with each triangle that holds them; a point on a shared edge comes once for each triangle.

    levels: the levels in use. Nodes that hold more than hot points or triangles are split into a grid: their points are dealt to its rows and their
    triangles to its columns, each repeated along the other side, so that a task tests at most about hot points with hot triangles.
    """
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])) if len(levels) > 1 else F.lit(levels[0]))
    asked = asked.withColumn("node", _node(F.col("level"), _cell(F.col("x"), -180.0, F.col("level")), _cell(F.col("y"), -180.0, F.col("level")))).drop("level")
    kept = spread(triangles).drop("level")
    count = lambda df, name: df.groupBy("node").agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > hot)
    crowded = count(asked, "points").join(count(kept, "triangles"), "node", "full_outer")
    parts = lambda name: F.ceil(F.coalesce(name, F.lit(1)) / hot).cast("int")
    crowded = materialize(crowded.select("node", parts("points").alias("rows"), parts("triangles").alias("columns")), "crowded-nodes")
    if crowded.isEmpty():
        joined = asked.join(kept, "node")
    else:  # at most (points + triangles) / hot nodes
        crowded = small(crowded)

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.join(crowded, "node", "left").withColumn(own, F.floor(F.rand(7) * F.coalesce(own, F.lit(1))).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

        joined = dealt(asked, "rows", "columns").join(dealt(kept, "columns", "rows"), ["node", "rows", "columns"]).drop("rows", "columns")
    return joined.filter(in_triangle(F.col("x"), F.col("y"))).drop("node")


def regions_of_points(points: DataFrame, regions: DataFrame, point_id: str = "point_id", region_id: str = "region_id", ring: str = "ring", holes: str | None = None) -> DataFrame:
    """(point_id, region_id): each region that holds each point, borders included, once.

    points: point_id, x, y; a point without id or position is left out, as is a region without area or with a bad outer ring (see bad_rings). Repeated
    rows count once. A point on the border of two regions is in both; on an edge inside one region it is in it once. holes: a column with an array of
    rings; what lies inside one is not in the region, its border is. Bad holes are none.
    """
    lo = lambda a: F.least(f"a{a}", f"b{a}", f"c{a}")
    hi = lambda a: F.greatest(f"a{a}", f"b{a}", f"c{a}")
    level = node_level(F.greatest(hi("x") - lo("x"), hi("y") - lo("y")))
    triangles = materialize(triangulate(regions, region_id, ring, holes).filter(F.col("tri") != BAD_RING).withColumn("level", level), "triangles")
    levels = levels_in_use(triangles)
    pts = points.select(F.col(point_id).alias("point_id"), "x", "y").filter("point_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    if not levels:
        return pts.select("point_id", F.lit(None).cast("string").alias("region_id")).limit(0)
    hit = points_in_triangles(pts, triangles, levels)
    if not holes:
        return hit.select("point_id", "region_id").distinct()
    on = [(F.col("border").bitwiseAND(F.lit(2**k)) != 0) & (side == 0) for k, side in enumerate(_sides(F.col("x"), F.col("y")))]
    open_ = (F.col("part") > 0) & ~(on[0] | on[1] | on[2])
    return hit.groupBy("point_id", "x", "y", "region_id").agg(F.max(F.col("part") == 0).alias("held"), F.max(open_).alias("cut")).filter("held AND NOT cut").select("point_id", "region_id").distinct()


def disc_template(sides: int = 4) -> list[list[tuple[float, float]]]:
    """Triangles, by ear clipping, of the regular polygon that circumscribes the unit disc; corners as (x, y)."""
    r = 1.0 / math.cos(math.pi / sides)
    ring = [(r * math.cos(math.pi * (2 * k + 1) / sides), r * math.sin(math.pi * (2 * k + 1) / sides)) for k in range(sides)]
    return [[ring[i] for i in t] for t in ear_clip(ring)]


def located(df: DataFrame, record_id: str = "id") -> DataFrame:
    """(id, x, y) of the records that have a location, once each.

    The location is the Point, or the vertex with index floor(n/2) of a LineString; a latitude-first position is turned round, 0/0,
    null, empty or non-finite positions are none, the third ordinate is ignored.
    """
    c = F.col("geometry.coordinates")
    at = F.try_element_at(c, (F.floor(F.size(c) / 2) + 1).cast("int"))
    a, b = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    fits = lambda lon, lat: lon.between(34, 36) & lat.between(29, 34)
    turned = ~fits(a, b) & fits(b, a)
    out = df.select(F.col(record_id).alias("id"), F.when(turned, b).otherwise(a).alias("x"), F.when(turned, a).otherwise(b).alias("y"))
    real = F.col("id").isNotNull() & F.col("x").between(-180, 180) & F.col("y").between(-90, 90)
    return out.filter(real & ~((F.col("x") == 0) & (F.col("y") == 0))).distinct()


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b, distance_m) of different ids at most radius_m apart on the sphere, id_a < id_b, each pair once.

    points: id, x (longitude, -180 to 180), y (latitude). The region of a point is the rectangle that holds its disc, in two triangles; where the disc
    reaches round a pole, it holds all longitudes. Points near the 180th meridian are asked a second time, a turn further. Positions
    exactly alike are joined as they are: each pair of their ids is asked for. An id with several positions counts by its nearest.
    """
    r = radius_m / EARTH_RADIUS_M * 1.001
    dy = math.degrees(r)
    width = lambda lat: F.when(F.cos(F.radians(lat)) > math.sin(min(r, math.pi / 2)), F.degrees(F.asin(math.sin(min(r, math.pi / 2)) / F.cos(F.radians(lat))))).otherwise(180.0)
    dx = width(F.abs("y")) * 1.001
    pts = materialize(points.select("id", "x", "y", node_level(2.001 * F.greatest(dx, F.lit(dy))).alias("level"), dx.alias("dx")), "points")
    levels = levels_in_use(pts)
    if not levels:
        return pts.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance_m")).limit(0)
    corner = lambda p: (F.col("x") + F.col("dx") * p[0], F.col("y") + dy * p[1])
    tri = [F.struct(*[v.alias(f"{n}{ax}") for n, p in zip("abc", t) for ax, v in zip("xy", corner(p))]) for t in disc_template(4)]
    triangles = pts.select(F.col("id").alias("region_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), "level", F.inline(F.array(*tri)))
    asked = pts.select("id", "x", "y", F.lit(False).alias("turned"))
    # the widest region that can reach a point has its latitude, less the radius
    over = F.col("x") <= width(F.least(F.abs("y") + dy, F.lit(90.0))) * 1.01 - 180.0
    asked = asked.unionByName(asked.filter(over).withColumn("x", F.col("x") + 360.0).withColumn("turned", F.lit(True)))
    hit = points_in_triangles(asked, triangles, levels).filter((F.col("id") < F.col("region_id")) | (F.col("turned") & (F.col("id") != F.col("region_id"))))
    d = haversine_m(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    hit = hit.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)
    return hit.groupBy(F.least("id", "region_id").alias("id_a"), F.greatest("id", "region_id").alias("id_b")).agg(F.min("distance_m").alias("distance_m"))
