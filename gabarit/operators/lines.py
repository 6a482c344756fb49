"""Joins of lines and points on the ground: corridors and crossings, by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabarit.functions.geo import cells, crossing, haversine_m, point_segment_m
from gabarit.session import materialize

CELL_DEG = 0.002
M_PER_DEG = 111320.0


def segments(df: DataFrame, key: str, coords: str) -> DataFrame:
    """(key, seg, x1, y1, x2, y2): the segments of each line; one position gives a segment without length. coords: array of struct(x, y); null or empty gives none."""
    n = F.size(coords)
    s = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda i: F.struct(F.get(F.col(coords), i).alias("a"), F.coalesce(F.get(F.col(coords), i + 1), F.get(F.col(coords), i)).alias("b")),
    )
    rows = df.filter(n > 0).select(key, F.posexplode(s).alias("seg", "s"))
    return rows.select(key, "seg", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def with_cells(segs: DataFrame, margin_m: float = 0.0, size: float = CELL_DEG) -> DataFrame:
    """segs once for each grid cell that it, widened by margin_m, may meet. A long segment is cut into pieces first, so that cells grow with its length, not with its box."""
    my = margin_m / M_PER_DEG
    mx = F.lit(my) / F.cos(F.radians(F.least(F.greatest(F.abs("y1"), F.abs("y2")) + my, F.lit(89.0))))
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / size).cast("int"))
    s = segs.withColumn("__n", pieces).withColumn("__mx", mx).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda a, i: F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * i / F.col("__n")
    px, qx, py, qy = at("x", F.col("__i")), at("x", F.col("__i") + 1), at("y", F.col("__i")), at("y", F.col("__i") + 1)
    cx, cy = cells(F.least(px, qx) - F.col("__mx"), F.least(py, qy) - my, F.greatest(px, qx) + F.col("__mx"), F.greatest(py, qy) + my, size)
    s = s.withColumn("__xs", cx).withColumn("__ys", cy)
    return s.withColumn("cx", F.explode("__xs")).withColumn("cy", F.explode("__ys")).drop("__n", "__i", "__mx", "__xs", "__ys")


def segment_distance_m(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Metres between two segments: 0 where they meet, else the least from an end of one to the other."""
    ends = F.least(
        point_segment_m(p[0], p[1], *q), point_segment_m(p[2], p[3], *q), point_segment_m(q[0], q[1], *p), point_segment_m(q[2], q[3], *p)
    )
    return F.when(crossing(p, q, 0.0).isNotNull(), 0.0).otherwise(ends)


def by_shape(routes: DataFrame) -> DataFrame:
    """(route_id, shape, coords), written: each route with the least route_id of those with the same positions, which alone keeps them. Routes without positions are left out."""
    r = routes.filter(F.size("coords") > 0).select("route_id", F.xxhash64("coords").alias("h"), "coords")
    r = r.withColumn("shape", F.min("route_id").over(Window.partitionBy("h", "coords")))
    return materialize(r.select("route_id", "shape", F.when(F.col("route_id") == F.col("shape"), F.col("coords")).alias("coords")), "by-shape")


def corridor(routes: DataFrame, things: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(route_id, id, distance_m): things at most radius_m from a route, each pair once with its least distance.

    routes: route_id (unique), coords; things: id, coords (one position or a line), as array of struct(x, y). Lines without positions have no pairs.
    Routes of the same positions are near the same: one of them is held against the things.
    """
    shaped = by_shape(routes)
    return shaped.select("route_id", "shape").join(near_shapes(shaped, things, radius_m), "shape").select("route_id", "id", "distance_m")


def near_shapes(shaped: DataFrame, things: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(shape, id, distance_m) for the shapes of by_shape().

    Points and lines meet in the cells of a grid, an equi-join that AQE may split where a cell is crowded.
    """
    a = with_cells(segments(shaped.filter("coords IS NOT NULL"), "shape", "coords"), radius_m)
    b = segments(things, "id", "coords").select("id", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    b = with_cells(b.select("id", *[F.col(f"t{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])).select("id", "cx", "cy", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    p = tuple(F.col(c) for c in ("tx1", "ty1", "tx2", "ty2"))
    q = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    point = point_segment_m(p[0], p[1], *q)
    alone = (F.col("tx1") == F.col("tx2")) & (F.col("ty1") == F.col("ty2"))
    hit = a.join(b, ["cx", "cy"]).withColumn("distance_m", F.when(alone, point).otherwise(segment_distance_m(p, q))).filter(F.col("distance_m") <= radius_m)
    return hit.groupBy("shape", "id").agg(F.min("distance_m").alias("distance_m"))


def meetings(bridges: DataFrame, roads: DataFrame) -> DataFrame:
    """(bridge_id, road_id, x, y): roads that meet a bridge and lie on a lower layer.

    Both: way_id, coords, layer. Of several meeting points the one of the first segments (road, then bridge) is given.
    Cheap conditions come first. Crowded cells are split by AQE's skew join, on both sides.
    """
    a = with_cells(segments(bridges, "way_id", "coords")).join(bridges.select("way_id", "layer"), "way_id")
    a = a.select(F.col("way_id").alias("bridge_id"), F.col("seg").alias("bs"), F.col("layer").alias("bl"), "cx", "cy", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    b = with_cells(segments(roads, "way_id", "coords")).join(roads.select("way_id", "layer"), "way_id").withColumnRenamed("way_id", "road_id").withColumnRenamed("seg", "rs")
    p, q = tuple(F.col(f"b{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = 1e-9  # degrees; ends that only touch are left to the exact test
    box = lambda i: (F.greatest(p[i], p[i + 2]) >= F.least(q[i], q[i + 2]) - near) & (F.least(p[i], p[i + 2]) <= F.greatest(q[i], q[i + 2]) + near)
    met = a.join(b, ["cx", "cy"]).filter((F.col("layer") < F.col("bl")) & box(0) & box(1)).withColumn("at", crossing(p, q)).filter(F.col("at").isNotNull())
    # order and place as plain numbers, so that pairs are combined in a hash table
    met = met.select("bridge_id", "road_id", (F.shiftleft(F.col("rs").cast("long"), 32) + F.col("bs")).alias("k"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    return met.groupBy("bridge_id", "road_id").agg(F.min_by("x", "k").alias("x"), F.min_by("y", "k").alias("y"))


def lengths(lines: DataFrame, key: str = "route_id") -> DataFrame:
    """(key, length_m): the sum of the great circles between successive positions."""
    d = haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return segments(lines, key, "coords").groupBy(key).agg(F.sum(d).alias("length_m"))


def at_fraction(lines: DataFrame, fraction: float, key: str = "route_id") -> DataFrame:
    """(key, lon, lat): the point at a fraction (kept within 0 and 1) of each line's length, to 7 decimals; a line of one position gives that."""
    f = min(max(fraction, 0.0), 1.0)
    dist = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("coords") - 1, F.lit(1))),
        lambda i: F.struct(
            F.get(F.col("coords"), i - 1).alias("a"), F.coalesce(F.get(F.col("coords"), i), F.get(F.col("coords"), i - 1)).alias("b"),
        ),
    )
    rows = lines.filter(F.size("coords") > 0).select(key, dist.alias("s"))
    d = lambda s: haversine_m(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    rows = rows.withColumn("d", F.transform("s", d)).withColumn("total", F.aggregate("d", F.lit(0.0), lambda a, x: a + x))
    goal = F.col("total") * f
    start = F.struct(F.lit(0).alias("i"), goal.alias("left"), F.lit(False).alias("done"))
    last = F.size("d")
    step = lambda a, x: F.when(a["done"] | (a["left"] <= x) | (a["i"] == last - 1), F.struct(a["i"].alias("i"), a["left"].alias("left"), F.lit(True).alias("done"))).otherwise(
        F.struct((a["i"] + 1).alias("i"), (a["left"] - x).alias("left"), F.lit(False).alias("done"))
    )
    rows = rows.withColumn("at", F.aggregate("d", start, step)).withColumn("seg", F.get("s", F.col("at.i"))).withColumn("len", F.get("d", F.col("at.i")))
    t = F.when(F.col("len") > 0, F.least(F.col("at.left") / F.col("len"), F.lit(1.0))).otherwise(0.0)
    mix = lambda c: F.round(F.col(f"seg.a.{c}") + (F.col(f"seg.b.{c}") - F.col(f"seg.a.{c}")) * t, 7)
    return rows.select(key, mix("x").alias("lon"), mix("y").alias("lat"))
