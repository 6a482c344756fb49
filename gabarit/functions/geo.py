"""Geodesy and plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth, metres.
EARTH_RADIUS_M = 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions in degrees, on the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def point_segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres from a point to a segment, in the plane that touches the sphere's parallel through the point; a segment without length is a point."""
    k = F.cos(F.radians(py))
    dx, dy = F.radians(bx - ax) * k, F.radians(by - ay)
    qx, qy = F.radians(px - ax) * k, F.radians(py - ay)
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (qx * dx + qy * dy) / length2))).otherwise(0.0)
    return F.hypot(qx - t * dx, qy - t * dy) * EARTH_RADIUS_M


def crossing(p: tuple[Column, ...], q: tuple[Column, ...], slack: float = 1e-9) -> Column:
    """struct(x, y) where the segments p and q (x1, y1, x2, y2) meet; null if they do not, or lie along one line."""
    rx, ry, sx, sy = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    den = rx * sy - ry * sx
    t = ((q[0] - p[0]) * sy - (q[1] - p[1]) * sx) / F.nullif(den, F.lit(0.0))
    u = ((q[0] - p[0]) * ry - (q[1] - p[1]) * rx) / F.nullif(den, F.lit(0.0))
    meets = (F.abs(den) >= 1e-12) & t.between(-slack, 1 + slack) & u.between(-slack, 1 + slack)
    return F.when(meets, F.struct((p[0] + t * rx).alias("x"), (p[1] + t * ry).alias("y")))


def cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> tuple[Column, Column]:
    """(columns, rows) of the grid cells that the box of a segment meets, bounds included, as arrays."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return span(x1, x2), span(y1, y2)


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a fixed ring."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (F.lit(x2) - x1) * (y - y1) / F.lit((y2 - y1) or 1.0) + x1)
        odd = odd != hit
    return odd


def square_ring(x: Column, y: Column, metres: float) -> Column:
    """Closed ring (array of struct x, y) of a square with the point in its middle, half as wide as metres to each side."""
    dy = metres / 111320.0
    dx = F.lit(dy) / F.cos(F.radians(y))
    corner = lambda sx, sy: F.struct((x + dx * sx).alias("x"), (y + dy * sy).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def round_ring(x: Column, y: Column, metres: float, corners: int = 16, digits: int = 7) -> Column:
    """Closed ring of a regular polygon in the circle of metres round a point, rounded to digits."""
    step = lambda k: k * (2 * 3.141592653589793 / corners)
    dy = metres / 111320.0
    dx = F.lit(dy) / F.cos(F.radians(y))
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct(F.round(x + dx * F.cos(step(k)), digits).alias("x"), F.round(y - F.sin(step(k)) * dy, digits).alias("y")))
    return ring


def capsule_ring(x1: Column, y1: Column, x2: Column, y2: Column, metres: float, corners: int = 16, digits: int = 7) -> Column:
    """Closed ring of all that is within metres of a segment: half a round ring at each end. A segment without length gives a round ring turned."""
    k = F.cos(F.radians((y1 + y2) / 2))
    along = F.atan2(y2 - y1, (x2 - x1) * k)
    half = corners // 2
    unit = 3.141592653589793 / half
    dy = metres / 111320.0
    at = lambda x, y, a: F.struct(F.round(x + F.cos(a) * dy / k, digits).alias("x"), F.round(y + F.sin(a) * dy, digits).alias("y"))
    ends = F.sequence(F.lit(0), F.lit(half))
    head = F.transform(ends, lambda i: at(x2, y2, along - 1.5707963267948966 + i * unit))
    tail = F.transform(ends, lambda i: at(x1, y1, along + 1.5707963267948966 + i * unit))
    return F.concat(head, tail, F.slice(head, 1, 1))


def middle(coordinates: Column, upper: bool = True) -> Column:
    """The vertex in the middle: index floor(n/2), or floor((n-1)/2) if not upper; null if there is none."""
    n = F.size(coordinates)
    return F.when(n > 0, F.try_element_at(coordinates, F.floor((n if upper else n - 1) / 2).cast("int") + 1))


def bent_line(x1: Column, y1: Column, x2: Column, y2: Column, bulge: float, steps: int = 40, digits: int = 6) -> Column:
    """array of struct(x, y): steps + 1 points from one place to another, bent sideways by a sine of height bulge (degrees)."""
    dx, dy = x2 - x1, y2 - y1
    length = F.hypot(dx, dy)
    length = F.when(length == 0, 1.0).otherwise(length)
    off = lambda t: F.sin(t * 3.141592653589793) * bulge
    t = lambda i: i / float(steps)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(F.round(x1 + dx * t(i) - dy / length * off(t(i)), digits).alias("x"), F.round(y1 + dy * t(i) + dx / length * off(t(i)), digits).alias("y")),
    )


def ring_mean(ring: Column) -> Column:
    """struct(x, y): the mean of a ring's vertices without the closing one; null for an empty ring."""
    n = F.size(ring)
    body = F.when((n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)
    mean = lambda a: F.aggregate(body, F.lit(0.0), lambda s, p: s + p[a]) / F.size(body)
    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))
