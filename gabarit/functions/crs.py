"""EPSG:2039 eastings and northings to WGS84 degrees: Krüger's series, a Helmert shift, and Bowring's closed form back.

The same steps serve columns and plain floats.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The projection EPSG:2039 on GRS80, its shift to WGS84 (metres, arc seconds, ppm), and the two ellipsoids.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
LAT0_DEG = 31 + 44 / 60 + 3.817 / 3600
LON0_DEG = 35 + 12 / 60 + 16.261 / 3600
K0, FALSE_EAST, FALSE_NORTH = 1.0000067, 219529.584, 626907.39
SHIFT = (-24.0024, -17.1032, -17.8444, -0.33077, -1.85269, 1.66969, 5.4248)

_N = GRS80_F / (2 - GRS80_F)
_RECT = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def _xi_of_origin() -> float:
    s, k = math.sin(math.radians(LAT0_DEG)), 2 * math.sqrt(_N) / (1 + _N)
    xi = math.atan(math.sinh(math.atanh(s) - k * math.atanh(k * s)))
    return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_ALPHA, 1))


_XI0 = _xi_of_origin()


def _steps(m: Any) -> list[tuple[str, Any]]:
    """The conversion as named steps; each is given the values of those before it. m: pyspark.sql.functions or math."""
    e2, f2, b = 2 * GRS80_F - GRS80_F**2, 2 * WGS84_F - WGS84_F**2, WGS84_A * (1 - WGS84_F)
    rx, ry, rz = (math.radians(v / 3600) for v in SHIFT[3:6])
    scale = 1 + SHIFT[6] * 1e-6

    def series(v, coefficients, first, second):
        return sum((first(v["xi"] * (2 * j)) * second(v["eta"] * (2 * j)) * k for j, k in enumerate(coefficients[1:], 2)), first(v["xi"] * 2) * second(v["eta"] * 2) * coefficients[0])

    return [
        ("xi", lambda v: (v["y"] - FALSE_NORTH) / (K0 * _RECT) + _XI0),
        ("eta", lambda v: (v["x"] - FALSE_EAST) / (K0 * _RECT)),
        ("xi1", lambda v: v["xi"] - series(v, _BETA, m.sin, m.cosh)),
        ("eta1", lambda v: v["eta"] - series(v, _BETA, m.cos, m.sinh)),
        ("chi", lambda v: m.asin(m.sin(v["xi1"]) / m.cosh(v["eta1"]))),
        ("lat", lambda v: v["chi"] + m.sin(v["chi"] * 2) * _DELTA[0] + m.sin(v["chi"] * 4) * _DELTA[1] + m.sin(v["chi"] * 6) * _DELTA[2]),
        ("lon", lambda v: m.atan2(m.sinh(v["eta1"]), m.cos(v["xi1"])) + math.radians(LON0_DEG)),
        ("n", lambda v: GRS80_A / m.sqrt(1 - m.sin(v["lat"]) * m.sin(v["lat"]) * e2)),
        ("px", lambda v: v["n"] * m.cos(v["lat"]) * m.cos(v["lon"])),
        ("py", lambda v: v["n"] * m.cos(v["lat"]) * m.sin(v["lon"])),
        ("pz", lambda v: v["n"] * m.sin(v["lat"]) * (1 - e2)),
        ("qx", lambda v: (v["px"] - v["py"] * rz + v["pz"] * ry) * scale + SHIFT[0]),
        ("qy", lambda v: (v["px"] * rz + v["py"] - v["pz"] * rx) * scale + SHIFT[1]),
        ("qz", lambda v: (v["py"] * rx - v["px"] * ry + v["pz"]) * scale + SHIFT[2]),
        ("p", lambda v: m.sqrt(v["qx"] * v["qx"] + v["qy"] * v["qy"])),
        ("th", lambda v: m.atan2(v["qz"] * WGS84_A, v["p"] * b)),
        ("s3", lambda v: m.sin(v["th"]) * m.sin(v["th"]) * m.sin(v["th"])),
        ("c3", lambda v: m.cos(v["th"]) * m.cos(v["th"]) * m.cos(v["th"])),
        ("out_lon", lambda v: m.degrees(m.atan2(v["qy"], v["qx"]))),
        ("out_lat", lambda v: m.degrees(m.atan2(v["qz"] + v["s3"] * (f2 / (1 - f2) * b), v["p"] - v["c3"] * (f2 * WGS84_A)))),
    ]


def itm_to_wgs84(x: float, y: float) -> tuple[float, float]:
    """(longitude, latitude) in degrees of one easting and northing in metres."""
    v: dict[str, float] = {"x": x, "y": y}
    for name, f in _steps(math):
        v[name] = f(v)
    return v["out_lon"], v["out_lat"]


def with_wgs84(df: DataFrame, x: str, y: str, lon: str, lat: str) -> DataFrame:
    """df with columns lon and lat, in degrees, of the eastings and northings x and y; null where either is null.

    Every step is a column of its own: as one nested expression the conversion would repeat its parts thousands of times. The last
    goes through a generator, so that no filter on the result is pushed below it and unfolds the steps again.
    """
    v = {"x": F.col(x), "y": F.col(y)}
    made = []
    for name, f in _steps(F):
        made.append(f"__crs_{name}")
        df = df.withColumn(made[-1], f(v))
        v[name] = F.col(made[-1])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*kept, F.inline(F.array(F.struct(v["out_lon"].alias(lon), v["out_lat"].alias(lat)))))
