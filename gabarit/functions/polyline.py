"""Encoded polylines as column expressions: no UDF, and no growing arrays.

A number is written in groups of five bits, the last of which is a character below "_". So one regular expression cuts a text into its
numbers, each is put together on its own, and a running sum gives the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"[_-~]*[?-^]"


def deltas(text: Column) -> Column:
    """array of the signed numbers of an encoded polyline, latitudes and longitudes in turn; null if the text is cut off, odd or has other characters; [] if empty."""
    groups = F.regexp_extract_all(text, F.lit(f"({_NUMBER})"))
    bits = lambda g: F.aggregate(F.reverse(F.split(g, "")), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 5) + (F.ascii(c) - 63).bitwiseAND(31).cast("long"))
    signed = F.transform(F.transform(groups, bits), lambda z: F.when(z.bitwiseAND(1) == 1, -F.shiftright(z, 1) - 1).otherwise(F.shiftright(z, 1)))
    whole = (F.length(F.concat_ws("", groups)) == F.length(text)) & (F.size(groups) % 2 == 0)
    return F.when(whole, signed)


def decoded(df: DataFrame, key: str, text: str, precision: int = 6) -> DataFrame:
    """(key, seq, lon, lat): the positions of each encoded polyline, in order; keys are unique. Null, empty and broken texts have no rows."""
    pairs = df.select(key, deltas(F.col(text)).alias("d")).filter(F.size("d") > 0)
    at = F.transform(F.sequence(F.lit(0), (F.size("d") / 2).cast("int") - 1), lambda i: F.struct(F.get("d", i * 2).alias("dlat"), F.get("d", i * 2 + 1).alias("dlon")))
    rows = pairs.select(key, F.posexplode(at).alias("seq", "p"))
    upto = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    scale = float(10**precision)
    return rows.select(key, "seq", (F.sum("p.dlon").over(upto) / scale).alias("lon"), (F.sum("p.dlat").over(upto) / scale).alias("lat"))


def with_number_text(df: DataFrame, n: str, out: str) -> DataFrame:
    """df with the characters of the signed whole numbers in column n."""
    z = F.when(F.col(n) < 0, -F.shiftleft(F.col(n), 1) - 1).otherwise(F.shiftleft(F.col(n), 1))
    df = df.withColumn("__z", z)
    df = df.withColumn("__k", sum((F.when(F.shiftright("__z", 5 * k) > 0, 1).otherwise(0) for k in range(1, 8)), F.lit(1)))
    part = lambda k: F.char(F.shiftright("__z", 5 * k).bitwiseAND(31) + F.when(F.col("__k") > k + 1, 32).otherwise(0) + 63)
    return df.withColumn(out, F.concat_ws("", *[F.when(F.col("__k") > k, part(k)) for k in range(8)])).drop("__z", "__k")


def encoded(points: DataFrame, key: str, seq: str = "seq", lon: str = "lon", lat: str = "lat", precision: int = 6) -> DataFrame:
    """(key, polyline): the encoded polyline of each key's positions in the order of seq. Positions are rounded before differences are taken."""
    scale = float(10**precision)
    w = Window.partitionBy(key).orderBy(seq)
    whole = points.select(key, seq, F.floor(F.col(lon) * scale + 0.5).cast("long").alias("x"), F.floor(F.col(lat) * scale + 0.5).cast("long").alias("y"))
    d = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    steps = whole.select(key, seq, d("y").alias("dy"), d("x").alias("dx"))
    text = with_number_text(with_number_text(steps, "dy", "ty"), "dx", "tx").select(key, seq, F.concat("ty", "tx").alias("t"))
    return text.groupBy(key).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(seq, "t"))), lambda p: p["t"])).alias("polyline"))
