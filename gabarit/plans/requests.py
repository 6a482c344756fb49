"""Route requests as rows: reading forms, validation with all errors, and the body for a router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabarit.functions.text import is_blank, lon_lat, strict_number
from gabarit.operators.rules import vehicle_rules, violations

#: The router's names of a vehicle's values.
COSTING = {"height": "height_m", "width": "width_m", "length": "length_m", "weight": "gross_weight_t", "axle_load": "axle_load_t"}
UNITS, LANGUAGE = "kilometers", "en-US"
NUMBERS = tuple(COSTING.values())


def profile_from_form(df: DataFrame) -> DataFrame:
    """df with the text columns of a form as a profile: trimmed, a decimal comma read as a point. A text that is no number gives null and is named in form_errors."""
    read = {c: strict_number(F.regexp_replace(F.trim(c), ",", ".")) for c in NUMBERS}
    bad = F.array_compact(F.array(*[F.when(~is_blank(F.col(c)) & n.isNull(), F.lit(c)) for c, n in read.items()]))
    out = df.withColumn("form_errors", bad).withColumn("profile_name", F.trim("profile_name"))
    return out.select(*[read[c].alias(c) if c in read else F.col(c) for c in out.columns])


def lon_lat_ok(position: Column) -> Column:
    """Whether an array is a longitude and a latitude in range, and nothing else."""
    x, y = F.get(position, F.lit(0)), F.get(position, F.lit(1))
    return F.coalesce((F.size(position) == 2) & x.between(-180, 180) & y.between(-90, 90), F.lit(False))


def request_errors(df: DataFrame) -> DataFrame:
    """df (from, to: arrays of lon and lat; the vehicle's columns) with `errors`: every rule that a request breaks, in order.

    With form_errors, as profile_from_form gives them, a text that is no number breaks the rule of its field, an optional field too.
    """
    unread = (lambda c: F.array_contains("form_errors", c)) if "form_errors" in df.columns else (lambda c: F.lit(False))
    return df.withColumn("errors", violations({"from": ~lon_lat_ok(F.col("from")), "to": ~lon_lat_ok(F.col("to")), **{f"vehicle.{k}": v | unread(k) if k in NUMBERS else v for k, v in vehicle_rules().items()}}))


def router_body(df: DataFrame) -> Column:
    """The router's JSON body of a valid request: two places, truck costing with the vehicle's values (absent ones left out), hazmat if the vehicle states any."""
    place = lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"))
    truck = F.struct(*[F.col(c).alias(k) for k, c in COSTING.items()], F.when(F.col("hazmat").isNotNull(), True).alias("hazmat"))
    return F.to_json(F.struct(F.array(place(F.col("from")), place(F.col("to"))).alias("locations"), F.lit("truck").alias("costing"), F.struct(truck.alias("truck")).alias("costing_options"), F.lit(UNITS).alias("units"), F.lit(LANGUAGE).alias("language")))


def places(text: Column) -> Column:
    """array(lon, lat) of "lon,lat" in range; null else."""
    p = lon_lat(text)
    return F.when(p.isNotNull(), F.array(p["lon"], p["lat"]))
