"""Scalar parsers and formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Road classes of the two analyses, and what the analyses leave out.
COVERAGE_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential")
CROSSING_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "track", "living_street", "road")
NON_ROADS = ("footway", "path", "cycleway", "steps", "pedestrian", "bridleway", "corridor", "proposed", "construction", "platform", "elevator")
NOT_CROSSED = (*NON_ROADS, "raceway")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def strict_number(text: Column) -> Column:
    """Double of plain decimal notation; null for words, suffixes, NaN and blanks."""
    t = F.trim(text)
    return F.when(t.rlike(STRICT_NUMBER), t.try_cast("double"))


def number_text(x: Column) -> Column:
    """A number as it is commonly written: whole numbers without a decimal part."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).when(F.abs(x) < 1e-3, F.regexp_replace(x.cast("decimal(38,12)").cast("string"), "0+$", "")).otherwise(x.cast("string"))


def height_or_reason(text: Column) -> Column:
    """struct(value, reason) of a clearance in text; the first comma is a decimal mark. Exactly one of the two is set."""
    n = strict_number(F.regexp_replace(F.trim(text), "^([^,]*),", "$1."))
    reason = (
        F.when(is_blank(text), "blank").when(n.isNull(), "non_numeric").when(n == -1, "sentinel_-1").when(n == 9999, "sentinel_9999").when(n <= 0, "non_positive").when(n > 50, "out_of_range_gt_50")
    )
    return F.struct(F.when(reason.isNull(), n).alias("value"), reason.alias("reason"))


#: A height tag in parts: whole number, decimal mark, decimals, and its sign (none, m, ft, or feet and inches).
HEIGHT_PARTS = r"^\s*(?<whole>\d+)(?:(?<mark>[.,])(?<decimals>\d+))?\s*(?<sign>m|ft|'(?:\s*(?<inches>\d+)\s*\")?)?\s*$"
#: Names of what a tag is written in, and metres of a foot and an inch.
BARE, METRE, FOOT, FEET_INCHES, NO_HEIGHT = "bare-number", "m", "ft", "ft/in", "non-numeric"
FOOT_M, INCH_M = 0.3048, 0.0254


def tagged_height(text: Column) -> Column:
    """struct(metres, unit) of a height tag; metres null and unit non-numeric where it is none; null for null.

    A comma is a decimal mark in metres only; feet before inches are whole.
    """
    whole, mark, decimals, sign, inches = (F.regexp_extract(text, HEIGHT_PARTS, k) for k in range(1, 6))
    number = F.concat_ws(".", whole, F.nullif(decimals, F.lit(""))).try_cast("double")
    feet_inches = sign.startswith("'")
    unit = F.when(sign == "", BARE).when(sign == "m", METRE).when((sign == "ft") & (mark != ","), FOOT).when(feet_inches & (mark == ""), FEET_INCHES)
    unit = F.when(text.rlike(HEIGHT_PARTS), unit)
    factor = F.when(unit == FOOT, FOOT_M).when(unit == FEET_INCHES, 12 * INCH_M).otherwise(1.0)
    more = F.when(unit == FEET_INCHES, F.coalesce(inches.try_cast("double"), F.lit(0.0)) * INCH_M).otherwise(0.0)
    return F.when(text.isNotNull(), F.struct(F.when(unit.isNotNull(), number * factor + more).alias("metres"), F.coalesce(unit, F.lit(NO_HEIGHT)).alias("unit")))


#: Lower bounds of clearance classes in metres, with the names of the classes.
CLEARANCE_CLASSES = {0.0: "<2.0 (suspect)", 2.0: "2.0-3.5", 3.5: "3.5-4.0", 4.0: "4.0-4.5", 4.5: "4.5-5.0", 5.0: "5.0-5.5", 5.5: "5.5-7.0"}
HIGHEST, ABOVE = 7.0, ">7.0 (suspect)"


def clearance_bucket(h: Column) -> Column:
    """The class of a clearance: of the bounds that it reaches, the highest; beyond HIGHEST, and null, have names of their own."""
    reached = sum((F.when(h >= bound, 1).otherwise(0) for bound in list(CLEARANCE_CLASSES)[1:]), F.lit(0))
    name = F.get(F.array(*map(F.lit, CLEARANCE_CLASSES.values())), reached)
    return F.when(h.isNull(), NO_HEIGHT).when(h > HIGHEST, ABOVE).otherwise(name)


def coverage_bucket(h: Column) -> Column:
    return F.when(h < 2, "<2").when(h < 3, "2-3").when(h < 4, "3-4").when(h < 4.5, "4-4.5").when(h < 5, "4.5-5").when(h <= 7, "5-7").when(h > 7, ">7")


def road_class(highway: Column, classes: tuple[str, ...]) -> Column:
    """The class of a highway value, links with their roads; anything else, and null, is other."""
    bare = F.regexp_replace(highway, "_link$", "")
    return F.when(bare.isin(*classes), bare).otherwise("other")


def layer_of(text: Column, default: Column) -> Column:
    """Whole layer, cut towards zero; default where the text is no finite number."""
    x = strict_number(text)
    return F.coalesce(F.when(F.abs(x) < 1e9, x.cast("int")), default)


def month_start(text: Column) -> Column:
    """Timestamp of the first of the month of YYYYMM (a trailing .0 is dropped); null for other texts, months beyond 1 to 12 and years before 1900."""
    t = F.regexp_replace(F.trim(text), r"\.0+$", "")
    y, m = F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int")
    return F.when(t.rlike("^[0-9]{6}$") & m.between(1, 12) & (y >= 1900), F.make_date(y, m, F.lit(1)).cast("timestamp"))


def stable_id(key: Column, placement: Column) -> Column:
    """The fixed id format of an imported clearance: key and placement made safe, and the start of a digest of both."""
    place = F.coalesce(placement, F.lit(""))
    digest = F.substring(F.sha1(F.concat_ws("|", F.lit("mot-bridges"), key, place, F.lit("max_height"))), 1, 12)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.concat(F.lit("mot-bridge-"), safe(key), F.when(place != "", F.concat(F.lit("-"), safe(place))).otherwise(""), F.lit("-maxheight-"), digest)


def iso_ms(ts: Column) -> Column:
    """ISO text with milliseconds and Z of a timestamp, in a session whose zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bbox_parts(text: Column) -> Column:
    """struct(error, min_lon, min_lat, max_lon, max_lat) of "minLon,minLat,maxLon,maxLat"; the first error that applies, or null."""
    parts = F.split(text, ",", -1)
    n = F.transform(parts, strict_number)
    v = [F.get(n, F.lit(i)) for i in range(4)]
    error = (
        F.when(text.isNull() | (F.size(parts) != 4), "four numbers expected")
        .when(F.exists(n, lambda x: x.isNull()), "not a number")
        .when(~(v[0].between(-180, 180) & v[2].between(-180, 180) & v[1].between(-90, 90) & v[3].between(-90, 90)), "out of range")
        .when((v[0] >= v[2]) | (v[1] >= v[3]), "empty box")
    )
    ok = lambda i: F.when(error.isNull(), v[i])
    return F.struct(error.alias("error"), ok(0).alias("min_lon"), ok(1).alias("min_lat"), ok(2).alias("max_lon"), ok(3).alias("max_lat"))


def lon_lat(text: Column) -> Column:
    """struct(lon, lat) of "lon,lat" in range, else null."""
    parts = F.transform(F.split(text, ",", -1), strict_number)
    x, y = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.size(parts) == 2) & x.between(-180, 180) & y.between(-90, 90), F.struct(x.alias("lon"), y.alias("lat")))


def picked(props: Column, names: list[str]) -> Column:
    """Of a map of properties, the first of the names, without letter case, that is not blank; else the first that is there; else null."""
    low = F.transform_keys(props, lambda k, v: F.lower(k))
    values = [F.try_element_at(low, F.lit(n.lower())) for n in names]
    return F.coalesce(*[F.when(~is_blank(v), v) for v in values], *values)
