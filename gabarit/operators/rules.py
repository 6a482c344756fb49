"""Data contracts as lists of named violations, one boolean expression each; and limits against vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabarit.functions.text import number_text

#: Fixed values of the contracts.
VALUE_SOURCES = ("posted_sign", "measured", "regulation", "derived", "unknown")
DIRECTIONS = ("both", "forward", "backward")
DIMENSIONS, WEIGHTS, BANS = ("max_height", "max_width", "max_length"), ("max_gross_weight", "max_axle_weight"), ("truck_prohibited", "hazmat_restriction")
TYPES = (*DIMENSIONS, *WEIGHTS, *BANS)
UNITS = ("m", "t", "boolean")
STATUSES = ("unverified", "verified", "disputed", "expired")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
ADR_CLASSES = ("1", "2", "3", "4.1", "4.2", "4.3", "5.1", "5.2", "6.1", "6.2", "7", "8", "9")
CLOCK = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
LIMITS = {"max_height": ("height_m", "heightM"), "max_width": ("width_m", "widthM"), "max_length": ("length_m", "lengthM"), "max_gross_weight": ("gross_weight_t", "grossWeightT"), "max_axle_weight": ("axle_load_t", "axleLoadT")}


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken (true), in order; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def _c(name: str) -> Column:
    return F.col(name)


def check_rules() -> dict[str, Column]:
    """The store's constraints: null passes a check, as in SQL."""
    n, b, unit, t = _c("value_numeric"), _c("value_boolean"), _c("unit"), _c("restriction_type")
    pair = ((unit == "boolean") & b.isNotNull() & n.isNull()) | (unit.isin("m", "t") & n.isNotNull() & b.isNull())
    return {
        "id_null": _c("id").isNull(), "road_segment_id_null": _c("road_segment_id").isNull(), "direction_null": _c("direction").isNull(), "unit_null": unit.isNull(),
        "status_null": _c("status").isNull(), "source_null": _c("source").isNull(), "observed_at_null": _c("observed_at").isNull(), "restriction_type_null": t.isNull(),
        "geometry_type": ~_c("geometry.type").isin("Point", "LineString"), "value_source": ~_c("value_source").isin(*VALUE_SOURCES), "direction": ~_c("direction").isin(*DIRECTIONS),
        "restriction_type": ~t.isin(*TYPES), "unit": ~unit.isin(*UNITS), "status": ~_c("status").isin(*STATUSES), "source_keys": _c("source.name").isNull() | _c("source.reference").isNull(),
        "value_pair": ~pair, "value_range": n.isNotNull() & ~((n > 0) & (n <= 200)),
        "dimension": t.isin(*DIMENSIONS) & ~((unit == "m") & _c("value_source").isNotNull() & (n <= 50)), "weight": t.isin(*WEIGHTS) & (unit != "t"), "ban": t.isin(*BANS) & (unit != "boolean"),
        "verified": (_c("status") == "verified") & ~(_c("verified_by").isNotNull() & _c("verified_at").isNotNull()),
    }


def _position_bad(p: Column) -> Column:
    lon, lat = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    return F.coalesce(~(F.size(p).between(2, 3) & lon.between(-180, 180) & lat.between(-90, 90)), F.lit(True))


def _window_bad(w: Column) -> Column:
    days = w["days"]
    any_set = F.coalesce(w["days"].isNotNull() | w["start_time"].isNotNull() | w["end_time"].isNotNull() | w["valid_from"].isNotNull() | w["valid_until"].isNotNull() | w["note"].isNotNull(), F.lit(False))
    days_bad = days.isNotNull() & ((F.size(days) == 0) | (F.size(F.array_distinct(days)) != F.size(days)) | ~F.forall(days, lambda d: F.coalesce(d.isin(*WEEKDAYS), F.lit(False))))
    clock_bad = lambda c: w[c].isNotNull() & ~w[c].rlike(CLOCK)
    date_bad = lambda c: w[c].isNotNull() & (~w[c].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | w[c].try_cast("date").isNull())
    half = w["start_time"].isNull() != w["end_time"].isNull()
    return ~any_set | days_bad | clock_bad("start_time") | clock_bad("end_time") | date_bad("valid_from") | date_bad("valid_until") | half


def schema_rules() -> dict[str, Column]:
    """The record schema, on typed columns: an absent optional part passes, a null in a row stands for absent."""
    n, b, unit, t, g = _c("value_numeric"), _c("value_boolean"), _c("unit"), _c("restriction_type"), _c("geometry.coordinates")
    short = lambda c: c.isNull() | (F.length(c) < 1)
    kind = _c("geometry.type")
    geometry = _c("geometry").isNotNull() & F.coalesce(
        ~(((kind == "Point") & (F.size(g) == 1)) | ((kind == "LineString") & (F.size(g) >= 2))) | F.exists(g, _position_bad), F.lit(True)
    )
    return {
        "id": short(_c("id")), "roadSegmentId": short(_c("road_segment_id")), "geometry": geometry, "valueSource": ~_c("value_source").isin(*VALUE_SOURCES), "direction": ~_c("direction").isin(*DIRECTIONS),
        "restrictionType": F.coalesce(~t.isin(*TYPES), F.lit(True)), "value": n.isNull() & b.isNull(), "unit": F.coalesce(~unit.isin(*UNITS), F.lit(True)),
        "timeWindows": _c("time_windows").isNotNull() & ((F.size("time_windows") == 0) | F.exists("time_windows", _window_bad)), "status": F.coalesce(~_c("status").isin(*STATUSES), F.lit(True)),
        "source.name": short(_c("source.name")), "source.reference": short(_c("source.reference")), "source.url": _c("source.url").isNotNull() & ~_c("source.url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$"),
        "source.license": _c("source.license").isNotNull() & (F.length("source.license") < 1), "observedAt": _c("observed_at").isNull(), "verifiedBy": _c("verified_by").isNotNull() & (F.length("verified_by") < 1),
        "dimension": t.isin(*DIMENSIONS) & F.coalesce(~(_c("value_source").isNotNull() & (n > 0) & (n <= 50) & (unit == "m")), F.lit(True)),
        "weight": t.isin(*WEIGHTS) & F.coalesce(~((n > 0) & (n <= 200) & (unit == "t")), F.lit(True)), "ban": t.isin(*BANS) & F.coalesce(~(b.isNotNull() & (unit == "boolean")), F.lit(True)),
        "verified": (_c("status") == "verified") & (_c("verified_by").isNull() | _c("verified_at").isNull()),
    }


def vehicle_rules() -> dict[str, Column]:
    """The vehicle profile schema."""
    bounds = {"height_m": (1, 6), "width_m": (1, 6), "length_m": (2, 60), "gross_weight_t": (0.5, 200)}
    need = {name: F.coalesce(~_c(name).between(lo, hi), F.lit(True)) for name, (lo, hi) in bounds.items()}
    adr = _c("hazmat.adr_classes")
    adr_bad = _c("hazmat").isNotNull() & F.coalesce((F.size(adr) < 1) | (F.size(F.array_distinct(adr)) != F.size(adr)) | ~F.forall(adr, lambda a: F.coalesce(a.isin(*ADR_CLASSES), F.lit(False))), F.lit(True))
    return {"profile_name": F.coalesce(~F.length("profile_name").between(1, 120), F.lit(True)), **need, "axle_load_t": ~_c("axle_load_t").between(0.5, 40), "hazmat": adr_bad}


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def reason(limit: Column, unit: Column, actual: Column, kind: Column, banned: Column, hazmat: Column) -> Column:
    """Why a vehicle breaks a limit, as text; null if it does not. A limit equal to the vehicle passes; an absent vehicle value breaks; an absent limit does not count."""
    field = F.create_map(*[F.lit(x) for t, (_, f) in LIMITS.items() for x in (t, f)])[kind]
    numeric = F.when(limit.isNull(), F.lit(None).cast("string")).when(actual.isNull(), F.concat(field, F.lit(" not given; limit "), number_text(limit), F.lit(" "), unit)).when(
        limit < actual, F.concat(field, F.lit(" "), number_text(actual), F.lit(" > limit "), number_text(limit), F.lit(" "), unit)
    )
    return (
        F.when(kind.isin(*LIMITS), numeric).when((kind == "truck_prohibited") & banned, "trucks prohibited").when((kind == "hazmat_restriction") & banned & hazmat, "hazmat prohibited and vehicle carries hazmat")
    )


def actual_of(kind: Column) -> Column:
    """The vehicle's value that a type of limit is held against."""
    return F.coalesce(*[F.when(kind == t, F.col(c)) for t, (c, _) in LIMITS.items()])
