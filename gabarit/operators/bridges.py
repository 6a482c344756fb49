"""Import of a bridge layer: GeoJSON-like rows to clean clearance records, skipped rows with reasons, warnings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabarit.functions.crs import with_wgs84
from gabarit.functions.text import height_or_reason, is_blank, month_start, picked, stable_id
from gabarit.operators.rules import schema_rules, violations

#: Codes of what a bridge carries, and those over or under a road.
KNOWN_FUNCTIONS, ROAD_FUNCTIONS = (1, 2, 3, 4, 5, 6, 7), (1, 3, 6)
#: What an imported record says of its source.
SOURCE_NAME, VALUE_SOURCE, STATUS = "MOT bridges layer", "posted_sign", "unverified"
TIME_WINDOWS = "array<struct<days:array<string>,start_time:string,end_time:string,valid_from:string,valid_until:string,note:string>>"


def properties_of(table: DataFrame) -> DataFrame:
    """(index, props, px, py, crs) of a flat table of features: columns become properties under the layer's names."""
    names = {"OBJECTID": "objectid", "ID": "bridge_code", "NAME": "name", "Road": "road", "Placement": "placement", "Function": "function_code", "Gavrit_min": "gavrit_min", "Gavrit_max": "gavrit_max", "D_Update": "d_update"}
    props = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return table.select(F.col("objectid").alias("index"), props.alias("props"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("crs_name").alias("crs"))


def is_itm(px: Column, py: Column, crs: Column) -> Column:
    """Whether a position is in EPSG:2039: as declared, else by its range."""
    declared = F.when(crs.rlike("2039"), True).when(crs.rlike("4326|CRS84"), False)
    return F.coalesce(declared, (px > 100000) & (px < 300000) & (py > 350000) & (py < 820000), F.lit(False))


def record_columns(licence: str | None = None) -> dict[str, Column]:
    """The columns of a restriction record, of a row of imported() that has an id; observed_at is the row's own."""
    none = lambda kind: F.lit(None).cast(kind)
    own = picked(F.col("props"), ["OBJECTID"])
    return {
        "road_segment_id": F.concat(F.lit("mot-bridge:"), F.col("key")), "geometry": F.struct(F.lit("Point").alias("type"), F.array(F.array("lon", "lat")).alias("coordinates")),
        "value_source": F.lit(VALUE_SOURCE), "direction": none("string"), "restriction_type": F.lit("max_height"), "value_numeric": F.col("h.value"), "value_boolean": none("boolean"), "unit": F.lit("m"),
        "time_windows": none(TIME_WINDOWS), "status": F.lit(STATUS), "verified_by": none("string"), "verified_at": none("timestamp"),
        "source": F.struct(F.lit(SOURCE_NAME).alias("name"), F.concat(F.lit("OBJECTID:"), F.when(~is_blank(own), own).otherwise(F.col("key"))).alias("reference"), none("string").alias("url"), F.lit(licence).cast("string").alias("license")),
    }


def imported(features: DataFrame, crs: str | None = None, licence: str | None = None) -> DataFrame:
    """features (index, props map, px, py, crs) with key, skip_reason and its detail, height, lon, lat, id, observed_at and warnings.

    skip_reason, first that applies: missing_id, not_over_road, unknown_height, invalid_geometry, schema_invalid. Among rows that come as far as the
    geometry, an id that was there before (by index) gets the index as suffix. The index is unique; property names match without letter case. A row whose
    record breaks the record schema is schema_invalid, its detail the rules that it breaks. crs: overrides what the features declare.
    """
    p = F.col("props")
    get = lambda *names: picked(p, list(names))
    f = features.withColumn("key", F.trim(F.coalesce(F.when(~is_blank(get("ID")), get("ID")), F.when(~is_blank(get("OBJECTID")), get("OBJECTID")))))
    f = f.withColumn("fn", F.when(get("Function").try_cast("double") % 1 == 0, get("Function").try_cast("double").cast("int")))
    f = f.withColumn("fn", F.when(F.col("fn").isin(*KNOWN_FUNCTIONS), F.col("fn"))).withColumn("odd_fn", ~is_blank(get("Function")) & F.col("fn").isNull())
    f = f.withColumn("h", height_or_reason(get("Gavrit_min", "Min_Gavrit"))).withColumn("hm", height_or_reason(get("Gavrit_max", "Max_Gavrit")))
    f = f.withColumn("itm", is_itm(F.col("px"), F.col("py"), F.lit(crs) if crs else F.col("crs")))
    f = with_wgs84(f, "px", "py", "__lon", "__lat")
    snap = lambda c: F.floor(c * 1e7 + 0.5) / 1e7
    f = f.withColumn("lon", snap(F.when(F.col("itm"), F.col("__lon")).otherwise(F.col("px")))).withColumn("lat", snap(F.when(F.col("itm"), F.col("__lat")).otherwise(F.col("py")))).drop("__lon", "__lat")
    ok = F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    f = f.withColumn(
        "skip_reason",
        F.when(F.col("key").isNull(), "missing_id").when(F.col("fn").isNotNull() & ~F.col("fn").isin(*ROAD_FUNCTIONS), "not_over_road")
        .when(F.col("h.reason").isNotNull(), "unknown_height").when(~ok, "invalid_geometry"),
    ).withColumn("detail", F.when(F.col("skip_reason") == "unknown_height", F.col("h.reason")))
    place = F.when(~is_blank(p["Placement"]), F.trim(p["Placement"]))
    f = f.withColumn("base_id", F.when(F.col("skip_reason").isNull(), stable_id(F.col("key"), place)))
    seen = F.row_number().over(Window.partitionBy("base_id").orderBy("index"))
    f = f.withColumn("id", F.when(F.col("base_id").isNotNull(), F.when(seen > 1, F.concat("base_id", F.lit("-"), F.col("index"))).otherwise(F.col("base_id"))))
    f = f.withColumn("observed_at", month_start(get("D_Update"))).withColumn("repeated", F.col("id") != F.col("base_id"))
    reached = F.col("skip_reason").isNull()
    warn = {
        "unrecognised Function value": F.col("odd_fn") & F.col("key").isNotNull(), "Gavrit_max below Gavrit_min": F.col("hm.value") < F.col("h.value"),
        "repeated bridge key": F.col("repeated"), "no valid D_Update": reached & F.col("observed_at").isNull(), "no CRS declared": F.lit(not crs) & F.col("crs").isNull(),
    }
    # the schema is checked on the record that a row becomes, observed now if it has no month; its columns do not stay
    kept = f.columns
    record = f.withColumn("__month", F.col("observed_at")).withColumns(record_columns(licence) | {"observed_at": F.coalesce("observed_at", F.current_timestamp())})
    record = record.withColumn("__broken", F.when(reached, violations(schema_rules()))).withColumn("observed_at", F.col("__month"))
    bad = F.coalesce(F.size("__broken") > 0, F.lit(False))
    record = record.withColumn("detail", F.when(bad, F.concat_ws(",", "__broken")).otherwise(F.col("detail"))).withColumn("skip_reason", F.when(bad, "schema_invalid").otherwise(F.col("skip_reason")))
    f = record.select(*kept)
    return f.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in warn.items()]))).withColumn("height", F.col("h.value"))


def import_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over imported(): features, records, skipped, unknown_height, not_over_road, invalid, itm_converted (counted before the schema is checked)."""
    r = F.col("skip_reason")
    placed = r.isNull() | (r == "schema_invalid")
    return rows.agg(
        F.count(F.lit(1)).alias("features"), F.count_if(r.isNull()).alias("records"), F.count_if(r.isNotNull()).alias("skipped"), F.count_if(r == "unknown_height").alias("unknown_height"),
        F.count_if(r == "not_over_road").alias("not_over_road"), F.count_if(r == "schema_invalid").alias("invalid"), F.count_if(placed & F.col("itm")).alias("itm_converted"),
    )


def import_warnings(rows: DataFrame) -> DataFrame:
    """(warning, first_index): each warning once, with the first index that raised it."""
    return rows.select("index", F.explode("warnings").alias("warning")).groupBy("warning").agg(F.min("index").alias("first_index"))
