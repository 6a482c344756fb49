"""The restriction store: box queries, features, batches of changes with their audit trail, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabarit.functions.text import iso_ms


def envelope(coordinates: Column) -> tuple[Column, Column, Column, Column]:
    """(min_lon, min_lat, max_lon, max_lat) of an array of positions; nulls for none."""
    axis = lambda k: F.transform(coordinates, lambda p: F.try_element_at(p, F.lit(k)))
    return F.array_min(axis(1)), F.array_min(axis(2)), F.array_max(axis(1)), F.array_max(axis(2))


BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def with_box(df: DataFrame) -> DataFrame:
    """df with its envelope in the columns BOX, as the store keeps it."""
    return df.withColumns(dict(zip(BOX, envelope(F.col("geometry.coordinates")))))


def write_store(df: DataFrame, path: str, files: int = 200) -> None:
    """Write records with their boxes, near ones into the same files: box queries then skip files and row groups by the boxes' statistics."""
    zone = F.floor(F.col("min_lat") * 10)
    with_box(df).repartitionByRange(files, zone, "min_lon").sortWithinPartitions(zone, "min_lon").write.mode("overwrite").parquet(path)


def in_box(df: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Records whose envelope overlaps a box, borders included, expired ones too; without geometry none. The columns BOX are used where they are there."""
    a, b, c, d = (F.col(n) for n in BOX) if set(BOX) <= set(df.columns) else envelope(F.col("geometry.coordinates"))
    return df.filter((c >= min_lon) & (a <= max_lon) & (d >= min_lat) & (b <= max_lat))


def features(df: DataFrame) -> DataFrame:
    """(id, feature): each record as a GeoJSON feature.

    value is a number, or, with the unit boolean, true or false; absent values are left out; times have milliseconds and Z; a Point has one position; a
    record without geometry has null. A null id gives a feature without one.
    """
    c = F.col("geometry.coordinates")
    times = [iso_ms(F.col(name)).alias(alias) for name, alias in (("observed_at", "observedAt"), ("verified_at", "verifiedAt"), ("review_due_at", "reviewDueAt"))]

    def feature(value: Column, geometry: Column) -> Column:
        properties = F.struct(
            "id", F.col("road_segment_id").alias("roadSegmentId"), F.col("value_source").alias("valueSource"), "direction", F.col("restriction_type").alias("restrictionType"), value.alias("value"), "unit",
            F.col("time_windows").alias("timeWindows"), "status", "source", times[0], F.col("verified_by").alias("verifiedBy"), *times[1:],
        )
        return F.to_json(F.struct(F.lit("Feature").alias("type"), "id", geometry.alias("geometry"), properties.alias("properties")))

    point = F.struct(F.lit("Point").alias("type"), F.try_element_at(c, F.lit(1)).alias("coordinates"))
    line = F.struct(F.col("geometry.type").alias("type"), c.alias("coordinates"))
    flag = F.coalesce(F.col("unit") == "boolean", F.lit(False))
    by_kind = lambda g: F.when(flag, feature(F.col("value_boolean"), g)).otherwise(feature(F.col("value_numeric"), g))
    none = F.regexp_replace(by_kind(F.lit(None).cast("struct<type:string>")), '"properties":', '"geometry":null,"properties":')
    return df.select("id", F.when(F.col("geometry").isNull(), none).when(F.col("geometry.type") == "Point", by_kind(point)).otherwise(by_kind(line)).alias("feature"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key, by order (descending columns first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upserted(base: DataFrame, incoming: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """base after an upsert: new keys are added, of known keys only the columns `changed` are taken over. Keys are unique in both; columns of incoming beyond base's are ignored."""
    take = incoming.select(F.col(key).alias("__k"), F.struct(*[c for c in base.columns]).alias("__new"))
    joined = base.withColumn("__old", F.lit(True)).join(take, F.col(key) == F.col("__k"), "full_outer")
    pick = lambda c: F.when(F.col("__old").isNull(), F.col(f"__new.{c}")).when(F.col("__k").isNotNull() & F.lit(c in changed), F.col(f"__new.{c}")).otherwise(F.col(c))
    return joined.select(*[pick(c).alias(c) for c in base.columns])


def without(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """base without the keys in ids (null keys delete nothing)."""
    return base.join(ids.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def audit_events(before: DataFrame, commands: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(restriction_id, event_type, old_row, new_row, actor): the audit rows of a batch of commands, one command for a key at most.

    commands: op (upsert, delete), actor, key and columns. As row triggers fire before a conflict is known, an upsert of a known key logs an
    insert as well as an update; an update is logged even if nothing changes; a delete of an unknown key logs nothing.
    """
    old = before.select(F.col(key).alias("__k"), F.to_json(F.struct(*columns)).alias("__old"))
    j = commands.join(old, F.col(key) == F.col("__k"), "left")
    new = F.to_json(F.struct(*columns))
    event = lambda kind, o, n: F.struct(F.lit(kind).alias("event_type"), o.cast("string").alias("old_row"), n.cast("string").alias("new_row"))
    none = F.lit(None)
    known = F.col("__k").isNotNull()
    events = F.when(F.col("op") == "delete", F.when(known, F.array(event("delete", F.col("__old"), none))).otherwise(F.array().cast("array<struct<event_type:string,old_row:string,new_row:string>>"))).otherwise(
        F.when(known, F.array(event("insert", none, new), event("update", F.col("__old"), new))).otherwise(F.array(event("insert", none, new)))
    )
    return j.select(F.col(key).alias("restriction_id"), F.inline(events), "actor").select("restriction_id", "event_type", "old_row", "new_row", "actor")


def event_changes(events: DataFrame) -> DataFrame:
    """(restriction_id, id, event_type, previous_type, seconds_since): each audit event with the one before it of the same record, by time then id; repeated rows count once."""
    w = Window.partitionBy("restriction_id").orderBy("occurred_at", "id")
    e = events.select("id", "restriction_id", "event_type", "occurred_at").distinct()
    since = F.unix_seconds(F.col("occurred_at").cast("timestamp")) - F.unix_seconds(F.lag("occurred_at").over(w).cast("timestamp"))
    return e.select("restriction_id", "id", "event_type", F.lag("event_type").over(w).alias("previous_type"), since.alias("seconds_since"))
