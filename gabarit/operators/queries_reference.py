"""The reference's own operators as queries over the given tables and derived views, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.functions import geo, polyline, text, timewindows
from gabarit.functions.crs import with_wgs84
from gabarit.operators import bridges, lines, osm, rules, store
from gabarit.plans import views
from gabarit.plans.reroute import mock, rerouted
from gabarit.plans.verdicts import corridor_reasons, requests, verdict_counts
from gabarit.sources.tables import table

BOX = (34.5, 31.0, 35.2, 32.0)
LIMIT = 5000  # the store's own limit for a box query


def _coords(spark: SparkSession, d: str) -> DataFrame:
    """(id, coords) of the restrictions with a geometry, repeated rows once."""
    r = table(spark, d, "restrictions").filter("geometry IS NOT NULL AND id IS NOT NULL")
    return r.select("id", F.transform("geometry.coordinates", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("coords")).distinct()


# --- store
def bbox_filter(spark, d):
    return store.in_box(table(spark, d, "restrictions"), *BOX).select("id", "restriction_type", "status").distinct()


def bbox_top_ids(spark, d):
    return bbox_filter(spark, d).select("id").distinct().orderBy("id").limit(LIMIT)


def bbox_parse(spark, d):
    return views.view(spark, d, views.BOXES, "part").select("box_id", text.bbox_parts(F.col("txt")).alias("b")).select("box_id", "b.*")


def feature_json(spark, d):
    return store.features(table(spark, d, "restrictions").filter("geometry IS NOT NULL").distinct())


def feature_fields(spark, d):
    """What the features say, read back from their text."""
    f, p = store.features(table(spark, d, "restrictions").distinct()), "$.properties."
    at = lambda path: F.get_json_object("feature", path)
    return f.select(
        "id", at("$.id").alias("feature_id"), at(p + "id").alias("property_id"), at("$.type").alias("kind"), at("$.geometry.type").alias("geometry_type"), at("$.geometry.coordinates[0]").try_cast("double").alias("lon"),
        F.when(at(p + "value").isin("true", "false"), at(p + "value")).alias("flag"), at(p + "value").try_cast("double").alias("number"), at(p + "unit").alias("unit"), at(p + "source.name").alias("source_name"),
        at(p + "observedAt").alias("observed_at"), at(p + "verifiedBy").alias("verified_by"), F.size(F.json_object_keys(at("$.properties"))).alias("keys"),
    )


def id_lookup(spark, d):
    ids = table(spark, d, "restriction_events").select(F.col("restriction_id").alias("id")).distinct()
    return table(spark, d, "restrictions").filter("geometry IS NOT NULL").join(ids, "id", "left_semi").select("id", "status").distinct()


def prefix_counts(spark, d):
    return table(spark, d, "restrictions").groupBy(F.substring("id", 1, 8).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def audit_batch(spark, d):
    base = table(spark, d, "restrictions").select("id", "status", "value_numeric").distinct()
    return store.audit_events(base, views.view(spark, d, views.COMMANDS, "part"), "id", ["id", "status", "value_numeric"]).select("restriction_id", "event_type", "actor", F.col("old_row").isNotNull().alias("has_old"), F.col("new_row").isNotNull().alias("has_new"))


def store_after_batch(spark, d):
    base = table(spark, d, "restrictions").select("id", "status", "value_numeric").distinct()
    c = views.view(spark, d, views.COMMANDS, "part")
    return store.without(store.upserted(base, c.filter("op = 'upsert'"), "id", ["value_numeric"]), c.filter("op = 'delete'"), "id")


def audit_changes(spark, d):
    return store.event_changes(table(spark, d, "restriction_events"))


def audit_last_state(spark, d):
    e = table(spark, d, "restriction_events").select("id", "restriction_id", "event_type", "occurred_at", F.get_json_object("new_row", "$.status").alias("status")).distinct()
    return store.latest(e, ["restriction_id"], [F.desc("occurred_at"), F.desc("id")]).select("restriction_id", "event_type", "status")


def profile_latest(spark, d):
    p = views.view(spark, d, views.PROFILES, "events")
    return store.latest(p, ["name"], [F.desc("version")]).filter(~F.col("deleted")).select("name", "version", "height_m")


# --- rules and windows
def check_violations(spark, d):
    v = rules.with_violations(table(spark, d, "restrictions").distinct(), rules.check_rules())
    return v.select(F.explode("violations").alias("rule"), "id").groupBy("rule").agg(F.count_distinct("id").alias("ids"))


def schema_violations(spark, d):
    v = rules.with_violations(table(spark, d, "restrictions").distinct(), rules.schema_rules())
    return v.select("id", F.explode("violations").alias("rule"))


def violation_summary(spark, d):
    v = rules.with_violations(table(spark, d, "restrictions").distinct(), rules.schema_rules())
    return v.groupBy("restriction_type").agg(F.count_if(F.size("violations") > 0).alias("invalid"), F.count(F.lit(1)).alias("records"))


def vehicle_violations(spark, d):
    v = rules.with_violations(table(spark, d, "vehicle_profiles").distinct(), rules.vehicle_rules())
    return v.select("profile_name", F.explode("violations").alias("rule"))


def local_time_parts(spark, d):
    date, time, day = timewindows.local_parts(F.col("occurred_at"))
    return table(spark, d, "restriction_events").select("id", date.alias("local_date"), time.alias("local_time"), day.alias("local_day")).distinct()


def active_windows(spark, d):
    r = table(spark, d, "restrictions").filter("size(time_windows) > 0").select("id", "time_windows", "observed_at").distinct()
    return r.select("id", timewindows.active(F.col("time_windows"), F.col("observed_at")).alias("active"))


def limit_conflicts(spark, d):
    """How many records each vehicle is over: limits are counted by value first, and only their values meet the vehicles."""
    v = table(spark, d, "vehicle_profiles").filter("profile_name IS NOT NULL").select("profile_name", *[c for c, _ in rules.LIMITS.values()]).distinct()
    v = v.groupBy("profile_name").agg(*[F.max(c).alias(c) for c, _ in rules.LIMITS.values()])
    of = v.select("profile_name", F.inline(F.array(*[F.struct(F.lit(t).alias("restriction_type"), F.col(c).alias("actual")) for t, (c, _) in rules.LIMITS.items()])))
    r = table(spark, d, "restrictions").select("id", "restriction_type", "value_numeric", "status").distinct().filter("value_numeric IS NOT NULL AND (status IS NULL OR status <> 'expired')")
    limits = r.groupBy("restriction_type", F.col("value_numeric").alias("lim")).agg(F.count(F.lit(1)).alias("n"))
    over = of.join(limits, "restriction_type").filter(F.col("actual").isNull() | (F.col("lim") < F.col("actual")))
    return over.groupBy("profile_name", "restriction_type").agg(F.sum("n").alias("conflicts"))


# --- lines
def corridor_join(spark, d):
    return lines.corridor(views.routes(spark, d), _coords(spark, d)).select("route_id", "id", F.round("distance_m", 4).alias("distance_m"))


def route_lengths(spark, d):
    return lines.lengths(views.routes(spark, d)).select("route_id", F.round("length_m", 3).alias("length_m"))


def point_at_fraction(spark, d):
    return lines.at_fraction(views.routes(spark, d), 0.4).select("route_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def route_reasons(spark, d):
    return corridor_reasons(requests(spark, d), views.routes(spark, d), _restrictions(spark, d)).select("route_id", "profile_name", "id", "reason", "active")


def route_verdicts(spark, d):
    return verdict_counts(corridor_reasons(requests(spark, d), views.routes(spark, d), _restrictions(spark, d)))


def reroute_outcomes(spark, d):
    """Each order's route as a straight line of some kilometres, bent round what its vehicle breaks."""
    v = views.vertices(spark, d).groupBy("route_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"))
    q = requests(spark, d).join(v, "route_id").withColumn("x2", F.col("x1") + 0.05).withColumn("y2", F.col("y1") + 0.04)
    out = rerouted(q, _restrictions(spark, d), mock(bulge=0.01, steps=4))
    return out.select("route_id", "outcome", "reroutes", F.concat_ws(",", "avoided").alias("avoided"), F.concat_ws(",", "conflicts").alias("conflicts"), "verified_on_route", "unverified_on_route")


def _restrictions(spark, d):
    r = table(spark, d, "restrictions").filter("geometry IS NOT NULL AND id IS NOT NULL AND (status IS NULL OR status <> 'expired')")
    return r.select("id", "restriction_type", "value_numeric", "value_boolean", "unit", "status", "time_windows", F.transform("geometry.coordinates", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("coords")).distinct()


# --- geometry
def exclusion_rings(spark, d):
    r = table(spark, d, "restrictions").select("id", "geometry").distinct().select("id", geo.middle(F.col("geometry.coordinates")).alias("m")).filter("m IS NOT NULL")
    return r.select("id", F.posexplode(geo.square_ring(F.get("m", F.lit(0)), F.get("m", F.lit(1)), 20.0)).alias("corner", "p")).select("id", "corner", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


def round_rings(spark, d):
    r = table(spark, d, "restrictions").select("id", "geometry").distinct().select("id", geo.middle(F.col("geometry.coordinates")).alias("m")).filter("m IS NOT NULL")
    return r.select("id", F.posexplode(geo.round_ring(F.get("m", F.lit(0)), F.get("m", F.lit(1)), 20.0, digits=12)).alias("corner", "p")).select("id", "corner", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


def marker_positions(spark, d):
    r = table(spark, d, "restrictions").select("id", "geometry").distinct().select("id", geo.middle(F.col("geometry.coordinates"), upper=False).alias("m"), geo.middle(F.col("geometry.coordinates")).alias("u")).filter("m IS NOT NULL")
    return r.select("id", F.get("m", F.lit(0)).alias("lon"), F.get("m", F.lit(1)).alias("lat"), F.get("u", F.lit(0)).alias("upper_lon"), F.get("u", F.lit(1)).alias("upper_lat"))


def envelopes(spark, d):
    a, b, c, e = store.envelope(F.col("geometry.coordinates"))
    return table(spark, d, "restrictions").filter("geometry IS NOT NULL").select("id", a.alias("min_lon"), b.alias("min_lat"), c.alias("max_lon"), e.alias("max_lat")).distinct()


def extent(spark, d):
    e = envelopes(spark, d).filter("min_lon <> 0")
    return e.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def bent_routes(spark, d):
    s = lines.segments(views.routes(spark, d), "route_id", "coords").filter("seg = 0")
    return s.select("route_id", F.posexplode(geo.bent_line(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 0.05, 8, 12)).alias("seq", "p")).select("route_id", "seq", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


def polyline_roundtrip(spark, d):
    v = views.view(spark, d, views.ROUTE_VERTICES, "lineitem")
    coded = polyline.encoded(v, "route_id", "seq", "x", "y")
    return polyline.decoded(coded, "route_id", "polyline").select("route_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def itm_positions(spark, d):
    b = with_wgs84(table(spark, d, "bridge_features").filter("x > 1000").select("objectid", "x", "y").distinct(), "x", "y", "lon", "lat")
    return b.select("objectid", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")).distinct()


# --- bridge import
def _imported(spark, d):
    return bridges.imported(bridges.properties_of(table(spark, d, "bridge_features").distinct()))


def parse_heights(spark, d):
    b = table(spark, d, "bridge_features").select("objectid", "gavrit_min").distinct()
    return b.select("objectid", text.height_or_reason(F.col("gavrit_min")).alias("h")).select("objectid", "h.value", "h.reason")


def month_starts(spark, d):
    b = table(spark, d, "bridge_features").select("objectid", "d_update").distinct()
    return b.select("objectid", F.date_format(text.month_start(F.col("d_update")), "yyyy-MM-dd").alias("month"))


def stable_ids(spark, d):
    return table(spark, d, "bridge_features").select("objectid", text.stable_id(F.coalesce("bridge_code", F.col("objectid").cast("string")), F.col("placement")).alias("id")).distinct()


def import_records(spark, d):
    return _imported(spark, d).filter("skip_reason IS NULL").select("index", "id", "height", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"))


def import_skips(spark, d):
    return _imported(spark, d).filter("skip_reason IS NOT NULL").select("index", "skip_reason", "detail")


def import_stats(spark, d):
    return bridges.import_stats(_imported(spark, d))


def import_warnings(spark, d):
    return bridges.import_warnings(_imported(spark, d))


# --- road network
def osm_class_coverage(spark, d):
    return osm.class_coverage(views.ways(spark, d))


def osm_tag_counts(spark, d):
    return osm.tag_counts(views.ways(spark, d), views.nodes(spark, d))


def osm_structures(spark, d):
    return osm.structure_totals(views.ways(spark, d))


def osm_regions(spark, d):
    return osm.region_totals(views.ways(spark, d))


def osm_units(spark, d):
    return osm.unit_histogram(views.ways(spark, d))


def osm_top_values(spark, d):
    return osm.top_values(views.ways(spark, d))


def osm_buckets(spark, d):
    return osm.height_buckets(views.ways(spark, d))


def osm_odd_values(spark, d):
    return osm.odd_values(views.ways(spark, d))


def osm_newest(spark, d):
    return osm.newest(views.ways(spark, d), views.nodes(spark, d))


def osm_bridges_by_kind(spark, d):
    return osm.bridges_by_kind(views.ways(spark, d))


def bridge_crossings(spark, d):
    u = osm.underpasses(views.ways(spark, d), views.nodes(spark, d))
    return u.select("bridge_id", "road_id", "kind", "class", "source", F.round("height", 4).alias("height"))


def underpass_summary(spark, d):
    return osm.underpass_classes(osm.underpass_counts(views.ways(spark, d), views.nodes(spark, d)))


def clearance_counts(spark, d):
    return osm.clearance_counts(osm.underpass_counts(views.ways(spark, d), views.nodes(spark, d)))


def bridges_over_roads(spark, d):
    return osm.bridges_over_roads(osm.crossed_bridges(views.ways(spark, d)))


def underpass_totals(spark, d):
    return osm.underpass_totals(osm.underpass_counts(views.ways(spark, d), views.nodes(spark, d)))


def audit_stream(spark, d):
    from gabarit.streaming.audit import drained_counts

    return drained_counts(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        bbox_filter, bbox_top_ids, bbox_parse, feature_json, feature_fields, id_lookup, prefix_counts, audit_batch, store_after_batch, audit_changes, audit_last_state, profile_latest, check_violations, schema_violations,
        violation_summary, vehicle_violations, local_time_parts, active_windows, limit_conflicts, corridor_join, route_lengths, point_at_fraction, route_reasons, route_verdicts, reroute_outcomes, exclusion_rings, round_rings,
        marker_positions, envelopes, extent, bent_routes, polyline_roundtrip, itm_positions, parse_heights, month_starts, stable_ids, import_records, import_skips, import_stats, import_warnings,
        osm_class_coverage, osm_tag_counts, osm_structures, osm_regions, osm_units, osm_top_values, osm_buckets, osm_odd_values, osm_newest, osm_bridges_by_kind, bridge_crossings, underpass_summary,
        clearance_counts, bridges_over_roads, underpass_totals, audit_stream,
    )
}

# --- the same in SQL
_ENV = "list_min(list_transform(geometry.coordinates, lambda p: p[1])) min_lon, list_min(list_transform(geometry.coordinates, lambda p: p[2])) min_lat, list_max(list_transform(geometry.coordinates, lambda p: p[1])) max_lon, list_max(list_transform(geometry.coordinates, lambda p: p[2])) max_lat"
_BOXED = f"SELECT id, restriction_type, status FROM (SELECT *, {_ENV} FROM restrictions WHERE geometry IS NOT NULL) WHERE max_lon >= 34.5 AND min_lon <= 35.2 AND max_lat >= 31.0 AND min_lat <= 32.0"
_NUM = r"CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN cast(trim({0}) AS double) END"
_HAV = "2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"
_V = f"v AS ({views.duck(views.ROUTE_VERTICES, 'lineitem')})"
_SEGS = f"{_V}, s AS (SELECT * FROM (SELECT route_id, seq, x x1, y y1, lead(x) OVER w x2, lead(y) OVER w y2, count(*) OVER (PARTITION BY route_id) n FROM v WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE x2 IS NOT NULL)"
_SEGS_ALL = f"{_V}, s AS (SELECT route_id, seq, x1, y1, coalesce(x2, x1) x2, coalesce(y2, y1) y2 FROM (SELECT route_id, seq, x x1, y y1, lead(x) OVER w x2, lead(y) OVER w y2, count(*) OVER (PARTITION BY route_id) n FROM v WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE x2 IS NOT NULL OR n = 1)"
# metres from (px, py) to a segment
_PS = ("(SELECT sqrt((qx - t * dx) * (qx - t * dx) + (qy - t * dy) * (qy - t * dy)) * 6371008.8e0 FROM (SELECT dx, dy, qx, qy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) ELSE 0e0 END t "
       "FROM (SELECT radians({4} - {2}) * cos(radians({1})) dx, radians({5} - {3}) dy, radians({0} - {2}) * cos(radians({1})) qx, radians({1} - {3}) qy)))")  # fmt: skip
_THINGS = """g AS (SELECT DISTINCT id, geometry.coordinates c FROM restrictions WHERE geometry IS NOT NULL AND id IS NOT NULL),
t AS (SELECT id, c[i][1] tx1, c[i][2] ty1, coalesce(c[i + 1][1], c[i][1]) tx2, coalesce(c[i + 1][2], c[i][2]) ty2 FROM (SELECT id, c, unnest(range(1, greatest(len(c), 2))) i FROM g))"""
_CROSS = "(abs(den) >= 1e-12 AND ((ax - px) * sy - (ay - py) * sx) / den BETWEEN -{0} AND 1 + {0} AND ((ax - px) * ry - (ay - py) * rx) / den BETWEEN -{0} AND 1 + {0})"
_CORRIDOR = f"""{_SEGS_ALL}, {_THINGS},
m AS (SELECT *, tx2 - tx1 rx, ty2 - ty1 ry, x2 - x1 sx, y2 - y1 sy, tx1 px, ty1 py, x1 ax, y1 ay, (tx2 - tx1) * (y2 - y1) - (ty2 - ty1) * (x2 - x1) den FROM s JOIN t
  ON greatest(tx1, tx2) >= least(x1, x2) - 1e-3 AND least(tx1, tx2) <= greatest(x1, x2) + 1e-3 AND greatest(ty1, ty2) >= least(y1, y2) - 1e-3 AND least(ty1, ty2) <= greatest(y1, y2) + 1e-3),
h AS (SELECT route_id, id, min(CASE WHEN tx1 = tx2 AND ty1 = ty2 THEN {_PS.format("tx1", "ty1", "x1", "y1", "x2", "y2")} WHEN {_CROSS.format("0e0")} THEN 0e0 ELSE
  least({_PS.format("tx1", "ty1", "x1", "y1", "x2", "y2")}, {_PS.format("tx2", "ty2", "x1", "y1", "x2", "y2")}, {_PS.format("x1", "y1", "tx1", "ty1", "tx2", "ty2")}, {_PS.format("x2", "y2", "tx1", "ty1", "tx2", "ty2")}) END) d FROM m GROUP BY ALL),
c AS (SELECT route_id, id, d FROM h WHERE d <= 50)"""
_ACTIVE = """(w IS NULL OR len(w) = 0 OR len(list_filter(w, lambda e: (coalesce(e.valid_from, '') = '' OR ld >= e.valid_from) AND (coalesce(e.valid_until, '') = '' OR ld <= e.valid_until)
  AND (e.days IS NULL OR len(e.days) = 0 OR len(list_filter(e.days, lambda k: k NOT IN ('sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat'))) > 0 OR list_contains(e.days, lw))
  AND (coalesce(e.start_time, '') = '' OR coalesce(e.end_time, '') = '' OR CASE WHEN e.start_time <= e.end_time THEN lt >= e.start_time AND lt < e.end_time ELSE lt >= e.start_time OR lt < e.end_time END))) > 0)"""
_LOCAL = "strftime({0} AT TIME ZONE 'Asia/Jerusalem', '%Y-%m-%d') ld, strftime({0} AT TIME ZONE 'Asia/Jerusalem', '%H:%M') lt, lower(strftime({0} AT TIME ZONE 'Asia/Jerusalem', '%a')) lw"
_LIMITS = {t: (c, f) for t, (c, f) in rules.LIMITS.items()}
_ACTUAL = "CASE restriction_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, (c, _) in _LIMITS.items()) + " END"
_FIELD = "CASE restriction_type " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, (_, f) in _LIMITS.items()) + " END"
_TXT = "CASE WHEN {0} = floor({0}) THEN cast(cast({0} AS bigint) AS varchar) ELSE cast({0} AS varchar) END"
_VEHICLES = "vn AS (SELECT *, try_cast(regexp_extract(profile_name, '([0-9]+)$', 1) AS bigint) vehicle_no FROM vehicle_profiles WHERE profile_name IS NOT NULL), vg AS (SELECT vehicle_no, min(profile_name) profile_name, " + ", ".join(f"max({c}) {c}" for c, _ in rules.LIMITS.values()) + ", max(hazmat IS NOT NULL) hz FROM vn WHERE vehicle_no IS NOT NULL GROUP BY ALL)"
_REASONS = f"""WITH {_CORRIDOR}, {_VEHICLES},
r AS (SELECT DISTINCT id, restriction_type, value_numeric, value_boolean, unit, status, time_windows w, geometry FROM restrictions WHERE geometry IS NOT NULL AND id IS NOT NULL AND (status IS NULL OR status <> 'expired')),
q AS (SELECT o_orderkey route_id, o_orderkey % 40 vehicle_no, (CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT))) AT TIME ZONE 'UTC' tsz FROM orders),
j AS (SELECT c.route_id, vg.*, r.*, {_LOCAL.format("tsz")} FROM c JOIN r USING (id) JOIN q USING (route_id) JOIN vg USING (vehicle_no)),
k AS (SELECT *, {_ACTIVE} active, {_ACTUAL} act, {_FIELD} fld FROM j),
z AS (SELECT *, CASE WHEN active THEN CASE WHEN fld IS NOT NULL THEN CASE WHEN value_numeric IS NULL THEN NULL WHEN act IS NULL THEN fld || ' not given; limit ' || {_TXT.format("value_numeric")} || ' ' || unit
  WHEN value_numeric < act THEN fld || ' ' || {_TXT.format("act")} || ' > limit ' || {_TXT.format("value_numeric")} || ' ' || unit END
  WHEN restriction_type = 'truck_prohibited' AND value_boolean THEN 'trucks prohibited' WHEN restriction_type = 'hazmat_restriction' AND value_boolean AND hz THEN 'hazmat prohibited and vehicle carries hazmat' END END reason FROM k)"""
_TAIL = _REASONS[_REASONS.index(_VEHICLES):]
_LINES = f"""{_V}, o AS (SELECT route_id, min(x) x1, min(y) y1, min(x) + 0.05e0 x2, min(y) + 0.04e0 y2 FROM v GROUP BY ALL),
p AS (SELECT route_id, bent, i, round(x1 + (x2 - x1) * (i / 4e0) - (y2 - y1) / ln * (sin(pi() * i / 4e0) * b), 6) x, round(y1 + (y2 - y1) * (i / 4e0) + (x2 - x1) / ln * (sin(pi() * i / 4e0) * b), 6) y
  FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) ln FROM o), (SELECT unnest([0, 1]) bent, unnest([0e0, 0.01e0]) b), (SELECT unnest(range(5)) i)),
s AS (SELECT route_id * 2 + bent route_id, x x1, y y1, lead(x) OVER w x2, lead(y) OVER w y2 FROM p WINDOW w AS (PARTITION BY route_id, bent ORDER BY i) QUALIFY x2 IS NOT NULL)"""
_BOTH = "WITH " + _CORRIDOR.replace(_SEGS_ALL, _LINES) + ", " + _TAIL.replace("JOIN q USING (route_id)", "JOIN q ON q.route_id = c.route_id // 2")
_REROUTE = _BOTH + """, y AS (SELECT route_id // 2 route_id, route_id % 2 bent, list_sort(list(DISTINCT id) FILTER (WHERE reason IS NOT NULL)) ids, count(*) FILTER (WHERE reason IS NULL AND coalesce(status = 'verified', false)) vf,
  count(*) FILTER (WHERE reason IS NULL AND NOT coalesce(status = 'verified', false)) uv FROM z GROUP BY ALL),
e AS (SELECT q.route_id, coalesce(a.ids, []) c0, coalesce(b.ids, []) c1, coalesce(a.vf, 0) v0, coalesce(a.uv, 0) u0, coalesce(b.vf, 0) v1, coalesce(b.uv, 0) u1 FROM q JOIN vg USING (vehicle_no) JOIN o USING (route_id)
  LEFT JOIN y a ON a.route_id = q.route_id AND a.bent = 0 LEFT JOIN y b ON b.route_id = q.route_id AND b.bent = 1)
SELECT route_id, CASE WHEN len(c0) = 0 OR len(c1) = 0 THEN 'clear' ELSE 'no_effect' END outcome, CASE WHEN len(c0) = 0 THEN 0 WHEN len(list_filter(c1, lambda k: NOT list_contains(c0, k))) = 0 THEN 1 ELSE 2 END reroutes,
 CASE WHEN len(c0) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(c0, c1))), ',') END avoided, CASE WHEN len(c0) = 0 THEN '' ELSE array_to_string(c1, ',') END conflicts,
 CASE WHEN len(c0) = 0 THEN v0 ELSE v1 END verified_on_route, CASE WHEN len(c0) = 0 THEN u0 ELSE u1 END unverified_on_route FROM e"""
_T, _D, _W, _B = (", ".join(f"'{x}'" for x in xs) for xs in (rules.TYPES, rules.DIMENSIONS, rules.WEIGHTS, rules.BANS))
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CHECKS = {
    "id_null": "id IS NULL", "road_segment_id_null": "road_segment_id IS NULL", "direction_null": "direction IS NULL", "unit_null": "unit IS NULL", "status_null": "status IS NULL", "source_null": "source IS NULL",
    "observed_at_null": "observed_at IS NULL", "restriction_type_null": "restriction_type IS NULL", "geometry_type": "geometry.type NOT IN ('Point', 'LineString')", "value_source": f"value_source NOT IN ({_IN(rules.VALUE_SOURCES)})",
    "direction": f"direction NOT IN ({_IN(rules.DIRECTIONS)})", "restriction_type": f"restriction_type NOT IN ({_T})", "unit": "unit NOT IN ('m', 't', 'boolean')", "status": f"status NOT IN ({_IN(rules.STATUSES)})",
    "source_keys": "source.name IS NULL OR source.reference IS NULL", "value_pair": "NOT ((unit = 'boolean' AND value_boolean IS NOT NULL AND value_numeric IS NULL) OR (unit IN ('m', 't') AND value_numeric IS NOT NULL AND value_boolean IS NULL))",
    "value_range": "value_numeric IS NOT NULL AND NOT (value_numeric > 0 AND value_numeric <= 200)", "dimension": f"restriction_type IN ({_D}) AND NOT (unit = 'm' AND value_source IS NOT NULL AND value_numeric <= 50)",
    "weight": f"restriction_type IN ({_W}) AND unit <> 't'", "ban": f"restriction_type IN ({_B}) AND unit <> 'boolean'", "verified": "status = 'verified' AND NOT (verified_by IS NOT NULL AND verified_at IS NOT NULL)",
}
_WINDOW_BAD = r"""len(list_filter(time_windows, lambda w: (w.days IS NULL AND w.start_time IS NULL AND w.end_time IS NULL AND w.valid_from IS NULL AND w.valid_until IS NULL AND w.note IS NULL)
 OR (w.days IS NOT NULL AND (len(w.days) = 0 OR len(list_distinct(w.days)) <> len(w.days) OR len(list_filter(w.days, lambda k: k NOT IN ('sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat'))) > 0))
 OR coalesce(NOT regexp_full_match(w.start_time, '([01][0-9]|2[0-3]):[0-5][0-9]'), false) OR coalesce(NOT regexp_full_match(w.end_time, '([01][0-9]|2[0-3]):[0-5][0-9]'), false)
 OR (w.valid_from IS NOT NULL AND try_cast(w.valid_from AS date) IS NULL) OR (w.valid_until IS NOT NULL AND try_cast(w.valid_until AS date) IS NULL) OR (w.start_time IS NULL) <> (w.end_time IS NULL))) > 0"""
_SCHEMA = {
    "id": "coalesce(id, '') = ''", "roadSegmentId": "coalesce(road_segment_id, '') = ''",
    "geometry": "geometry IS NOT NULL AND coalesce(NOT ((geometry.type = 'Point' AND len(geometry.coordinates) = 1) OR (geometry.type = 'LineString' AND len(geometry.coordinates) >= 2)) OR len(list_filter(geometry.coordinates, lambda p: NOT (len(p) BETWEEN 2 AND 3 AND p[1] BETWEEN -180 AND 180 AND p[2] BETWEEN -90 AND 90))) > 0, true)",
    "valueSource": f"value_source NOT IN ({_IN(rules.VALUE_SOURCES)})", "direction": f"direction NOT IN ({_IN(rules.DIRECTIONS)})", "restrictionType": f"coalesce(restriction_type NOT IN ({_T}), true)",
    "value": "value_numeric IS NULL AND value_boolean IS NULL", "unit": "coalesce(unit NOT IN ('m', 't', 'boolean'), true)", "timeWindows": f"time_windows IS NOT NULL AND (len(time_windows) = 0 OR {_WINDOW_BAD})",
    "status": f"coalesce(status NOT IN ({_IN(rules.STATUSES)}), true)", "source.name": "coalesce(source.name, '') = ''", "source.reference": "coalesce(source.reference, '') = ''",
    "source.url": r"source.url IS NOT NULL AND NOT regexp_full_match(source.url, '[A-Za-z][A-Za-z0-9+.-]*:\S+')", "source.license": "source.license = ''", "observedAt": "observed_at IS NULL", "verifiedBy": "verified_by = ''",
    "dimension": f"restriction_type IN ({_D}) AND coalesce(NOT (value_source IS NOT NULL AND value_numeric > 0 AND value_numeric <= 50 AND unit = 'm'), true)",
    "weight": f"restriction_type IN ({_W}) AND coalesce(NOT (value_numeric > 0 AND value_numeric <= 200 AND unit = 't'), true)", "ban": f"restriction_type IN ({_B}) AND coalesce(NOT (value_boolean IS NOT NULL AND unit = 'boolean'), true)",
    "verified": "status = 'verified' AND (verified_by IS NULL OR verified_at IS NULL)",
}
_VEHICLE = {
    "profile_name": "coalesce(length(profile_name) NOT BETWEEN 1 AND 120, true)", "height_m": "coalesce(height_m NOT BETWEEN 1 AND 6, true)", "width_m": "coalesce(width_m NOT BETWEEN 1 AND 6, true)", "length_m": "coalesce(length_m NOT BETWEEN 2 AND 60, true)",
    "gross_weight_t": "coalesce(gross_weight_t NOT BETWEEN 0.5 AND 200, true)", "axle_load_t": "axle_load_t NOT BETWEEN 0.5 AND 40",
    "hazmat": f"hazmat IS NOT NULL AND coalesce(len(hazmat.adr_classes) < 1 OR len(list_distinct(hazmat.adr_classes)) <> len(hazmat.adr_classes) OR len(list_filter(hazmat.adr_classes, lambda k: k NOT IN ({_IN(rules.ADR_CLASSES)}))) > 0, true)",
}
_BROKEN = lambda cases: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases.items()) + "], lambda k: k IS NOT NULL)"
_MID = "SELECT DISTINCT id, geometry.coordinates[len(geometry.coordinates) // 2 + 1] m, geometry.coordinates[(len(geometry.coordinates) - 1) // 2 + 1] l FROM restrictions WHERE len(geometry.coordinates) > 0"
_H = "CASE WHEN coalesce(trim({0}), '') = '' THEN 'blank' WHEN n IS NULL THEN 'non_numeric' WHEN n = -1 THEN 'sentinel_-1' WHEN n = 9999 THEN 'sentinel_9999' WHEN n <= 0 THEN 'non_positive' WHEN n > 50 THEN 'out_of_range_gt_50' END"
_MONTH = r"CASE WHEN regexp_full_match(regexp_replace(trim({0}), '\.0+$', ''), '[0-9]{{6}}') AND cast(substr(trim({0}), 5, 2) AS int) BETWEEN 1 AND 12 AND cast(substr(trim({0}), 1, 4) AS int) >= 1900 THEN substr(trim({0}), 1, 4) || '-' || substr(trim({0}), 5, 2) || '-01' END"
_SID = "'mot-bridge-' || regexp_replace({0}, '[^A-Za-z0-9_-]', '_', 'g') || CASE WHEN coalesce({1}, '') <> '' THEN '-' || regexp_replace({1}, '[^A-Za-z0-9_-]', '_', 'g') ELSE '' END || '-maxheight-' || substr(sha1('mot-bridges|' || {0} || '|' || coalesce({1}, '') || '|max_height'), 1, 12)"
_IMPORT = f"""WITH b AS (SELECT DISTINCT *, coalesce(nullif(trim(bridge_code), ''), cast(objectid AS varchar)) k, CASE WHEN function_code BETWEEN 1 AND 7 THEN function_code END fn, nullif(trim(placement), '') pl FROM bridge_features),
n AS (SELECT *, {_NUM.format("regexp_replace(trim(gavrit_min), ',', '.')")} n, CASE WHEN regexp_matches(crs_name, '2039') THEN true WHEN regexp_matches(crs_name, '4326|CRS84') THEN false ELSE coalesce(x > 100000 AND x < 300000 AND y > 350000 AND y < 820000, false) END itm FROM b),
h AS (SELECT *, {_H.format("gavrit_min")} why FROM n),
s AS (SELECT *, CASE WHEN k IS NULL THEN 'missing_id' WHEN fn NOT IN (1, 3, 6) THEN 'not_over_road' WHEN why IS NOT NULL THEN 'unknown_height'
  WHEN x IS NULL OR y IS NULL OR isnan(x) OR isnan(y) OR (NOT itm AND NOT (x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90)) THEN 'invalid_geometry' END skip_reason FROM h),
i AS (SELECT *, CASE WHEN skip_reason IS NULL THEN {_SID.format("k", "pl")} END base FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY objectid) rn FROM i)"""
_WAYS = f"w AS ({views.duck(views.WAYS, 'orders')}), nd AS ({views.duck(views.NODES, 'orders')})"
_RAW = "coalesce(nullif(maxheight, ''), nullif(maxheight_physical, ''))"
_MET = r"""CASE WHEN regexp_full_match(replace({0}, ',', '.'), '\s*[0-9]+(\.[0-9]+)?\s*m?\s*') THEN cast(regexp_extract(replace({0}, ',', '.'), '([0-9]+(\.[0-9]+)?)', 1) AS double)
 WHEN regexp_full_match({0}, '\s*[0-9]+\s*''\s*([0-9]+\s*")?\s*') THEN (cast(regexp_extract({0}, '([0-9]+)', 1) AS double) * 12 + coalesce(try_cast(regexp_extract({0}, '''\s*([0-9]+)', 1) AS double), 0)) * 0.0254e0
 WHEN regexp_full_match({0}, '\s*[0-9]+(\.[0-9]+)?\s*ft\s*') THEN cast(regexp_extract({0}, '([0-9]+(\.[0-9]+)?)', 1) AS double) * 0.3048e0 END"""
_UNIT = r"""CASE WHEN regexp_full_match(replace({0}, ',', '.'), '\s*[0-9]+(\.[0-9]+)?\s*') THEN 'bare-number' WHEN regexp_full_match(replace({0}, ',', '.'), '\s*[0-9]+(\.[0-9]+)?\s*m\s*') THEN 'm'
 WHEN regexp_full_match({0}, '\s*[0-9]+\s*''\s*([0-9]+\s*")?\s*') THEN 'ft/in' WHEN regexp_full_match({0}, '\s*[0-9]+(\.[0-9]+)?\s*ft\s*') THEN 'ft' ELSE 'non-numeric' END"""
_CLS = lambda xs: f"CASE WHEN regexp_replace(highway, '_link$', '') IN ({_IN(xs)}) THEN regexp_replace(highway, '_link$', '') ELSE 'other' END"
_ROADS = f"{_WAYS}, rd0 AS (SELECT *, {_CLS(text.COVERAGE_CLASSES)} class, {_RAW} raw FROM w WHERE coalesce(highway, '') <> '' AND highway NOT IN ({_IN(text.NON_ROADS)})), rd AS (SELECT *, {_MET.format('raw')} met, {_UNIT.format('raw')} unit FROM rd0)"


def _odd(x: str, y: str, ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, ring[-1:] + ring[:-1])
    return "(" + " + ".join(f"cast(({y1}e0 > {y}) <> ({y2}e0 > {y}) AND {x} < ({x2}e0 - {x1}e0) * ({y} - {y1}e0) / {(y2 - y1) or 1.0}e0 + {x1}e0 AS int)" for (x1, y1), (x2, y2) in edges) + ") % 2 = 1"


_LAYER = r"CASE WHEN regexp_full_match(trim(layer), '[+-]?[0-9]+(\.[0-9]*)?') THEN cast(trunc(cast(trim(layer) AS double)) AS int) ELSE {0} END"
_UNDER = f"""WITH {_WAYS},
u AS (SELECT *, railway IS NOT NULL AND coalesce(bridge <> 'no', false) rb, coalesce(bridge <> 'no', false) br FROM w),
k AS (SELECT * FROM u WHERE (coalesce(highway, '') <> '' AND (highway NOT IN ({_IN(text.NOT_CROSSED)}) OR rb)) OR (coalesce(highway, '') = '' AND rb)),
b AS (SELECT *, CASE WHEN coalesce(highway, '') <> '' THEN 'road' WHEN railway IS NOT NULL AND bridge = 'yes' THEN 'rail' END kind, {_LAYER.format(1)} lay FROM k WHERE br),
r AS (SELECT *, {_CLS(text.CROSSING_CLASSES)} class, {_LAYER.format(0)} lay, {_RAW} raw FROM k WHERE coalesce(highway, '') <> '' AND NOT br AND coalesce(tunnel, 'no') = 'no' AND coalesce(covered, '') <> 'yes'),
bs AS (SELECT way_id bid, kind, lay bl, x1 ax, y1 ay, x2 bx, y2 b_y, 0 bi, n1 bn1, n2 bn2, n3 bn3 FROM b WHERE kind IS NOT NULL UNION ALL SELECT way_id, kind, lay, x2, y2, x3, y3, 1, n1, n2, n3 FROM b WHERE kind IS NOT NULL),
rs AS (SELECT way_id rid, class, lay rl, raw, x1 cx, y1 cy, x2 dx, y2 dy, 0 ri, n1, n2, n3 FROM r UNION ALL SELECT way_id, class, lay, raw, x2, y2, x3, y3, 1, n1, n2, n3 FROM r),
m AS (SELECT *, bx - ax px, b_y - ay py, dx - cx qx, dy - cy qy, (bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx) den FROM bs JOIN rs ON rl < bl
  AND greatest(ax, bx) >= least(cx, dx) AND least(ax, bx) <= greatest(cx, dx) AND greatest(ay, b_y) >= least(cy, dy) AND least(ay, b_y) <= greatest(cy, dy)),
t AS (SELECT *, ((cx - ax) * qy - (cy - ay) * qx) / den tt, ((cx - ax) * py - (cy - ay) * px) / den uu FROM m WHERE abs(den) >= 1e-12),
e AS (SELECT bid, rid, min_by(struct_pack(x := ax + tt * px, y := ay + tt * py), ri * 10 + bi) met_at FROM t WHERE tt BETWEEN -1e-9 AND 1 + 1e-9 AND uu BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY ALL),
f AS (SELECT bid, rid, b.kind, r.class, r.raw, e.met_at.x x, e.met_at.y y, [r.n1, r.n2, r.n3] ns FROM e JOIN b ON b.way_id = bid JOIN r ON r.way_id = rid
  WHERE NOT list_has_any([b.n1, b.n2, b.n3], [r.n1, r.n2, r.n3])),
al AS (SELECT way_id rid, unnest([n1, n2, n3]) node_id, unnest([0, 1, 2]) pos FROM r),
nr AS (SELECT f.bid, f.rid, min_by(nd.maxheight, pos) nt FROM f JOIN al USING (rid) JOIN nd USING (node_id) WHERE f.raw IS NULL AND nullif(nd.maxheight, '') IS NOT NULL AND {_HAV.format("f.x", "f.y", "nd.lon", "nd.lat")} <= 30 GROUP BY ALL),
un AS (SELECT bid bridge_id, rid road_id, kind, class, CASE WHEN raw IS NOT NULL THEN 'way_tag' WHEN nt IS NOT NULL THEN 'node_within_30m' END source, coalesce(raw, nt) ht FROM f LEFT JOIN nr USING (bid, rid)),
uh AS (SELECT *, {_MET.format("ht")} height FROM un)"""
_PARTS = "SELECT box_id, string_split(txt, ',') p FROM (" + views.duck(views.BOXES, "part") + ")"
_BOXN = f"SELECT box_id, p, list_transform(p, lambda e: {_NUM.format('e')}) n FROM ({_PARTS})"
_BOXE = "CASE WHEN len(p) <> 4 THEN 'four numbers expected' WHEN len(list_filter(n, lambda e: e IS NULL)) > 0 THEN 'not a number' WHEN NOT (n[1] BETWEEN -180 AND 180 AND n[3] BETWEEN -180 AND 180 AND n[2] BETWEEN -90 AND 90 AND n[4] BETWEEN -90 AND 90) THEN 'out of range' WHEN n[1] >= n[3] OR n[2] >= n[4] THEN 'empty box' END"
_CMD = f"c AS ({views.duck(views.COMMANDS, 'part')}), base AS (SELECT DISTINCT id, status, value_numeric FROM restrictions)"

SQL: dict[str, str] = {
    "bbox_filter": f"SELECT DISTINCT * FROM ({_BOXED})",
    "bbox_top_ids": f"SELECT DISTINCT id FROM ({_BOXED}) ORDER BY id LIMIT {LIMIT}",
    "bbox_parse": f"SELECT box_id, error, " + ", ".join(f"CASE WHEN error IS NULL THEN n[{i}] END {c}" for i, c in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"), 1)) + f" FROM (SELECT *, {_BOXE} error FROM ({_BOXN}))",
    "id_lookup": "SELECT DISTINCT id, status FROM restrictions WHERE geometry IS NOT NULL AND id IN (SELECT restriction_id FROM restriction_events)",
    "prefix_counts": "SELECT substr(id, 1, 8) prefix, count(*) n FROM restrictions GROUP BY ALL",
    "audit_batch": f"""WITH {_CMD}, j AS (SELECT c.*, base.id IS NOT NULL known FROM c LEFT JOIN base USING (id))
SELECT id restriction_id, 'delete' event_type, actor, true has_old, false has_new FROM j WHERE op = 'delete' AND known UNION ALL SELECT id, 'insert', actor, false, true FROM j WHERE op = 'upsert'
UNION ALL SELECT id, 'update', actor, true, true FROM j WHERE op = 'upsert' AND known""",
    "store_after_batch": f"""WITH {_CMD} SELECT coalesce(base.id, c.id) id, coalesce(base.status, CASE WHEN base.id IS NULL THEN c.status END) status, CASE WHEN c.id IS NOT NULL THEN c.value_numeric ELSE base.value_numeric END value_numeric
FROM base FULL JOIN (SELECT * FROM c WHERE op = 'upsert') c ON base.id = c.id WHERE coalesce(base.id, c.id) NOT IN (SELECT id FROM c WHERE op = 'delete')""",
    "audit_changes": """SELECT restriction_id, id, event_type, lag(event_type) OVER w previous_type, cast(floor(epoch(occurred_at)) - floor(epoch(lag(occurred_at) OVER w)) AS bigint) seconds_since
FROM (SELECT DISTINCT id, restriction_id, event_type, occurred_at FROM restriction_events) WINDOW w AS (PARTITION BY restriction_id ORDER BY occurred_at, id)""",
    "audit_last_state": """SELECT restriction_id, event_type, json_extract_string(new_row, '$.status') status FROM restriction_events QUALIFY row_number() OVER (PARTITION BY restriction_id ORDER BY occurred_at DESC, id DESC) = 1""",
    "profile_latest": f"SELECT name, version, height_m FROM (SELECT * FROM ({views.duck(views.PROFILES, 'events')}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1) WHERE NOT deleted",
    "check_violations": f"SELECT unnest({_BROKEN(_CHECKS)}) rule, count(DISTINCT id) ids FROM restrictions GROUP BY ALL" if False else f"SELECT rule, count(DISTINCT id) ids FROM (SELECT id, unnest({_BROKEN(_CHECKS)}) rule FROM restrictions) GROUP BY ALL",
    "schema_violations": f"SELECT id, unnest({_BROKEN(_SCHEMA)}) rule FROM (SELECT DISTINCT * FROM restrictions)",
    "violation_summary": f"SELECT restriction_type, count(*) FILTER (WHERE len({_BROKEN(_SCHEMA)}) > 0) invalid, count(*) records FROM (SELECT DISTINCT * FROM restrictions) GROUP BY ALL",
    "vehicle_violations": f"SELECT profile_name, unnest({_BROKEN(_VEHICLE)}) rule FROM (SELECT DISTINCT * FROM vehicle_profiles)",
    "local_time_parts": f"SELECT DISTINCT id, ld local_date, lt local_time, lw local_day FROM (SELECT id, {_LOCAL.format('occurred_at')} FROM restriction_events)",
    "active_windows": f"SELECT id, {_ACTIVE} active FROM (SELECT DISTINCT id, time_windows w, {_LOCAL.format('observed_at')} FROM restrictions WHERE len(time_windows) > 0)",
    "limit_conflicts": "WITH v AS (SELECT profile_name, " + ", ".join(f"max({c}) {c}" for c, _ in rules.LIMITS.values()) + " FROM vehicle_profiles WHERE profile_name IS NOT NULL GROUP BY ALL), r AS (SELECT DISTINCT id, restriction_type, value_numeric FROM restrictions WHERE value_numeric IS NOT NULL AND (status IS NULL OR status <> 'expired')), "
    + f"j AS (SELECT profile_name, restriction_type, value_numeric lim, {_ACTUAL} act FROM v, r WHERE restriction_type IN ({_D}, {_W})) SELECT profile_name, restriction_type, count(*) conflicts FROM j WHERE act IS NULL OR lim < act GROUP BY ALL",
    "corridor_join": f"WITH {_CORRIDOR} SELECT route_id, id, round(d, 4) distance_m FROM c",
    "route_lengths": f"WITH {_SEGS_ALL} SELECT route_id, round(sum({_HAV.format('x1', 'y1', 'x2', 'y2')}), 3) length_m FROM s GROUP BY ALL",
    "point_at_fraction": f"""WITH {_SEGS_ALL}, d AS (SELECT *, {_HAV.format("x1", "y1", "x2", "y2")} dd FROM s), u AS (SELECT *, sum(dd) OVER (PARTITION BY route_id ORDER BY seq) upto, sum(dd) OVER (PARTITION BY route_id) total, max(seq) OVER (PARTITION BY route_id) lst FROM d),
f AS (SELECT *, 0.4e0 * total - (upto - dd) lft FROM u WHERE upto >= 0.4e0 * total OR seq = lst QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY seq) = 1)
SELECT route_id, round(x1 + (x2 - x1) * t, 6) lon, round(y1 + (y2 - y1) * t, 6) lat FROM (SELECT *, CASE WHEN dd > 0 THEN least(lft / dd, 1e0) ELSE 0e0 END t FROM f)""",
    "route_reasons": f"{_REASONS} SELECT route_id, profile_name, id, reason, active FROM z",
    "route_verdicts": f"{_REASONS} SELECT route_id, count(reason) conflicts, count(*) FILTER (WHERE reason IS NULL AND coalesce(status = 'verified', false)) verified_on_route, count(*) FILTER (WHERE reason IS NULL AND NOT coalesce(status = 'verified', false)) unverified_on_route FROM z GROUP BY ALL",
    "reroute_outcomes": _REROUTE,
    "exclusion_rings": f"""WITH m AS ({_MID}), p AS (SELECT id, m[1] x, m[2] y, 20e0 / 111320e0 dy, 20e0 / 111320e0 / cos(radians(m[2])) dx FROM m), k AS (SELECT unnest([0, 1, 2, 3, 4]) corner, unnest([-1, 1, 1, -1, -1]) sx, unnest([-1, -1, 1, 1, -1]) sy)
SELECT id, corner, round(x + dx * sx, 7) x, round(y + dy * sy, 7) y FROM p, k""",
    "round_rings": f"""WITH m AS ({_MID}), p AS (SELECT id, m[1] x, m[2] y, 20e0 / 111320e0 dy, 20e0 / 111320e0 / cos(radians(m[2])) dx FROM m)
SELECT id, cast(corner AS int) corner, round(x + dx * cos(corner * pi() / 8), 8) x, round(y - dy * sin(corner * pi() / 8), 8) y FROM p, (SELECT unnest(range(17)) corner)""",
    "marker_positions": f"WITH m AS ({_MID}) SELECT id, l[1] lon, l[2] lat, m[1] upper_lon, m[2] upper_lat FROM m",
    "envelopes": f"SELECT DISTINCT id, {_ENV} FROM restrictions WHERE geometry IS NOT NULL",
    "extent": f"SELECT min(min_lon) min_lon, min(min_lat) min_lat, max(max_lon) max_lon, max(max_lat) max_lat FROM (SELECT {_ENV} FROM restrictions WHERE geometry IS NOT NULL) WHERE min_lon <> 0",
    "bent_routes": f"""WITH {_SEGS_ALL}, q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY seq) = 1), l AS (SELECT *, x2 - x1 dx, y2 - y1 dy, CASE WHEN sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) = 0 THEN 1e0 ELSE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) END ln FROM q)
SELECT route_id, cast(i AS int) seq, round(x1 + dx * i / 8e0 - dy / ln * 0.05e0 * sin(pi() * i / 8e0), 8) x, round(y1 + dy * i / 8e0 + dx / ln * 0.05e0 * sin(pi() * i / 8e0), 8) y FROM l, (SELECT unnest(range(9)) i)""",
    "polyline_roundtrip": f"WITH {_V} SELECT route_id, cast(row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS int) seq, floor(x * 1e6 + 0.5) / 1e6 lon, floor(y * 1e6 + 0.5) / 1e6 lat FROM v",
    "parse_heights": f"SELECT objectid, CASE WHEN reason IS NULL THEN n END value, reason FROM (SELECT *, {_H.format('gavrit_min')} reason FROM (SELECT DISTINCT objectid, gavrit_min, {_NUM.format(chr(114) + 'egexp_replace(trim(gavrit_min), ' + repr(',') + ', ' + repr('.') + ')')} n FROM bridge_features))",
    "month_starts": f"SELECT DISTINCT objectid, {_MONTH.format('d_update')} \"month\" FROM bridge_features",
    "stable_ids": f"SELECT DISTINCT objectid, {_SID.format('coalesce(bridge_code, cast(objectid AS varchar))', 'placement')} id FROM bridge_features",
    "import_records": f"{_IMPORT} SELECT objectid \"index\", CASE WHEN rn > 1 THEN base || '-' || objectid ELSE base END id, n height, {_MONTH.format('d_update')} observed FROM o WHERE skip_reason IS NULL",
    "import_skips": f"{_IMPORT} SELECT objectid \"index\", skip_reason, CASE WHEN skip_reason = 'unknown_height' THEN why END detail FROM o WHERE skip_reason IS NOT NULL",
    "import_warnings": f"""{_IMPORT}, m AS (SELECT *, {_NUM.format("regexp_replace(trim(gavrit_max), ',', '.')")} nm FROM o)
SELECT warning, min(objectid) first_index FROM (
  SELECT objectid, 'unrecognised Function value' warning FROM m WHERE function_code IS NOT NULL AND fn IS NULL AND k IS NOT NULL
  UNION ALL SELECT objectid, 'Gavrit_max below Gavrit_min' FROM m WHERE why IS NULL AND nm > 0 AND nm <= 50 AND nm <> 9999 AND nm < n
  UNION ALL SELECT objectid, 'repeated bridge key' FROM m WHERE base IS NOT NULL AND rn > 1
  UNION ALL SELECT objectid, 'no valid D_Update' FROM m WHERE skip_reason IS NULL AND ({_MONTH.format('d_update')}) IS NULL
  UNION ALL SELECT objectid, 'no CRS declared' FROM m WHERE crs_name IS NULL) GROUP BY ALL""",
    "feature_fields": """SELECT DISTINCT id, id feature_id, id property_id, 'Feature' kind, geometry.type geometry_type, CASE WHEN geometry.type = 'Point' THEN geometry.coordinates[1][1] END lon,
  CASE WHEN unit = 'boolean' THEN cast(value_boolean AS varchar) END flag, CASE WHEN coalesce(unit, '') <> 'boolean' THEN value_numeric END number, unit, source.name source_name,
  strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%gZ') observed_at, verified_by,
  cast((id IS NOT NULL)::int + (road_segment_id IS NOT NULL)::int + (value_source IS NOT NULL)::int + (direction IS NOT NULL)::int + (restriction_type IS NOT NULL)::int + (CASE WHEN coalesce(unit, '') = 'boolean' THEN value_boolean IS NOT NULL ELSE value_numeric IS NOT NULL END)::int
    + (unit IS NOT NULL)::int + (time_windows IS NOT NULL)::int + (status IS NOT NULL)::int + (source IS NOT NULL)::int + (observed_at IS NOT NULL)::int + (verified_by IS NOT NULL)::int + (verified_at IS NOT NULL)::int + (review_due_at IS NOT NULL)::int AS int) keys
FROM restrictions""",
    "import_stats": f"""{_IMPORT} SELECT count(*) features, count(*) FILTER (WHERE skip_reason IS NULL) records, count(skip_reason) skipped, count(*) FILTER (WHERE skip_reason = 'unknown_height') unknown_height,
 count(*) FILTER (WHERE skip_reason = 'not_over_road') not_over_road, count(*) FILTER (WHERE skip_reason = 'schema_invalid') invalid, count(*) FILTER (WHERE skip_reason IS NULL AND itm) itm_converted FROM o""",
    "osm_class_coverage": f"WITH {_ROADS} SELECT class, count(*) ways, count(raw) with_height FROM rd GROUP BY ALL",
    "osm_tag_counts": f"""WITH {_ROADS} SELECT kind, tag, count(*) n FROM (SELECT 'way' kind, unnest([CASE WHEN maxheight IS NOT NULL THEN 'maxheight' END, CASE WHEN maxheight_physical IS NOT NULL THEN 'maxheight:physical' END, CASE WHEN maxwidth IS NOT NULL THEN 'maxwidth' END, CASE WHEN hgv IS NOT NULL THEN 'hgv' END]) tag FROM rd
UNION ALL SELECT 'node', unnest([CASE WHEN maxheight IS NOT NULL THEN 'maxheight' END, CASE WHEN hgv IS NOT NULL THEN 'hgv' END]) FROM nd) WHERE tag IS NOT NULL GROUP BY ALL""",
    "osm_structures": f"WITH {_ROADS} SELECT structure, count(*) total, count(raw) with_height FROM (SELECT raw, unnest([CASE WHEN bridge <> 'no' THEN 'bridge' END, CASE WHEN tunnel <> 'no' THEN 'tunnel' END, CASE WHEN covered <> 'no' THEN 'covered' END]) structure FROM rd) WHERE structure IS NOT NULL GROUP BY ALL",
    "osm_regions": f"WITH {_ROADS} SELECT CASE WHEN {_odd('x1', 'y1', osm.GAZA)} THEN 'gaza' WHEN {_odd('x1', 'y1', osm.WEST_BANK)} THEN 'west_bank' ELSE 'israel' END region, count(*) ways, count(raw) with_height FROM rd GROUP BY ALL",
    "osm_units": f"WITH {_ROADS} SELECT unit, count(*) n FROM rd WHERE raw IS NOT NULL GROUP BY ALL",
    "osm_top_values": f"WITH {_ROADS} SELECT round_even(met, 1) AS \"value\", count(*) n FROM rd WHERE met IS NOT NULL GROUP BY ALL ORDER BY n DESC, \"value\" LIMIT 15",
    "osm_buckets": f"WITH {_ROADS} SELECT CASE WHEN met < 2 THEN '<2' WHEN met < 3 THEN '2-3' WHEN met < 4 THEN '3-4' WHEN met < 4.5 THEN '4-4.5' WHEN met < 5 THEN '4.5-5' WHEN met <= 7 THEN '5-7' ELSE '>7' END bucket, count(*) n FROM rd WHERE met IS NOT NULL GROUP BY ALL",
    "osm_odd_values": f"WITH {_ROADS} SELECT lower(trim(raw)) AS \"value\", count(*) n FROM rd WHERE raw IS NOT NULL AND unit = 'non-numeric' GROUP BY ALL ORDER BY n DESC, \"value\" LIMIT 15",
    "osm_newest": f"WITH {_WAYS} SELECT cast(max(ts) AS bigint) newest FROM (SELECT ts FROM w UNION ALL SELECT ts FROM nd)",
    "osm_bridges_by_kind": f"{_UNDER} SELECT kind, count(*) n FROM b WHERE kind IS NOT NULL GROUP BY ALL",
    "bridge_crossings": f"{_UNDER} SELECT bridge_id, road_id, kind, class, source, round(height, 4) height FROM uh",
    "underpass_totals": f"{_UNDER} SELECT count(*) underpasses, count(source) with_clearance, round(count(source) * 100.0e0 / nullif(count(*), 0), 1) percent FROM uh",
    "underpass_summary": f"{_UNDER} SELECT class, count(*) underpasses, count(*) FILTER (WHERE kind = 'road') under_road, count(*) FILTER (WHERE kind = 'rail') under_rail, count(source) with_clearance, round(count(source) * 100.0e0 / count(*), 1) percent FROM uh GROUP BY ALL",
    "clearance_counts": f"""{_UNDER} SELECT source, CASE WHEN height IS NULL THEN 'non-numeric' WHEN height < 2 THEN '<2.0 (suspect)' WHEN height > 7 THEN '>7.0 (suspect)' WHEN height < 3.5 THEN '2.0-3.5' WHEN height < 4 THEN '3.5-4.0' WHEN height < 4.5 THEN '4.0-4.5' WHEN height < 5 THEN '4.5-5.0' WHEN height < 5.5 THEN '5.0-5.5' ELSE '5.5-7.0' END bucket, count(*) n FROM uh WHERE source IS NOT NULL GROUP BY ALL""",
    "bridges_over_roads": f"{_UNDER} SELECT kind, count(DISTINCT bridge_id) bridges FROM uh GROUP BY ALL",
    "audit_stream": "SELECT strftime(occurred_at AT TIME ZONE 'UTC', '%Y-%m-%d') \"day\", event_type, count(*) n FROM (SELECT DISTINCT ON (id, occurred_at) * FROM restriction_events) GROUP BY ALL",
}
