import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gabarit.operators import bridges, lines, osm, rules, store
from gabarit.sources.geojson import read_features
from gabarit.sources.osm_pbf import located_ways, read_pbf

XY = "array<struct<x:double,y:double>>"


def test_corridor(spark):
    routes = spark.createDataFrame([(1, [(35.0, 31.0), (35.1, 31.0)]), (2, [(35.05, 31.0)]), (3, []), (4, None)], f"route_id long, coords {XY}")
    things = [("on", [(35.05, 31.0)]), ("near", [(35.02, 31.0004)]), ("off", [(35.02, 31.001)]), ("across", [(35.03, 30.9), (35.03, 31.1)]), ("none", None), ("end", [(35.1004, 31.0)])]
    got = {(r.route_id, r.id) for r in lines.corridor(routes, spark.createDataFrame(things, f"id string, coords {XY}")).collect()}
    assert got == {(1, "on"), (1, "near"), (1, "across"), (1, "end"), (2, "on")}
    plan = lines.corridor(routes, spark.createDataFrame(things, f"id string, coords {XY}"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_length_and_fraction(spark):
    routes = spark.createDataFrame([(1, [(35.0, 31.0), (35.0, 31.1), (35.0, 31.2)]), (2, [(35.0, 31.0)])], f"route_id long, coords {XY}")
    assert {r.route_id: r.length_m for r in lines.lengths(routes).collect()} == {1: pytest.approx(22239.0, abs=1), 2: 0.0}
    assert {r.route_id: (r.lon, r.lat) for r in lines.at_fraction(routes, 0.75).collect()} == {1: pytest.approx((35.0, 31.15)), 2: (35.0, 31.0)}


def way(k, coords, nodes=None, **tags):
    return (k, 0, {t.replace("_x", ":physical"): v for t, v in tags.items()}, nodes or [10 * k + i for i in range(len(coords))], coords)


WAY = f"way_id long, ts long, tags map<string,string>, nodes array<bigint>, coords {XY}"
NODE = "node_id long, tags map<string,string>, lon double, lat double, ts long"


def test_underpasses(spark):
    ways = [
        way(1, [(35.0, 31.0), (35.002, 31.0)], bridge="yes", highway="primary"), way(2, [(35.001, 30.999), (35.001, 31.001)], highway="residential", maxheight="4.2"),
        way(3, [(35.0005, 30.999), (35.0005, 31.001)], highway="service"), way(4, [(35.0015, 30.999), (35.0015, 31.001)], highway="primary_link", layer="1"), way(5, [(35.0012, 30.999), (35.0, 31.0)], [50, 10], highway="track"),
        way(6, [(35.0007, 30.999), (35.0007, 31.001)], highway="footway"), way(7, [(35.0008, 30.999), (35.0008, 31.001)], highway="trunk", tunnel="yes"), way(8, [(35.0, 31.0005), (35.002, 31.0005)], railway="rail", bridge="yes"),
        way(9, [(35.0001, 31.0), (None, 31.0)], highway="trunk"), way(10, [(35.0, 31.0001)], highway="trunk"), way(11, [(35.0, 31.0007), (35.002, 31.0007)], railway="rail", bridge="viaduct"),
    ]
    nodes = [(31, {"maxheight": "3.9"}, 35.0005, 31.0001, 5), (30, {"maxheight": "9"}, 35.0005, 30.999, 9)]
    u = osm.underpasses(spark.createDataFrame(ways, WAY), spark.createDataFrame(nodes, NODE))
    got = {(r.bridge_id, r.road_id): (r.kind, r["class"], r.source, r.height) for r in u.collect()}
    assert got == {
        (1, 2): ("road", "residential", "way_tag", 4.2), (1, 3): ("road", "service", "node_within_30m", 3.9), (8, 2): ("rail", "residential", "way_tag", 4.2), (8, 3): ("rail", "service", None, None),
    }
    assert osm.newest(spark.createDataFrame(ways, WAY), spark.createDataFrame(nodes, NODE)).first()[0] == 9
    empty = osm.underpasses(spark.createDataFrame([], WAY), spark.createDataFrame([], NODE))
    assert empty.count() == 0 and osm.underpass_classes(empty).count() == 0


def test_rules(spark):
    ok = dict(id="a", road_segment_id="s", geometry=("Point", [[35.0, 31.0]]), value_source="posted_sign", direction="both", restriction_type="max_height", value_numeric=4.2, value_boolean=None, unit="m", time_windows=None, status="verified", source=("n", "r", None, None), observed_at="2024-01-01", verified_by="v", verified_at="2024-01-01")
    bad = [
        ({}, set(), set()), ({"status": "verified", "verified_by": None}, {"verified"}, {"verified"}), ({"unit": "t"}, {"dimension"}, {"dimension"}), ({"value_numeric": 60.0}, {"dimension"}, {"dimension"}),
        ({"restriction_type": "max_axle_weight", "value_boolean": True, "value_numeric": None, "unit": "boolean"}, {"weight"}, {"weight"}), ({"direction": "up"}, {"direction"}, {"direction"}), ({"geometry": ("Polygon", [[1.0, 2.0]])}, {"geometry_type"}, {"geometry"}),
        ({"value_source": None}, {"dimension"}, {"dimension"}), ({"source": ("n", "r", "no uri", None)}, set(), {"source.url"}), ({"time_windows": [(["mon"], "07:00", None, None, None, None)]}, set(), {"timeWindows"}), ({"restriction_type": "truck_prohibited"}, {"ban"}, {"ban"}),
    ]
    schema = "id string, road_segment_id string, geometry struct<type:string,coordinates:array<array<double>>>, value_source string, direction string, restriction_type string, value_numeric double, value_boolean boolean, unit string, time_windows array<struct<days:array<string>,start_time:string,end_time:string,valid_from:string,valid_until:string,note:string>>, status string, source struct<name:string,reference:string,url:string,license:string>, observed_at string, verified_by string, verified_at string"
    df = spark.createDataFrame([tuple((ok | change).values()) for change, _, _ in bad], schema).withColumn("n", F.monotonically_increasing_id())
    checks = [set(r.violations) for r in rules.with_violations(df, rules.check_rules()).orderBy("n").collect()]
    contract = [set(r.violations) for r in rules.with_violations(df, rules.schema_rules()).orderBy("n").collect()]
    assert checks == [c for _, c, _ in bad] and contract == [s for _, _, s in bad]


@pytest.mark.parametrize("kind, limit, actual, banned, hazmat, want", [
    ("max_height", 3.5, 4.0, None, False, "heightM 4 > limit 3.5 m"), ("max_height", 4.0, 4.0, None, False, None), ("max_axle_weight", 20.0, None, None, False, "axleLoadT not given; limit 20 m"), ("max_height", None, 4.0, None, False, None),
    ("truck_prohibited", None, None, True, False, "trucks prohibited"), ("truck_prohibited", None, None, False, False, None), ("hazmat_restriction", None, None, True, True, "hazmat prohibited and vehicle carries hazmat"), ("hazmat_restriction", None, None, True, False, None), ("other", 1.0, 2.0, True, True, None),
])
def test_reasons(spark, kind, limit, actual, banned, hazmat, want):
    df = spark.createDataFrame([(kind, limit, actual, banned, hazmat)], "k string, l double, a double, b boolean, h boolean")
    assert df.select(rules.reason(F.col("l"), F.lit("m"), F.col("a"), F.col("k"), F.col("b"), F.col("h"))).first()[0] == want


def test_import_of_a_collection(spark, tmp_path):
    def feature(coords=(178000, 665000), kind="Point", **props):
        return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}

    features = [
        feature(OBJECTID=1, ID="B/1", NAME="One", Placement="1R", Function=1, Gavrit_min="4.6", D_Update="202405"), feature(OBJECTID=2, ID=" ", Function="", Min_Gavrit="4,25", D_Update="x"), feature(OBJECTID=3, Function=4, Gavrit_min=4),
        feature(Gavrit_min=4), feature(OBJECTID=5, Gavrit_min=-1), feature(OBJECTID=6, Gavrit_min="n/a"), feature(coords=(999999, 999999), OBJECTID=7, Gavrit_min=4), feature(OBJECTID=1, ID="B/1", Placement="1R", Gavrit_min="5", Gavrit_max="4"),
        feature(coords=[[178000, 665000], [178100, 665000], [178200, 665000]], kind="LineString", OBJECTID=9, Gavrit_min=5, Function=9), feature(coords=[], kind="Other", OBJECTID=10, Gavrit_min=5),
    ]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::2039"}}, "features": features}))
    rows = bridges.imported(read_features(spark, str(path)))
    got = {r["index"]: r for r in rows.collect()}
    assert [got[k].skip_reason for k in range(10)] == [None, None, "not_over_road", "missing_id", "unknown_height", "unknown_height", None, None, None, "invalid_geometry"]
    assert (got[4].detail, got[5].detail) == ("sentinel_-1", "non_numeric")
    assert got[0].height == 4.6 and got[1].height == 4.25 and got[1].key == "2" and got[0].lon == pytest.approx(34.7653, abs=1e-3)
    assert got[7].id == f"{got[0].id}-7" and got[0].id.startswith("mot-bridge-B_1-1R-maxheight-") and got[8].lon == pytest.approx(34.7664, abs=1e-3)
    s = bridges.import_stats(rows).first()
    assert (s.features, s.records, s.skipped, s.unknown_height, s.not_over_road) == (10, 5, 5, 2, 1)
    assert {r.warning for r in bridges.import_warnings(rows).collect()} == {"repeated bridge key", "no valid D_Update", "Gavrit_max below Gavrit_min", "unrecognised Function value"}
    (tmp_path / "bad.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        read_features(spark, str(tmp_path / "bad.geojson")).collect()


def _v(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _f(k, v):
    return _v(k << 3) + _v(v) if isinstance(v, int) else _v(k << 3 | 2) + _v(len(v)) + v


def _z(values):
    out, last = b"", 0
    for v in values:
        out += _v((v - last) * 2 if v >= last else (last - v) * 2 - 1)
        last = v
    return out


def test_extract(spark, tmp_path):
    strings = [b"", b"maxheight", b"4.2", b"highway", b"primary"]
    dense = _f(1, _z([100, 101])) + _f(8, _z([310000000, 310010000])) + _f(9, _z([350000000, 350000000])) + _f(10, bytes([1, 2, 0, 0])) + _f(5, _f(2, _z([1700000000, 1700000001])))
    wayb = _f(1, 7) + _f(2, bytes([3])) + _f(3, bytes([4])) + _f(4, _f(2, 1700000005)) + _f(8, _z([100, 101, 999]))
    body = _f(1, b"".join(_f(1, s) for s in strings)) + _f(2, _f(2, dense)) + _f(2, _f(3, wayb))
    with open(tmp_path / "x.osm.pbf", "wb") as f:
        for kind, blob in ((b"OSMHeader", _f(1, b"")), (b"OSMData", _f(2, len(body)) + _f(3, zlib.compress(body)))):
            head = _f(1, kind) + _f(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)
    nodes, ways = read_pbf(spark, [str(tmp_path / "x.osm.pbf")])
    assert [(r.node_id, r.ts, r.tags, round(r.lon, 7), round(r.lat, 7)) for r in nodes.orderBy("node_id").collect()] == [(100, 1700000000, {"maxheight": "4.2"}, 35.0, 31.0), (101, 1700000001, {}, 35.0, 31.001)]
    w = located_ways(nodes, ways).first()
    assert (w.way_id, w.ts, w.tags, w.nodes) == (7, 1700000005, {"highway": "primary"}, [100, 101, 999])
    assert [c.x and round(c.x, 6) for c in w.coords] == [35.0, 35.0, None]


def test_store(spark):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "id string, v double, s string")
    cmd = spark.createDataFrame([("a", "upsert", "me", 9.0, "new"), ("c", "upsert", None, 3.0, "z"), ("b", "delete", "me", None, None), ("q", "delete", "me", None, None)], "id string, op string, actor string, v double, s string")
    up = store.upserted(base, cmd.filter("op = 'upsert'"), "id", ["v"])
    assert {tuple(r) for r in store.without(up, cmd.filter("op = 'delete'"), "id").collect()} == {("a", 9.0, "x"), ("c", 3.0, "z")}
    events = [(r.restriction_id, r.event_type, r.old_row is not None, r.new_row is not None, r.actor) for r in store.audit_events(base, cmd, "id", ["id", "v", "s"]).collect()]
    assert sorted(events, key=str) == sorted([("a", "insert", False, True, "me"), ("a", "update", True, True, "me"), ("c", "insert", False, True, None), ("b", "delete", True, False, "me")], key=str)


def test_stream_appends_each_batch_once(spark, tmp_path):
    from gabarit.streaming.audit import EVENTS, append_audit, event_stream

    src, rows = tmp_path / "in", [(1, "a", "insert", None, "{}", None, None), (2, "a", "update", "{}", "{}", "me", None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(src))
    for _ in range(2):
        append_audit(event_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(3, "b", "delete", "{}", None, None, None)], EVENTS).write.mode("append").parquet(str(src))
    append_audit(event_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_features_keep_the_kind_of_their_value(spark):
    schema = "id string, road_segment_id string, geometry struct<type:string,coordinates:array<array<double>>>, value_source string, direction string, restriction_type string, value_numeric double, value_boolean boolean, unit string, time_windows array<string>, status string, source struct<name:string>, observed_at timestamp, verified_by string, verified_at timestamp, review_due_at timestamp"
    row = lambda k, geometry, n, b, unit: (k, "s", geometry, None, None, "t", n, b, unit, None, "verified", ("n",), None, None, None, None)
    rows = [row("a", ("Point", [[35.0, 31.0]]), 4.25, None, "m"), row("b", ("LineString", [[35.0, 31.0], [35.1, 31.0]]), None, True, "boolean"), row('q"', None, None, None, None)]
    got = [json.loads(r.feature) for r in store.features(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [35.0, 31.0]}, "properties": {"id": "a", "roadSegmentId": "s", "restrictionType": "t", "value": 4.25, "unit": "m", "status": "verified", "source": {"name": "n"}}}
    assert got[1]["properties"]["value"] is True and got[1]["geometry"]["coordinates"][1] == [35.1, 31.0]
    assert got[2]["geometry"] is None and got[2]["id"] == 'q"' and "value" not in got[2]["properties"]


def test_an_import_that_breaks_the_record_schema(spark):
    rows = [(1, {"OBJECTID": "1", "Gavrit_min": "4.5"}, 35.0, 31.0, "x"), (2, {"OBJECTID": "2", "Gavrit_min": "4.5"}, 178000.0, 665000.0, "EPSG:4326")]
    df = spark.createDataFrame(rows, "index long, props map<string,string>, px double, py double, crs string")
    assert [r.skip_reason for r in bridges.imported(df).orderBy("index").collect()] == [None, "invalid_geometry"]
    assert [r.skip_reason for r in bridges.imported(df, crs="EPSG:2039").orderBy("index").collect()] == [None, None]  # the override goes before what is declared
    bad = bridges.imported(df, licence="").orderBy("index")
    assert [(r.skip_reason, r.detail) for r in bad.collect()] == [("schema_invalid", "source.license"), ("invalid_geometry", None)]
    s = bridges.import_stats(bad).first()
    assert (s.records, s.skipped, s.invalid) == (0, 2, 1)


def test_a_written_store_is_pruned_by_its_boxes(spark, tmp_path):
    rows = [(f"r{k}", ("Point", [[34.0 + k / 100, 31.0]])) for k in range(100)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, geometry struct<type:string,coordinates:array<array<double>>>")
    store.write_store(df, str(tmp_path / "store"), files=5)
    kept = store.in_box(spark.read.parquet(str(tmp_path / "store")), 34.2, 30.0, 34.4, 32.0)
    assert {r.id for r in kept.collect()} == {r.id for r in store.in_box(df, 34.2, 30.0, 34.4, 32.0).collect()} == {f"r{k}" for k in range(20, 41)}
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as said:
        kept.explain("formatted")
    assert "GreaterThanOrEqual(max_lon,34.2)" in said.getvalue()


def test_written_tables_are_released(spark):
    from gabarit.session import materialize, release

    release(spark)
    path = materialize(spark.range(3)).inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(path) and release(spark) == 1 and not os.path.isdir(path)


def test_underpasses_are_counted_without_a_row_for_each(spark):
    """Many ways of one course: counts are those of the rows, pairs that share a node left out, and no written table has a row for each pair."""
    from gabarit import session

    east, north = [(35.0, 31.0), (35.002, 31.0)], [(35.001, 30.999), (35.001, 31.001)]
    ways = [way(k, east, highway="primary", bridge="yes") for k in range(30)] + [way(k, north, highway="service", maxheight="4.2" if k % 2 else "none") for k in range(100, 140)]
    ways += [way(200, north, [2000, 0], highway="track"), way(201, north, [2010, 2011], highway="track"), way(300, [(35.0, 31.0002), (35.002, 31.0002)], [2000, 2001], railway="rail", bridge="yes")]
    w, n = spark.createDataFrame(ways, WAY), spark.createDataFrame([(2010, {"maxheight": "3.9"}, 35.001, 31.0, 1)], NODE)
    session.release(spark)
    counts = osm.underpass_counts(w, n)
    got = {tuple(r)[:4]: r.n for r in counts.collect()}
    assert got == {
        ("road", "service", "way_tag", 4.2): 600, ("road", "service", "way_tag", None): 600, ("rail", "service", "way_tag", 4.2): 20, ("rail", "service", "way_tag", None): 20,
        ("road", "track", None, None): 29, ("road", "track", "node_within_30m", 3.9): 30, ("rail", "track", "node_within_30m", 3.9): 1,
    }
    assert max(spark.read.parquet(p).count() for p in session._WRITTEN) <= len(ways)
    rows = osm.underpasses(w, n)
    for f in (osm.underpass_totals, osm.underpass_classes, osm.clearance_counts):
        assert sorted(map(str, f(counts).collect())) == sorted(map(str, f(rows).collect()))
    assert {tuple(r) for r in osm.bridges_over_roads(osm.crossed_bridges(w)).collect()} == {tuple(r) for r in osm.bridges_over_roads(rows).collect()} == {("road", 30), ("rail", 1)}


def test_routes_of_one_shape_meet_things_once(spark):
    """Each route has its pairs, but only one of each shape is cut into cells."""
    line = [(35.0, 31.0), (35.1, 31.0)]
    routes = spark.createDataFrame([(k, line) for k in range(50)] + [(50, line[::-1]), (51, [(36.0, 31.0)]), (52, None)], f"route_id long, coords {XY}")
    things = spark.createDataFrame([("on", [(35.05, 31.0)]), ("off", [(35.05, 31.1)])], f"id string, coords {XY}")
    got = [tuple(r) for r in lines.corridor(routes, things).select("route_id", "id").collect()]
    assert sorted(got) == [(k, "on") for k in range(51)]
    shaped = lines.by_shape(routes)
    assert shaped.count() == 52 and sorted(r.route_id for r in shaped.filter("coords IS NOT NULL").collect()) == [0, 50, 51]
    assert lines.near_shapes(shaped, things).count() == 2
