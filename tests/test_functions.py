import math

import pytest
from pyspark.sql import functions as F

from gabarit.functions import geo, polyline, text, timewindows
from gabarit.functions.crs import itm_to_wgs84, with_wgs84


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_itm_control_points(spark):
    df = with_wgs84(spark.createDataFrame([(178000.0, 665000.0), (219529.584, 626907.39), (None, 1.0)], "x double, y double").withColumn("n", F.lit("clash")), "x", "y", "lon", "lat")
    got = [(r.lon, r.lat) for r in df.collect()]
    assert got[0] == pytest.approx((34.7653, 32.0775), abs=1e-3) and got[1] == pytest.approx((35.2052, 31.7348), abs=5e-4) and got[2][0] is None
    assert got[0] == pytest.approx(itm_to_wgs84(178000.0, 665000.0), abs=1e-12)


def test_distances(spark):
    row = [(35.0, 31.0, 35.0, 31.0, 35.01, 31.0)]
    d = values(spark, row, "a double, b double, c double, d double, e double, f double", geo.haversine_m(F.col("a"), F.col("b"), F.col("e"), F.col("f")), geo.point_segment_m(F.col("e"), F.col("f"), F.col("a"), F.col("b"), F.col("c"), F.col("d")))[0]
    assert d[0] == pytest.approx(953.15, abs=0.1) and d[1] == pytest.approx(d[0], rel=1e-3)


@pytest.mark.parametrize("p, q, want", [((0, 0, 2, 2), (0, 2, 2, 0), (1, 1)), ((0, 0, 1, 1), (0, 1, 1, 2), None), ((0, 0, 1, 0), (2, -1, 2, 1), None), ((0, 0, 1, 0), (1, 0, 1, 1), (1, 0))])
def test_crossing(spark, p, q, want):
    lits = lambda t: tuple(F.lit(float(v)) for v in t)
    got = spark.range(1).select(geo.crossing(lits(p), lits(q)).alias("c")).first().c
    assert (got and tuple(got)) == (want and pytest.approx(want))


def test_rings_and_lines(spark):
    x, y = F.lit(35.0), F.lit(31.0)
    r = spark.range(1).select(geo.square_ring(x, y, 20.0).alias("s"), geo.round_ring(x, y, 20.0).alias("r"), geo.capsule_ring(x, y, x + 0.01, y, 20.0).alias("c"), geo.bent_line(x, y, x + 1, y, 0.05).alias("b"), geo.ring_mean(geo.square_ring(x, y, 20.0)).alias("m")).first()
    assert len(r.s) == 5 and r.s[0] == r.s[4] and len(r.r) == 17 and r.r[0] == r.r[16] and r.c[0] == r.c[-1]
    assert len(r.b) == 41 and r.b[20].y == pytest.approx(31.05, abs=1e-6) and r.b[0].x == 35.0
    assert (r.m.x, r.m.y) == pytest.approx((35.0, 31.0))
    inside = spark.range(1).select(geo.in_ring(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)]), geo.in_ring(F.lit(3.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)])).first()
    assert tuple(inside) == (True, False)
    mid = spark.range(1).select(geo.middle(F.array(*[F.lit(k) for k in range(4)])), geo.middle(F.array(*[F.lit(k) for k in range(4)]), upper=False), geo.middle(F.array().cast("array<int>"))).first()
    assert tuple(mid) == (2, 1, None)


def test_polyline_vectors(spark):
    rows = [(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, ""), (3, "_p~iF~ps|"), (4, None), (5, "a b")]
    got = [(r.lat, r.lon) for r in polyline.decoded(spark.createDataFrame(rows, "k long, t string"), "k", "t", 5).orderBy("seq").collect()]
    assert got == [pytest.approx(p) for p in [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]]
    points = [(7, k, x, y) for k, (x, y) in enumerate([(-0.000001, 0.0), (34.781812, 32.085312), (-179.999999, -89.5), (0.0, 0.0)])]
    coded = polyline.encoded(spark.createDataFrame(points, "k long, seq int, lon double, lat double"), "k")
    assert [(r.lon, r.lat) for r in polyline.decoded(coded, "k", "polyline").orderBy("seq").collect()] == [pytest.approx((p[2], p[3]), abs=1e-9) for p in points]
    one = polyline.encoded(spark.createDataFrame([(1, 0, -120.2, 38.5)], "k long, seq int, lon double, lat double"), "k", precision=5).first().polyline
    assert one == "_p~iF~ps|U"


@pytest.mark.parametrize("raw, want", [("4.6", (4.6, None)), ("4,25", (4.25, None)), ("-1", (None, "sentinel_-1")), ("9999", (None, "sentinel_9999")), (" ", (None, "blank")), (None, (None, "blank")), ("n/a", (None, "non_numeric")), ("0", (None, "non_positive")), ("51", (None, "out_of_range_gt_50")), ("4.4,4.0", (None, "non_numeric")), ("4.5d", (None, "non_numeric")), ("NaN", (None, "non_numeric"))])
def test_import_heights(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "t string").select(text.height_or_reason(F.col("t")).alias("h")).first().h) == want


@pytest.mark.parametrize("raw, metres, unit", [("4.2", 4.2, "bare-number"), ("3,85 m", 3.85, "m"), ("13'6\"", 4.1148, "ft/in"), ("12'", 3.6576, "ft/in"), ("14 ft", 4.2672, "ft"), ("default", None, "non-numeric"), (" 4 ", 4.0, "bare-number"), ("4,5 ft", None, "non-numeric"), ("4.5'", None, "non-numeric"), ("12' 6 \"", 3.81, "ft/in"), ("12'6", None, "non-numeric"), ("4.", None, "non-numeric"), ("", None, "non-numeric"), (None, None, None)])
def test_tagged_heights(spark, raw, metres, unit):
    h = spark.createDataFrame([(raw,)], "t string").select(text.tagged_height(F.col("t")).alias("h")).first().h
    if raw is None:
        assert h is None
        return
    assert h.unit == unit and (h.metres is None if metres is None else h.metres == pytest.approx(metres))


def test_buckets_classes_layers(spark):
    heights = [None, 1.9, 2.0, 3.5, 5.5, 7.0, 7.1]
    assert [r[0] for r in values(spark, [(h,) for h in heights], "h double", text.clearance_bucket(F.col("h")))] == ["non-numeric", "<2.0 (suspect)", "2.0-3.5", "3.5-4.0", "5.5-7.0", "5.5-7.0", ">7.0 (suspect)"]
    classes = ["trunk_link", "service", None, "primary", "x_link"]
    assert [r[0] for r in values(spark, [(c,) for c in classes], "c string", text.road_class(F.col("c"), text.COVERAGE_CLASSES))] == ["trunk", "other", "other", "primary", "other"]
    layers = ["2.7", "-1.9", "x", None, "inf"]
    assert [r[0] for r in values(spark, [(v,) for v in layers], "v string", text.layer_of(F.col("v"), F.lit(1)))] == [2, -1, 1, 1, 1]


def test_small_formats(spark):
    assert [r[0] for r in values(spark, [(4.0,), (4.25,), (0.0005,), (None,)], "x double", text.number_text(F.col("x")))] == ["4", "4.25", "0.0005", None]
    assert [r[0] and r[0].strftime("%Y-%m") for r in values(spark, [("202405",), ("202405.0",), ("202413",), ("189912",), ("unk",), (None,)], "t string", text.month_start(F.col("t")))] == ["2024-05", "2024-05", None, None, None, None]
    props = spark.range(1).select(F.create_map(F.lit("gavrit_MIN"), F.lit(" "), F.lit("Min_Gavrit"), F.lit("4"))).alias("x").select(text.picked(F.col("`map(gavrit_MIN,  , Min_Gavrit, 4)`"), ["Gavrit_min", "Min_Gavrit"]))
    assert props.first()[0] == "4"


@pytest.mark.parametrize("raw, error", [("34,31,35,32", None), (" 34 , 31 ,35.5, 32", None), ("34,31,35", "four numbers expected"), (None, "four numbers expected"), ("34,,35,32", "not a number"), ("34,x,35,32", "not a number"), ("34,31,inf,32", "not a number"), ("34,31,190,32", "out of range"), ("35,31,34,32", "empty box"), ("34,31,34,32", "empty box")])
def test_boxes(spark, raw, error):
    assert spark.createDataFrame([(raw,)], "t string").select(text.bbox_parts(F.col("t")).alias("b")).first().b.error == error


def test_windows(spark):
    w = "struct<days:array<string>,start_time:string,end_time:string,valid_from:string,valid_until:string,note:string>"
    none = (None,) * 6
    cases = [
        (None, True), ([], True), ([none], True), ([(["mon"], None, None, None, None, None)], True), ([(["tue"], None, None, None, None, None)], False), ([(["tue", "x"], None, None, None, None, None)], True),
        ([(None, "11:00", "12:00", None, None, None)], False), ([(None, "12:00", "13:00", None, None, None)], True), ([(None, "22:00", "13:00", None, None, None)], True), ([(None, "12:00", "12:00", None, None, None)], False),
        ([(None, None, None, "2026-11-17", None, None)], False), ([(None, None, None, None, "2026-11-16", None)], True), ([(["tue"], None, None, None, None, None), none], True),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], f"w array<{w}>").select(timewindows.active(F.col("w"), F.to_timestamp(F.lit("2026-11-16 10:00:00"))).alias("a"))
    assert [r.a for r in df.collect()] == [want for _, want in cases]
    assert math.isfinite(1.0)
