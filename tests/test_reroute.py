"""The golden scenarios: each with its places, vehicle, one restriction on the way, and what must come of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gabarit.plans.reroute import mock, rerouted

PLACES = {"a": (34.78, 32.09), "b": (35.21, 31.77), "c": (34.79, 31.25), "d": (34.66, 31.80)}
REQUEST = "route_id long, at timestamp, profile_name string, height_m double, width_m double, length_m double, gross_weight_t double, axle_load_t double, hazmat boolean, x1 double, y1 double, x2 double, y2 double"
RECORD = "id string, restriction_type string, value_numeric double, value_boolean boolean, unit string, status string, time_windows array<struct<days:array<string>,start_time:string,end_time:string,valid_from:string,valid_until:string,note:string>>, coords array<struct<x:double,y:double>>"
HIGH, LOW, EVEN, TANKER, EMPTY = (4.5, 40.0, False), (3.9, 18.0, False), (4.0, 40.0, False), (3.8, 26.0, True), (3.8, 26.0, False)


def request(vehicle, start, end):
    h, w, hazmat = vehicle
    return (1, dt.datetime(2026, 11, 16, 10), "v", h, 2.5, 12.0, w, 10.0, hazmat, *PLACES[start], *PLACES[end])


def record(kind, value, status="unverified", start="a", end="b", at=0.5, k="r"):
    (x1, y1), (x2, y2) = PLACES[start], PLACES[end]
    flag = kind in ("truck_prohibited", "hazmat_restriction")
    return (k, kind, None if flag else float(value), value if flag else None, "boolean" if flag else "t" if "weight" in kind else "m", status, None, [(x1 + (x2 - x1) * at, y1 + (y2 - y1) * at)])


@pytest.mark.parametrize("vehicle, records, no_detour, want", [
    (HIGH, [], False, ("clear", 0, [], [], 0, 0)), (HIGH, [record("max_height", 4.2)], False, ("clear", 1, ["r"], [], 0, 0)), (LOW, [record("max_height", 4.2)], False, ("clear", 0, [], [], 0, 1)), (HIGH, [record("max_gross_weight", 20)], False, ("clear", 1, ["r"], [], 0, 0)),
    (LOW, [record("truck_prohibited", True)], False, ("clear", 1, ["r"], [], 0, 0)), (TANKER, [record("hazmat_restriction", True)], False, ("clear", 1, ["r"], [], 0, 0)), (EMPTY, [record("hazmat_restriction", True)], False, ("clear", 0, [], [], 0, 1)), (EVEN, [record("max_height", 4.0)], False, ("clear", 0, [], [], 0, 1)),
    (HIGH, [record("max_height", 5.0, "verified")], False, ("clear", 0, [], [], 1, 0)), (HIGH, [record("max_height", 3.5)], True, ("no_detour", 1, ["r"], ["r"], 0, 0)), (HIGH, [record("max_height", 3.5, at=0.0)], False, ("no_effect", 1, ["r"], ["r"], 0, 0)),
])
def test_scenarios(spark, vehicle, records, no_detour, want):
    r = rerouted(spark.createDataFrame([request(vehicle, "a", "b")], REQUEST), spark.createDataFrame(records, RECORD), mock(no_detour=no_detour)).collect()
    assert [tuple(x)[1:] for x in r] == [want]


def test_limit_and_no_route(spark):
    """A provider whose every route meets another restriction, and one without routes."""
    places = [(34.5 + k, 31.0) for k in range(6)]
    records = [(f"r{k}", "max_height", 3.0, None, "m", "unverified", None, [p]) for k, p in enumerate(places)]
    calls = []

    def moving(requests):
        calls.append(1)
        return requests.select("route_id", F.array(F.struct((F.lit(34.5) + F.size("excluded")).alias("x"), F.lit(31.0).alias("y"))).alias("coords"))

    req = spark.createDataFrame([request(HIGH, "a", "b")], REQUEST)
    r = rerouted(req, spark.createDataFrame(records, RECORD), moving).first()
    assert (r.outcome, r.reroutes, r.avoided, r.conflicts, len(calls)) == ("limit", 3, ["r0", "r1", "r2"], ["r3"], 4)
    r = rerouted(req, spark.createDataFrame(records, RECORD), lambda q: q.select("route_id", F.lit(None).cast("array<struct<x:double,y:double>>").alias("coords")).limit(0)).first()
    assert r.outcome == "no_route"
    assert rerouted(req.limit(0), spark.createDataFrame([], RECORD), mock()).count() == 0


def test_inputs_are_derived_once(spark):
    """However many passes there are, requests and restrictions come from their sources once."""
    asked, held = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(df, schema, n):
        def one(parts):
            for r in parts:
                n.add(1)
                yield r

        return spark.createDataFrame(df.rdd.mapPartitions(one), schema)

    req = counted(spark.createDataFrame([request(HIGH, "a", "b")], REQUEST), REQUEST, asked)
    records = counted(spark.createDataFrame([record("max_height", 3.5, at=0.0)], RECORD), RECORD, held)
    assert [(r.outcome, r.reroutes) for r in rerouted(req, records, mock()).collect()] == [("no_effect", 1)]
    assert (asked.value, held.value) == (1, 1)
