import json

from pyspark.sql import functions as F

from gabarit.plans.requests import places, profile_from_form, request_errors, router_body

FORM = "profile_name string, height_m string, width_m string, length_m string, gross_weight_t string, axle_load_t string"
REQUEST = "`from` array<double>, `to` array<double>, profile_name string, height_m double, width_m double, length_m double, gross_weight_t double, axle_load_t double, hazmat struct<adr_classes:array<string>>"


def test_form(spark):
    r = profile_from_form(spark.createDataFrame([(" Rig ", " 4,1 ", "2.5", "x", "", None)], FORM)).first()
    assert (r.profile_name, r.height_m, r.width_m, r.length_m, r.gross_weight_t, r.axle_load_t, r.form_errors) == ("Rig", 4.1, 2.5, None, None, None, ["length_m"])


def test_errors_and_body(spark):
    ok = ([34.8, 32.1], [35.2, 31.8], "Rig", 4.0, 2.5, 12.0, 26.0, None, None)
    rows = [ok, ([34.8], [200.0, 1.0], None, 38.0, 2.5, 12.0, None, 50.0, (["10"],)), (None, [35.2, 31.8, 7.0], "Rig", 4.0, 2.5, 12.0, 26.0, 10.0, (["3", "8"],))]
    df = request_errors(spark.createDataFrame(rows, REQUEST))
    assert [r.errors for r in df.collect()] == [[], ["from", "to", "vehicle.profile_name", "vehicle.height_m", "vehicle.gross_weight_t", "vehicle.axle_load_t", "vehicle.hazmat"], ["from", "to"]]
    bodies = [json.loads(r[0]) for r in df.select(router_body(df)).collect()]
    assert bodies[0] == {"locations": [{"lon": 34.8, "lat": 32.1}, {"lon": 35.2, "lat": 31.8}], "costing": "truck", "costing_options": {"truck": {"height": 4.0, "width": 2.5, "length": 12.0, "weight": 26.0}}, "units": "kilometers", "language": "en-US"}
    assert bodies[2]["costing_options"]["truck"]["hazmat"] is True


def test_places(spark):
    texts = ["34.8,32.1", " 34.8 , 32.1 ", "34.8", "34.8,95", "a,b", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(places(F.col("t"))).collect()]
    assert got == [[34.8, 32.1], [34.8, 32.1], None, None, None, None, None]


def test_a_text_that_is_no_number_breaks_its_rule(spark):
    form = profile_from_form(spark.createDataFrame([("Rig", "4,1", "2.5", "12", "26", "ten")], FORM))
    df = request_errors(form.selectExpr("*", "array(34.8D, 32.1D) AS `from`", "array(35.2D, 31.8D) AS `to`", "CAST(NULL AS struct<adr_classes:array<string>>) AS hazmat"))
    assert df.first().errors == ["vehicle.axle_load_t"]
