import pytest
from pyspark.sql import functions as F

from gabarit.operators.units import converted, learned_units, plain_number, stated

COLUMNS = "load_row_id long, record_id string, restriction_type string, value_raw string, unit_raw string, remark string"


def one(spark, *rows):
    df = spark.createDataFrame([(k, None, *r) for k, r in enumerate(rows)], COLUMNS)
    return {r.load_row_id: (r.std_unit, r.std_value, r.unit) for r in converted(df).collect()}


def test_numbers(spark):
    texts = ["4", "4,5", "12,500", "1,234,567", "12 500", "12 500", "12 500", "4.5", "x", "1,2345"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(plain_number(F.col("t")).cast("double")).collect()]
    assert got == [4.0, 4.5, 12500.0, 1234567.0, 12500.0, 12500.0, 12500.0, 4.5, None, 1.2345]


@pytest.mark.parametrize("row, want", [
    (("max_height", "14 ft 6 in", "", None), ("mm", 4420, "in")), (("max_height", "14'6\"", None, None), ("mm", 4420, "in")), (("max_height", "14’-6”", "m", None), ("mm", 4420, "in")), (("max_height", "14 feet 6 inches", "-", None), ("mm", 4420, "in")),
    (("max_height", "450", "c.m.", None), ("mm", 4500, "cm")), (("max_height", "450cm", "m", "figures are feet"), ("mm", 4500, "cm")), (("max_height", "425", None, "dims in cm"), ("mm", 4250, "cm")), (("max_width", "2 500", "", "drawing 1:50, millimetres"), ("mm", 2500, "mm")),
    (("max_gross_weight", "12,500", "LBS", None), ("kg", 5670, "lb")), (("max_axle_weight", "10.5 US tons", None, None), ("kg", 9525, "short ton")), (("max_gross_weight", "8", "t", None), ("kg", 8000, "t")), (("max_height", "4,2", None, "tape 30 m used"), ("mm", 4200, "m")), (("max_height", "4.2", None, None), ("mm", 4200, "m")),
])
def test_stated_units(spark, row, want):
    assert one(spark, row) == {0: want}


def test_no_quantity(spark):
    assert one(spark, ("max_height", None, "cm", None), ("max_height", "", "cm", None), ("max_height", "n/a", "cm", None), ("max_height", "-1", "m", None), ("truck_prohibited", "4", "m", None), (None, "4", "m", None), ("max_height", "9" * 100_000, "cm", None)) == {}
    assert converted(spark.createDataFrame([], COLUMNS)).count() == 0


def test_half_up_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", "max_height", "0.0005", "m", None)] * 2, COLUMNS).withColumn("unit", F.lit("clash")).withColumn("number", F.lit(1))
    assert [r.std_value for r in converted(df).collect()] == [1, 1]


def test_an_unknown_label_is_learned_from_linked_records(spark):
    rows = []
    for k in range(40):
        metres = 3 + k * 0.05
        rows += [(3 * k, f"R{k}", "max_height", f"{metres:.2f}", "m", None), (3 * k + 1, f"R{k}", "max_height", f"{metres / 0.3048:.1f}", "tz", None), (3 * k + 2, f"R{k}", "max_height", f"{metres:.2f}", None, "far side")]
    rows.append((999, None, "max_height", "10", "tz", None))
    df = spark.createDataFrame(rows, COLUMNS)
    from gabarit.session import materialize

    units = {(r.slot, r.token): r.unit for r in learned_units(df, materialize(stated(df))).collect()}
    assert units["unit", "tz"] == "ft" and units["remark", "far side"] == "m"
    assert [r.std_value for r in converted(df).filter("load_row_id = 999").collect()] == [3048]


def mislabelled():
    """Records in metres, with deliveries whose label lies (their "mm" are centimetres), is unknown ("tz": feet) or is right ("cm")."""
    rows = []
    for k in range(40):
        metres = 3 + k * 0.05
        texts = [(f"{metres:.2f}", "m"), (f"{metres * 100:.0f}", "mm"), (f"{metres / 0.3048:.2f}", "tz"), (f"{metres * 100:.0f}", "cm")]
        rows += [(4 * k + i, f"R{k}", "max_height", v, u, None) for i, (v, u) in enumerate(texts)]
    return [*rows, (900, None, "max_height", "512", "mm", None), (901, None, "max_height", "10", "tz", None), (902, None, "max_height", "10 tz", None, None), (903, None, "max_height", "10", "qq", None)]


def test_links_hold_against_labels(spark, monkeypatch):
    from gabarit.operators import units

    df = spark.createDataFrame(mislabelled(), COLUMNS)
    of = lambda: {r.load_row_id: (r.std_value, r.unit) for r in converted(df).filter("load_row_id >= 900").collect()}
    # 902: the same letters in the value; 903: no links, no known word
    assert of() == {900: (5120, "cm"), 901: (3048, "ft"), 902: (3048, "ft"), 903: (None, None)}
    monkeypatch.setattr(units, "MIN_LINKS", 10**9)  # nothing learned: the words alone
    assert of() == {900: (512, "mm"), 901: (None, None), 902: (None, None), 903: (None, None)}


def test_units_pass_through_the_graph_and_offsets_are_no_units(spark):
    rows = []
    for k in range(30):
        metres = 3 + k * 0.05
        rows += [(10 * k, f"A{k}", "max_height", f"{metres:.3f}", "m", None), (10 * k + 1, f"A{k}", "max_height", f"{metres / 0.9144:.3f}", "ell", None)]
        # entities without metres: only by way of "ell"
        rows += [(10 * k + 2, f"B{k}", "max_height", f"{metres / 0.9144:.3f}", "ell", None), (10 * k + 3, f"B{k}", "max_height", f"{metres / 0.0254:.1f}", "nail", None)]
        rows += [(10 * k + 4, f"C{k}", "max_height", f"{metres / 0.0254:.1f}", "nail", None), (10 * k + 5, f"C{k}", "max_height", f"{metres * 1000:.0f}", "line", None)]
        rows += [(10 * k + 6, f"A{k}", "max_height", f"{metres + 1.5:.3f}", "gauge", None)]  # metres above another level
    from gabarit.session import materialize

    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.token: r.unit for r in learned_units(df, materialize(stated(df))).collect()}
    assert got == {"m": "m", "ell": "yd", "nail": "in", "line": "mm", "gauge": None}
