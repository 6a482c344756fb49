import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from gabarit.operators.profile import INSTANT_EXPRESSION as profile_instant
from gabarit.operators.profile import NUMBER_EXPRESSION as profile_number
from gabarit.operators.profile import coverage_changes, expression_coverage, induce_expressions, load_findings, load_profile, profile_columns, readable_instant, readable_number, shape_counts, value_counts

COLUMNS = "load_id long, feed_name string, load_no int, restriction_type string, value_raw string, review_due_at_raw string"


def make(rng, load, feed, no, n, shift=1.0, nulls=0.05):
    rows = []
    for _ in range(n):
        v = rng.choice([f"{rng.randint(20, 60) * shift / 10}", f" {rng.randint(2, 6)},5 ", "n/a", "9999", "4.2 m"])
        rows.append((load, feed, no, rng.choice(["max_height", "max_width", "max_gross_weight"]), None if rng.random() < nulls else v, rng.choice([f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T00:00:00Z", "2022-02-30T00:00:00Z", "", None])))
    return rows


def test_readable_forms(spark):
    texts = ["4", "4.5", "4,50", "-4", "4.", "4.5 m", "", "1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(readable_number(F.col("t")))
    assert [r[0] for r in df.collect()] == [4.0, 4.5, 4.5, None, None, None, None, None]
    stamps = ["2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "2024-01-01", "1970-01-02T00:00:01Z"]
    df = spark.createDataFrame([(t,) for t in stamps], "t string").select(readable_instant(F.col("t")))
    assert [r[0] for r in df.collect()] == [1709251199, None, None, None, None, 86401]


def test_medians_and_counts_against_brute_force(spark):
    rng = random.Random(3)
    rows = make(rng, 1, "a", 1, 301) + make(rng, 2, "a", 2, 300, 3.0) + make(rng, 3, "a", 4, 150, nulls=0.9)
    rows += rows[:40]  # repeated rows count as rows
    got = {(r.load_id, r.column_name): r for r in load_profile(spark.createDataFrame(rows, COLUMNS)).collect()}
    for load in (1, 2, 3):
        mine = [r for r in rows if r[0] == load]
        texts = [r[4].strip() for r in mine if r[4] and r[4].strip()]
        nums = [float(r[4].strip().replace(",", ".")) for r in mine if r[3] == "max_height" and r[4] and r[4].strip().replace(",", ".").replace(".", "", 1).isdigit()]
        p = got[load, "value_raw"]
        assert (p.rows, p.filled, p.distincts) == (len(mine), len(texts), len(set(texts)))
        assert p.top == max(texts.count(t) for t in set(texts))
        assert p.median == pytest.approx(median(nums))
    assert got[1, "value_raw"].rows_before is None and got[3, "value_raw"].rows_before == got[2, "value_raw"].rows


def test_findings(spark):
    rng = random.Random(5)
    rows = make(rng, 1, "a", 1, 200) + make(rng, 2, "a", 2, 200, 4.0) + make(rng, 3, "a", 3, 200, 4.0, nulls=0.8) + make(rng, 9, "b", 1, 50)
    found = {tuple(r) for r in load_findings(load_profile(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert (3, "value_raw", "null_share") in found
    assert not any(f[0] in (1, 9) for f in found)


def test_degenerate_input(spark):
    assert load_findings(load_profile(spark.createDataFrame([], COLUMNS))).count() == 0
    rows = [(1, "a", 1, None, None, None), (2, "a", 2, None, "x" * 100_000, ""), (None, "a", 3, "max_height", "4", "x"), (4, None, None, "max_height", "4", None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("rows", F.lit(1)).withColumn("text", F.lit("clash"))
    profile = load_profile(df)
    assert profile.count() == 6
    assert load_findings(profile).count() == 1  # value_raw: null_share


def test_expressions_choose_the_shorter_description(spark):
    rows = [(1, "a", 1, "max_height", f"{k // 100}.{k % 100:02d}", None) for k in range(200, 700)] + [(1, "a", 1, "max_height", t, None) for t in ("see sign", "n/a", "12345678", "3 m", "4 m", "5 m")]
    shapes = shape_counts(value_counts(spark.createDataFrame(rows, COLUMNS)))
    e = {r["shape"]: r for r in induce_expressions(shapes).collect()}
    assert e["9.99"]["expression"] == r"[0-9]\.[0-9]{2}" and e["9.99"]["conforming"]
    assert not e["see sign"]["conforming"]
    covered = expression_coverage(shapes, induce_expressions(shapes)).agg(F.sum("rows")).first()[0]
    assert covered == len(rows)


def test_coverage_is_compared_with_the_load_before(spark):
    rows = [(1, "a", 1, "max_height", v, None) for v in ["4.2"] * 6 + ["5.1"] * 2 + ["4 m", "?"]] + [(2, "a", 3, "max_height", v, None) for v in ["4.2"] * 2 + ["4 m"] * 2] + [(3, "b", 2, "max_height", "4.2", None), (4, "a", 4, "max_height", None, None)]
    loads = spark.createDataFrame(rows, COLUMNS)
    shapes = shape_counts(value_counts(loads))
    expressions = spark.createDataFrame([("value_raw", "9.9", "9.9", "N", True), ("value_raw", "9 m", "9 m", "M", False), ("value_raw", "?", "?", "Q", False)], "column_name string, shape string, form string, expression string, conforming boolean")
    got = {(r.load_id, r.expression): tuple(r)[4:] for r in coverage_changes(expression_coverage(shapes, expressions), loads).collect()}
    assert got == {
        (1, "N"): (8, None, 10, None, 2, None, None), (1, "M"): (1, None, 10, None, 2, None, None), (1, "Q"): (1, None, 10, None, 2, None, None), (3, "N"): (1, None, 1, None, 0, None, None),
        (2, "N"): (2, 8, 4, 10, 2, 2, 0.5 - 0.8), (2, "M"): (2, 1, 4, 10, 2, 2, 0.5 - 0.1), (2, "Q"): (0, 1, 4, 10, 2, 2, 0.0 - 0.1), (4, "N"): (0, 2, 0, 4, 0, 2, None), (4, "M"): (0, 2, 0, 4, 0, 2, None),
    }


def test_fixed_expressions_match_their_own_values(spark):
    texts = ["1" * 20, "2" * 21, "a" + "3" * 300 + ".5", "<77>", "<7>(x)\n12"]
    df = spark.createDataFrame([("value_raw", t) for t in texts], "column_name string, text string")
    shapes = df.select("column_name", F.regexp_replace("text", "[0-9]", "9").alias("shape"), F.lit(1000).alias("distincts"))
    e = {r["shape"]: r["expression"] for r in induce_expressions(shapes).collect()}
    assert all(re.fullmatch(e[re.sub("[0-9]", "9", t)], t) for t in texts)
    assert e["9" * 21] == "[0-9]{21}" and e["<99>"] == "<[0-9]{2}>"


def test_findings_rest_on_the_induced_expressions(spark, monkeypatch):
    from gabarit.operators import profile

    rng = random.Random(8)
    good = [(1, "a", 1, "max_height", f"{rng.randint(200, 600) / 100}", "2024-05-01T00:00:00Z") for _ in range(80)]
    bad = [(2, "a", 2, "max_height", f"{rng.randint(200, 600) / 100} m" if k % 2 else f"{rng.randint(200, 600)}", "2024-05-01T00:00:00Z") for k in range(80)]
    df = spark.createDataFrame(good + bad, COLUMNS)
    found = lambda: {tuple(r) for r in load_findings(load_profile(df)).collect()}
    assert found() == {(2, "value_raw", "unreadable_share"), (2, "value_raw", "range_share"), (2, "value_raw", "median")}
    monkeypatch.setattr(profile, "induce_expressions", lambda s: s.select("column_name", "shape", F.lit("").alias("form"), F.lit("x").alias("expression"), F.lit(True).alias("conforming")).distinct())
    assert found() == set()  # one expression for everything: nothing is readable, so nothing departs


def test_expressions_that_read(spark):
    texts = [r"[0-9]", r"[0-9]{2}\.[0-9]+", r"[0-9]+,[0-9]{3}", r"[0-9]+ m", r"\p{L}+", r"[0-9]+-[0-9]+", "x", r"[0-9]\.[0-9]\.[0-9]"]
    assert [bool(re.search(profile_number, t)) for t in texts] == [True, True, True, False, False, False, False, False]
    instants = [r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", r"[0-9]+-[0-9]+-[0-9]+\p{L}+[0-9]+:[0-9]+:[0-9]+\p{L}+", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}-[0-9]{2}-[0-9]{4}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"]
    assert [bool(re.search(profile_instant, t)) for t in instants] == [True, True, False, False]


def test_any_column(spark):
    rows = [("a", 1, "x1"), ("a", None, " x2 "), ("a", 3, ""), (None, 3, None)]
    got = {(r.k, r.column_name): r for r in profile_columns(spark.createDataFrame(rows, "k string, n long, t string"), "k", ["n", "t"]).collect()}
    r = got["a", "t"]
    assert (r.rows, r.nulls, r.distincts, r.min_text, r.max_text, r.top_rows) == (3, 1, 2, "x1", "x2", 1)
    assert (got["a", "n"].nulls, got[None, "n"].rows, got[None, "t"].expression) == (1, 1, None)
    assert profile_columns(spark.createDataFrame([], "k string, t string"), "k", ["t"]).count() == 0
