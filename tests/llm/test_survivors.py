import random

from pyspark.sql import functions as F

from gabarit.llm.survivors import survivors

SCHEMA = "id string, restriction_type string, source struct<name:string,reference:string>, updated_at timestamp, status string, value_source string, verified_at timestamp"
FIELDS = {"status": True, "value_source": True, "verified_at": False}


def brute(rows, ranks):
    import re

    groups = {}
    for r in set(rows):
        key = re.sub("[^a-z0-9]", "", (r[2][1] or "").lower())
        if r[0] and r[1] and key:
            groups.setdefault((r[1], key), []).append(r)
    out = {}
    for g in groups.values():
        ids = {r[0] for r in g}
        if len(ids) < 2:
            continue
        for k, f in enumerate(FIELDS, 4):
            have = [r for r in g if r[k] is not None and (f == "verified_at" or str(r[k]).strip().lower() not in ("", "unknown"))]
            if have:
                out[min(ids), f] = min(have, key=lambda r: (ranks.get(r[2][0], 10**9), -(r[3].timestamp() if r[3] else -(10**12)), r[0]))[0]
    return out


def test_against_brute_force(spark):
    import datetime as dt

    rng = random.Random(4)
    t = lambda: rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 5))])
    rows = [(f"r{k:03d}", rng.choice(["a", "b"]), (rng.choice(["s1", "s2", "s3", None, "odd"]), rng.choice(["X-1", "x 1", "Y/2", "y2", "...", "", None, f"z{k}"])), t(), rng.choice(["ok", " Unknown", "", None, "bad"]), rng.choice(["UNKNOWN ", "m", None]), t()) for k in range(160)]
    rows += rows[:30]
    registry = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 5), ("s3", 3), (None, 1)], "source_name string, trust_rank int")
    got = {}
    for r in survivors(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("name", F.lit("clash")), registry, FIELDS).collect():
        got |= {(r.group_id, f): r[f"{f}_from"] for f in FIELDS if r[f"{f}_from"]}
    assert got == brute(rows, {"s1": 1, "s2": 2, "s3": 3})


def test_empty_and_hot(spark):
    registry = spark.createDataFrame([], "source_name string, trust_rank int")
    assert survivors(spark.createDataFrame([], SCHEMA), registry, FIELDS).count() == 0
    hot = spark.range(5000).select(F.format_string("i%05d", "id").alias("id"), F.lit("t").alias("restriction_type"), F.struct(F.lit("s").alias("name"), F.lit("same").alias("reference")).alias("source"), F.timestamp_seconds(F.col("id") % 7).alias("updated_at"), F.when(F.col("id") % 9 == 0, "ok").alias("status"), F.lit(None).cast("string").alias("value_source"), F.lit(None).cast("timestamp").alias("verified_at"))
    r = survivors(hot, registry, FIELDS).collect()
    assert len(r) == 1 and (r[0].group_id, r[0].status_from, r[0].value_source_from) == ("i00000", "i00027", None)


def test_later_layers_fill_what_the_survivor_has_not(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, k)
    rows = [
        ("a", "t", ("s1", "r"), day(1), "ok", None, None), ("b", "t", ("s1", "r"), day(3), None, None, None), ("c", "t", ("s2", "r"), day(2), "bad", "m", None), ("d", "t", ("s3", "r"), day(9), "bad", "n", day(5)),
    ]
    registry = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "source_name string, trust_rank int")
    df = spark.createDataFrame(rows, SCHEMA)
    r = survivors(df, registry, FIELDS).first()
    assert r.survivor_id == "b" and [(r[f"{f}_from"], r[f"{f}_layer"]) for f in FIELDS] == [("a", 2), ("c", 3), ("d", 4)]
    one = survivors(df, registry, FIELDS, rounds=1).first()  # without later layers nothing is filled
    assert one.survivor_id == "b" and all(one[f"{f}_from"] is None for f in FIELDS)
