"""Routes against the store: who drives where and when, and what lies on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.functions.timewindows import active
from gabarit.operators.lines import by_shape, near_shapes
from gabarit.operators.rules import LIMITS, actual_of, reason
from gabarit.plans.views import view

#: Each order is a request: its route, the evaluation instant, and the number of a vehicle.
REQUESTS = """SELECT o_orderkey AS route_id, o_orderkey % 40 AS vehicle_no, CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT), 0, 0) AS at FROM {orders}"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(route_id, at, profile_name, height_m .. axle_load_t, hazmat): a request for each order; vehicles are told apart by the number in their name."""
    from gabarit.sources.tables import table

    v = table(spark, d, "vehicle_profiles").filter("profile_name IS NOT NULL").withColumn("vehicle_no", F.regexp_extract("profile_name", "([0-9]+)$", 1).try_cast("long"))
    v = v.filter("vehicle_no IS NOT NULL").groupBy("vehicle_no").agg(F.min("profile_name").alias("profile_name"), *[F.max(c).alias(c) for c, _ in LIMITS.values()], F.max(F.col("hazmat").isNotNull()).alias("hazmat"))
    return view(spark, d, REQUESTS, "orders").join(v, "vehicle_no").drop("vehicle_no")


def corridor_reasons(requests: DataFrame, routes: DataFrame, restrictions: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """requests with each restriction within radius_m of their route, whether it holds at the time, and the reason if it holds and the vehicle breaks it.

    Restrictions meet the shapes of routes first, and requests last, in the join that returns the rows. route_id is unique in routes.
    """
    shaped = by_shape(routes)
    near = near_shapes(shaped, restrictions.select("id", "coords"), radius_m).join(restrictions.drop("coords"), "id")
    j = shaped.select("route_id", "shape").join(requests, "route_id").join(near, "shape").drop("shape")
    j = j.withColumn("active", active(F.col("time_windows"), F.col("at")))
    why = reason(F.col("value_numeric"), F.col("unit"), actual_of(F.col("restriction_type")), F.col("restriction_type"), F.col("value_boolean"), F.col("hazmat"))
    return j.withColumn("reason", F.when(F.col("active"), why))


def verdict_counts(reasons: DataFrame) -> DataFrame:
    """(route_id, conflicts, verified_on_route, unverified_on_route): a record that holds but is no conflict, or does not hold, is on the route; unverified is all that is not verified. Absence of records says nothing about a road."""
    on = F.col("reason").isNull()
    ok = F.coalesce(F.col("status") == "verified", F.lit(False))
    return reasons.groupBy("route_id").agg(F.count("reason").alias("conflicts"), F.count_if(on & ok).alias("verified_on_route"), F.count_if(on & ~ok).alias("unverified_on_route"))
