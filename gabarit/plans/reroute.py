"""Routing round restrictions: route, hold the route against the store, exclude what conflicts, route again, a bounded number of times.

A provider gives the shapes: provider(requests, excluded) -> (route_id, coords), for requests with the ids excluded so far (an array, empty at
first). A request without a shape has no route. Providers may join a table of shapes, call a router from mapInPandas, or bend a line as mock() does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabarit.functions.geo import bent_line
from gabarit.plans.verdicts import corridor_reasons
from gabarit.session import materialize

Provider = Callable[[DataFrame], DataFrame]
MAX_REROUTES = 3


def mock(bulge: float = 0.05, steps: int = 40, no_detour: bool = False) -> Provider:
    """A provider for tests: the straight line from x1, y1 to x2, y2; bent sideways once anything is excluded, or none then."""

    def shapes(requests: DataFrame) -> DataFrame:
        at = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
        free = F.size("excluded") == 0
        kept = requests.filter(free) if no_detour else requests
        return kept.select("route_id", F.when(free, bent_line(*at, 0.0, steps)).otherwise(bent_line(*at, bulge, steps)).alias("coords"))

    return shapes


def rerouted(requests: DataFrame, restrictions: DataFrame, provider: Provider, max_reroutes: int = MAX_REROUTES, radius_m: float = 50.0) -> DataFrame:
    """(route_id, outcome, reroutes, avoided, conflicts, verified_on_route, unverified_on_route): one row per request; ids as sorted arrays.

    requests: route_id (unique), at, the vehicle's columns, and what the provider needs. outcome: clear (no conflict on the last route), no_route (none at
    first), no_detour (none once ids were excluded), no_effect (the conflicts were excluded already), limit (conflicts after max_reroutes).
    Each pass treats only the requests that are still open; requests and restrictions are written first and open requests between
    passes, so that a plan holds one pass and no pass derives its inputs again.
    """
    none = F.array().cast("array<string>")
    requests, restrictions = materialize(requests, "requests"), materialize(restrictions, "restrictions")
    open_ = requests.withColumn("excluded", none).withColumn("last", none)
    done = None
    for attempt in range(max_reroutes + 1):
        shapes = materialize(provider(open_), "shapes")
        found = corridor_reasons(open_.drop("excluded", "last"), shapes, restrictions, radius_m)
        verified = F.coalesce(F.col("status") == "verified", F.lit(False))
        per = found.groupBy("route_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.col("id")))).alias("conflicts"),
            F.count_if(F.col("reason").isNull() & verified).alias("verified_on_route"), F.count_if(F.col("reason").isNull() & ~verified).alias("unverified_on_route"),
        )
        state = open_.join(shapes.select("route_id", F.lit(True).alias("routed")), "route_id", "left").join(per, "route_id", "left")
        state = state.withColumn("conflicts", F.coalesce("conflicts", none)).withColumn("fresh", F.array_except("conflicts", "excluded"))
        outcome = (
            F.when(F.col("routed").isNull(), "no_route" if attempt == 0 else "no_detour").when(F.size("conflicts") == 0, "clear")
            .when(F.lit(attempt == max_reroutes), "limit").when(F.size("fresh") == 0, "no_effect")
        )
        state = materialize(state.withColumn("outcome", outcome), "attempt")
        ended = state.filter("outcome IS NOT NULL").select(
            "route_id", "outcome", F.lit(attempt).alias("reroutes"), F.array_sort("excluded").alias("avoided"), F.when(F.col("outcome") == "no_detour", F.col("last")).otherwise(F.col("conflicts")).alias("conflicts"),
            F.coalesce("verified_on_route", F.lit(0).cast("long")).alias("verified_on_route"), F.coalesce("unverified_on_route", F.lit(0).cast("long")).alias("unverified_on_route"),
        )
        done = ended if done is None else done.unionByName(ended)
        rest = state.filter("outcome IS NULL")
        if rest.isEmpty():
            break
        open_ = rest.withColumn("excluded", F.array_union("excluded", "fresh")).withColumn("last", F.col("conflicts")).select(*requests.columns, "excluded", "last")
    return done
