"""The best representative of each duplicate group, by skyline selection.

A record dominates another of its group if it has at least the same fields present among those that are still wanted, at least the same
trust and at least the same recency, and more of one; recency is the total order of updated_at, latest first, then id, smallest first.
Of records with equal presence and trust only the most recent can be undominated, so that each group is first reduced (with map-side
combining, a group of any size never meets in one task) to at most 2**fields x trust ranks candidates.

The first layer is the undominated candidates with all fields wanted; the survivor is its first record by the lexicographic policy trust,
recency. Fields that the survivor has not are still wanted: the next layer is the undominated ones of the candidates that have any of
them, its first record fills what it has, and so on until nothing is wanted or no candidate has it. Every layer after the first fills
at least one field, so that there are at most fields + 1.

Each field comes from the record that the policy prefers among all that have it: whatever dominates that record has the field too and would
be preferred itself, so it is in the layer that fills the field, and no record before it in that layer has a wanted field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLISTED = 2**31 - 1  # the trust of a source that the registry does not list, or of none
WORST_TIME = -(2**62)


def group_key(reference: Column) -> Column:
    """reference without regard to letter case and all but a-z and digits; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(reference), "[^a-z0-9]", ""), F.lit(""))


def present(value: Column, text: bool) -> Column:
    """Not null, and for text not blank and not the word unknown."""
    if not text:
        return value.isNotNull()
    bare = F.lower(F.regexp_replace(value, r"^[\s\u00a0\u202f]+|[\s\u00a0\u202f]+$", ""))
    return F.coalesce((bare != "") & (bare != "unknown"), F.lit(False))


def dominates(a: Column, b: Column, wanted: Column) -> Column:
    """Whether candidate a (struct mask, trust, time, id) dominates b, with completeness counted in the wanted fields (a mask)."""
    return (
        (a["mask"].bitwiseAND(b["mask"]).bitwiseAND(wanted) == b["mask"].bitwiseAND(wanted))
        & (a["trust"] <= b["trust"])
        & ((a["time"] > b["time"]) | ((a["time"] == b["time"]) & (a["id"] <= b["id"])))
        & (a["id"] != b["id"])
    )


def successive_layers(candidates: Column, fields: int, rounds: int | None = None) -> Column:
    """array of struct(size, first): the size of each dominance layer and its first record by the policy, in whose order the candidates come.

    rounds: fields + 1 if not given, which always suffices.
    """
    start = F.struct(candidates.alias("rest"), F.lit(2**fields - 1).alias("wanted"), F.filter(F.transform(candidates, lambda c: F.struct(F.lit(0).alias("size"), c.alias("first"))), lambda _: F.lit(False)).alias("layers"))

    def peel(acc, _):
        layer = F.filter(acc["rest"], lambda b: ~F.exists(acc["rest"], lambda a: dominates(a, b, acc["wanted"])))
        first = F.get(layer, F.lit(0))
        wanted = acc["wanted"].bitwiseAND(F.bitwise_not(first["mask"]))
        rest = F.filter(acc["rest"], lambda c: c["mask"].bitwiseAND(wanted) != 0)
        more = F.concat(acc["layers"], F.array(F.struct(F.size(layer).alias("size"), first.alias("first"))))
        return F.when(F.size(acc["rest"]) == 0, acc).otherwise(F.struct(rest.alias("rest"), wanted.alias("wanted"), more.alias("layers")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds or fields + 1)), start, peel)["layers"]


def survivors(records: DataFrame, registry: DataFrame, fields: dict[str, bool], rounds: int | None = None) -> DataFrame:
    """(group_id, restriction_type, members, survivor_id, and for each field `<field>`, `<field>_from` and `<field>_layer`): one surviving record per group.

    survivor_id: the record that the survivor is built on; a field has its value, in layer 1, or that of the record which fills it, in a later layer.

    records: id, restriction_type, source.name, source.reference, updated_at and the fields (True: text). Groups are two or more ids of one
    restriction_type and reference (group_key); group_id is the smallest id. Repeated rows count once; rows without id, type or reference
    are in no group. registry: source_name, trust_rank; a name listed twice counts by its best rank. A null updated_at comes last. Where no
    record has a field, both columns are null. records may have further columns, of any names.
    """
    ranks = registry.groupBy(F.col("source_name").alias("name")).agg(F.min("trust_rank").alias("rank"))
    src = records.select("id", "restriction_type", F.col("source.name").alias("name"), group_key(F.col("source.reference")).alias("key"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("time"), *fields)
    src = src.filter(F.col("id").isNotNull() & F.col("restriction_type").isNotNull() & F.col("key").isNotNull())
    src = src.join(ranks, "name", "left")
    mask = sum((F.when(present(F.col(f), text), 2**k).otherwise(0) for k, (f, text) in enumerate(fields.items())), F.lit(0))
    src = src.select(
        "restriction_type", "key", "id", mask.cast("int").alias("mask"), F.coalesce(F.col("rank").cast("int"), F.lit(UNLISTED)).alias("trust"),
        F.coalesce("time", F.lit(WORST_TIME)).alias("time"), F.struct(*fields).alias("v"),
    )
    # the most recent of equal presence and trust; the smallest and largest id tell whether there are two
    first = src.groupBy("restriction_type", "key", "mask", "trust").agg(
        F.min(F.struct((-F.col("time")).alias("t"), "id", "v")).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("rows")
    )
    groups = first.groupBy("restriction_type", "key").agg(
        F.min("lo").alias("group_id"), F.max("hi").alias("hi"), F.sum("rows").alias("members"),
        F.array_sort(F.collect_list(F.struct("trust", F.col("m.t").alias("t"), F.col("m.id").alias("id"), "mask", (-F.col("m.t")).alias("time"), F.col("m.v").alias("v")))).alias("c"),
    ).filter(F.col("group_id") < F.col("hi"))
    # array_sort put the candidates in the order of the policy: trust, latest, smallest id
    groups = groups.withColumn("layers", successive_layers(F.col("c"), len(fields), rounds))
    out = ["group_id", "restriction_type", "members", F.get("layers", F.lit(0)).getField("first").getField("id").alias("survivor_id")]
    for k, f in enumerate(fields):
        has = F.transform("layers", lambda r: r["first"]["mask"].bitwiseAND(F.lit(2**k)) != 0)  # noqa: B023
        at = F.array_position(has, F.lit(True)).cast("int")
        best = F.when(at > 0, F.get("layers", at - 1).getField("first"))
        out += [best.getField("v").getField(f).alias(f), best.getField("id").alias(f"{f}_from"), F.when(at > 0, at).alias(f"{f}_layer")]
    return groups.select(*out)
