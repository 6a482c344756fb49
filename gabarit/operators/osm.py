"""Analyses of a road network extract: coverage of tags, and clearance under bridges. Ways: way_id, tags map, nodes, coords, ts; nodes: node_id, tags, lon, lat, ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabarit.functions.geo import haversine_m, in_ring
from gabarit.functions.text import COVERAGE_CLASSES, CROSSING_CLASSES, NON_ROADS, NOT_CROSSED, clearance_bucket, coverage_bucket, layer_of, road_class, tagged_height
from gabarit.operators.lines import meetings
from gabarit.session import materialize, small

#: Tags that are counted, and rough outlines of two regions as (lon, lat).
COUNTED_TAGS = ("maxheight", "maxheight:physical", "maxwidth", "maxlength", "maxweight", "maxaxleload", "hgv", "hazmat")
HEIGHT_TAGS = ("maxheight", "maxheight:physical")
GAZA = [(34.21, 31.22), (34.57, 31.59), (34.50, 31.60), (34.20, 31.33)]
WEST_BANK = [(34.95, 31.35), (35.57, 31.35), (35.57, 32.55), (35.50, 32.55), (35.00, 32.45), (35.00, 32.10), (34.95, 31.85)]
NODE_RADIUS_M = 30.0


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def height_tag() -> Column:
    """The first height tag that is not empty."""
    return F.coalesce(*[F.nullif(tag(t), F.lit("")) for t in HEIGHT_TAGS])


def region_of(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNull() | lat.isNull(), "unknown").when(in_ring(lon, lat, GAZA), "gaza").when(in_ring(lon, lat, WEST_BANK), "west_bank").otherwise("israel")


def roads(ways: DataFrame) -> DataFrame:
    """Ways that count for coverage, with class, height text, parsed height, region of the first position."""
    r = ways.filter(F.coalesce(tag("highway"), F.lit("")) != "").filter(~tag("highway").isin(*NON_ROADS))
    first = F.get(F.col("coords"), F.lit(0))
    r = r.withColumn("class", road_class(tag("highway"), COVERAGE_CLASSES)).withColumn("raw", height_tag()).withColumn("h", tagged_height(F.col("raw")))
    return r.withColumn("region", region_of(first["x"], first["y"]))


def class_coverage(ways: DataFrame) -> DataFrame:
    return roads(ways).groupBy("class").agg(F.count(F.lit(1)).alias("ways"), F.count("raw").alias("with_height"))


def tag_counts(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, tag, n): presence of the counted tags on roads and on all nodes."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.explode(F.map_keys("tags")).alias("tag")).filter(F.col("tag").isin(*COUNTED_TAGS))
    return one(roads(ways), "way").unionByName(one(nodes, "node")).groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


def structure_totals(ways: DataFrame) -> DataFrame:
    """(structure, total, with_height): roads that are bridge, tunnel or covered (a tag other than no)."""
    kinds = F.array_compact(F.array(*[F.when(tag(k).isNotNull() & (tag(k) != "no"), F.lit(k)) for k in ("bridge", "tunnel", "covered")]))
    return roads(ways).select(F.explode(kinds).alias("structure"), "raw").groupBy("structure").agg(F.count(F.lit(1)).alias("total"), F.count("raw").alias("with_height"))


def region_totals(ways: DataFrame) -> DataFrame:
    return roads(ways).groupBy("region").agg(F.count(F.lit(1)).alias("ways"), F.count("raw").alias("with_height"))


def unit_histogram(ways: DataFrame) -> DataFrame:
    return roads(ways).filter("raw IS NOT NULL").groupBy(F.col("h.unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def top_values(ways: DataFrame, k: int = 15) -> DataFrame:
    """(value, n): the k most frequent heights to 0.1 m, halves to even; ties by value."""
    v = F.bround(F.col("h.metres"), 1)
    return roads(ways).filter("h.metres IS NOT NULL").groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def height_buckets(ways: DataFrame) -> DataFrame:
    return roads(ways).filter("h.metres IS NOT NULL").groupBy(coverage_bucket(F.col("h.metres")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def odd_values(ways: DataFrame, k: int = 15) -> DataFrame:
    """(value, n): the k most frequent height texts that are no number; ties by text."""
    return roads(ways).filter("h.unit = 'non-numeric'").groupBy(F.lower(F.trim("raw")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def newest(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the largest timestamp of both (seconds; missing counts as 0)."""
    return ways.select("ts").unionByName(nodes.select("ts")).agg(F.coalesce(F.max("ts"), F.lit(0).cast("long")).alias("newest"))


def _usable(ways: DataFrame) -> DataFrame:
    rail = tag("railway").isNotNull() & F.coalesce(tag("bridge") != "no", F.lit(False))
    kept = (F.coalesce(tag("highway"), F.lit("")) != "") & (~tag("highway").isin(*NOT_CROSSED) | rail)
    w = ways.filter(kept | ((F.coalesce(tag("highway"), F.lit("")) == "") & rail))
    return w.filter((F.size("coords") >= 2) & F.forall("coords", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def _bridge_kind() -> Column:
    """road or rail for a bridge, else null."""
    road = F.coalesce(tag("highway"), F.lit("")) != ""
    kind = F.when(road, "road").when(tag("railway").isNotNull() & (tag("bridge") == "yes"), "rail")
    return F.when(F.coalesce(tag("bridge") != "no", F.lit(False)), kind)


def _is_open() -> Column:
    """A road that is no bridge, no tunnel and not covered."""
    open_ = ~F.coalesce(tag("bridge") != "no", F.lit(False)) & (F.coalesce(tag("tunnel"), F.lit("no")) == "no") & (F.coalesce(tag("covered"), F.lit("")) != "yes")
    return (F.coalesce(tag("highway"), F.lit("")) != "") & open_


def bridge_ways(ways: DataFrame) -> DataFrame:
    """Bridges with kind (road, rail) and layer (1 by default); a bridge without road or rail is none."""
    return _usable(ways).withColumn("kind", _bridge_kind()).filter("kind IS NOT NULL").withColumn("layer", layer_of(tag("layer"), F.lit(1)))


def under_roads(ways: DataFrame) -> DataFrame:
    """Roads that may pass under a bridge, with class and layer (0 by default): no bridge, no tunnel, not covered."""
    return _usable(ways).filter(_is_open()).withColumn("class", road_class(tag("highway"), CROSSING_CLASSES)).withColumn("layer", layer_of(tag("layer"), F.lit(0)))


def bridges_by_kind(ways: DataFrame) -> DataFrame:
    return bridge_ways(ways).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _met(ways: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What underpasses are put together from, without a row for each of them:

    bridges (bridge_id, kind, over), roads (road_id, class, tagged, under, marks, shared) and meetings (over, under, x, y).
    Ways of one course and layer meet the same, so that one of them (the one of the least way_id: over, under) is held against the others.
    shared: the bridges that a road shares a node with. marks: the nodes with a height along a road without one, in order; none if nodes is None.
    The ways are read once and written, with what the steps need of them; those that meet nothing are left behind early.
    """
    # tags may be a costly expression of the source; behind a generator the optimizer cannot put it into each condition that reads it
    ways = ways.select(F.inline(F.array(F.struct("way_id", "tags", "nodes", "coords"))))
    w = _usable(ways).withColumn("kind", _bridge_kind()).withColumn("class", F.when(F.col("kind").isNull() & _is_open(), road_class(tag("highway"), CROSSING_CLASSES)))
    over = F.col("kind").isNotNull()
    w = w.filter("kind IS NOT NULL OR class IS NOT NULL").select(
        "way_id", "kind", "class", F.when(over, layer_of(tag("layer"), F.lit(1))).otherwise(layer_of(tag("layer"), F.lit(0))).alias("layer"),
        height_tag().alias("tagged"), over.alias("bridge"), F.xxhash64("coords").alias("h"), "coords", "nodes",
    )
    w, course = materialize(w, "crossing-ways"), ["h", "layer", "bridge", "coords"]
    shapes = materialize(w.groupBy(*course).agg(F.min("way_id").alias("shape")), "courses")
    one = shapes.select(F.col("shape").alias("way_id"), "layer", "coords", "bridge")
    met = materialize(meetings(one.filter("bridge"), one.filter("NOT bridge")).select(F.col("bridge_id").alias("over"), F.col("road_id").alias("under"), "x", "y"), "meetings")
    ends = met.select(F.col("over").alias("shape")).unionByName(met.select(F.col("under").alias("shape"))).distinct()
    used = materialize(shapes.join(ends, "shape", "left_semi"), "met-courses")
    w = materialize(w.join(small(used), course).select("way_id", "kind", "class", "tagged", "nodes", "shape"), "met-ways")

    bridges = w.filter("kind IS NOT NULL").select(F.col("way_id").alias("bridge_id"), "kind", F.col("shape").alias("over"))
    roads = w.filter("kind IS NULL").select(F.col("way_id").alias("road_id"), "class", "tagged", F.col("shape").alias("under"))
    seen = w.filter("kind IS NOT NULL").select(F.explode("nodes").alias("node_id"), F.col("way_id").alias("bridge_id"))
    mark = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("string").alias("node_tag"))
    if nodes is None:
        seen = seen.withColumn("mark", F.when(F.lit(False), mark))
    else:
        marked = nodes.withColumn("node_tag", height_tag()).filter("node_tag IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
        of = F.struct(F.lit(0).alias("pos"), "lon", "lat", "node_tag")
        seen = seen.withColumn("mark", F.when(F.lit(False), mark)).unionByName(marked.select("node_id", F.lit(None).cast("long").alias("bridge_id"), of.alias("mark")))
    along = w.filter("kind IS NULL").select(F.col("way_id").alias("road_id"), "tagged", F.posexplode("nodes").alias("at", "node_id")).join(seen, "node_id").filter("bridge_id IS NOT NULL OR tagged IS NULL")
    placed = F.when(F.col("mark").isNotNull(), F.struct(F.col("at").alias("pos"), "mark.lon", "mark.lat", "mark.node_tag"))
    along = along.groupBy("road_id").agg(F.array_sort(F.collect_list(placed)).alias("marks"), F.collect_set("bridge_id").alias("shared"))
    return bridges, materialize(roads.join(along, "road_id", "left"), "met-roads"), met


def _spots(roads: DataFrame, met: DataFrame) -> DataFrame:
    """roads once for each course of bridges that they meet, with x, y, source and the text of the height. source: way_tag, or node_within_30m for the first of the road's nodes with a height tag in that distance, else null."""
    near = F.get(F.filter("marks", lambda m: haversine_m(F.col("x"), F.col("y"), m["lon"], m["lat"]) <= NODE_RADIUS_M), F.lit(0))
    out = roads.join(small(met), "under").withColumn("near", F.when(F.size("marks") > 0, near))
    source = F.when(F.col("tagged").isNotNull(), "way_tag").when(F.col("near").isNotNull(), "node_within_30m")
    return out.select("road_id", "class", "over", "x", "y", source.alias("source"), F.coalesce("tagged", "near.node_tag").alias("text"), "shared")


def _not_met(spots: DataFrame, bridges: DataFrame) -> DataFrame:
    """The rows of spots with each bridge that meets the road on its course, but shares a node with it."""
    return spots.filter(F.size("shared") > 0).withColumn("bridge_id", F.explode("shared")).join(bridges, ["bridge_id", "over"])


def underpasses(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bridge_id, kind, road_id, class, x, y, source, height): each road under a bridge, with the clearance the road states.

    source: way_tag, or node_within_30m for the first of the road's nodes with a height tag in that distance, else null. height: its parsed value.
    Pairs are put together last, in the join that returns them: no step writes or shuffles a row for each of them. way_id is unique.
    """
    bridges, roads, met = _met(ways, nodes)
    texts = roads.select(F.col("tagged").alias("text")).unionByName(roads.select(F.explode("marks.node_tag").alias("text"))).filter("text IS NOT NULL").distinct()
    heights = materialize(materialize(texts, "texts").select("text", tagged_height(F.col("text"))["metres"].alias("height")), "heights")  # parsing is costly: each text once
    out = _spots(roads, met).join(small(heights), "text", "left").join(bridges, "over").filter(~F.coalesce(F.array_contains("shared", F.col("bridge_id")), F.lit(False)))
    return out.select("bridge_id", "kind", "road_id", "class", "x", "y", "source", "height")


def underpass_counts(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, class, source, height, n): how many underpasses() there are of each text of a height. Roads and bridges are counted for each course and the counts multiplied, less the pairs that share a node, so that pairs are not listed."""
    bridges, roads, met = _met(ways, nodes)
    keys = ["class", "source", "text"]
    spots = _spots(roads, met)
    under = spots.groupBy("over", *keys).agg(F.count(F.lit(1)).alias("n"))
    over = bridges.groupBy("over", "kind").agg(F.count(F.lit(1)).alias("m"))
    every = under.join(over, "over").select("kind", *keys, (F.col("n") * F.col("m")).alias("n"))
    less = _not_met(spots, bridges).select("kind", *keys, F.lit(-1).cast("long").alias("n"))
    counts = every.unionByName(less).groupBy("kind", *keys).agg(F.sum("n").alias("n")).filter("n > 0")
    return counts.select("kind", "class", "source", tagged_height(F.col("text"))["metres"].alias("height"), "n")


def crossed_bridges(ways: DataFrame) -> DataFrame:
    """(bridge_id, kind): the bridges of underpasses(), each once: those whose course meets more roads than they share a node with."""
    bridges, roads, met = _met(ways, None)
    spots = roads.join(small(met), "under")
    every = spots.groupBy("over").agg(F.count(F.lit(1)).alias("n"))
    less = _not_met(spots, bridges).groupBy("bridge_id").agg(F.count(F.lit(1)).alias("less"))
    return bridges.join(every, "over").join(less, "bridge_id", "left").filter(F.col("n") > F.coalesce("less", F.lit(0))).select("bridge_id", "kind")


def _times(rows: DataFrame) -> DataFrame:
    """rows of underpasses(), or of underpass_counts(), with n."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))


def _sum_if(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)), F.lit(0).cast("long"))


def underpass_totals(rows: DataFrame) -> DataFrame:
    """One row over all underpasses: underpasses, with_clearance, percent (one decimal, null if there is none)."""
    n, has = _sum_if(), _sum_if(F.col("source").isNotNull())
    return _times(rows).agg(n.alias("underpasses"), has.alias("with_clearance"), F.round(F.try_divide(has * 100.0, n), 1).alias("percent"))


def underpass_classes(rows: DataFrame) -> DataFrame:
    """(class, underpasses, under_road, under_rail, with_clearance, percent) of underpasses(), in the order of the classes."""
    n = _sum_if()
    has = _sum_if(F.col("source").isNotNull())
    return _times(rows).groupBy("class").agg(
        n.alias("underpasses"), _sum_if(F.col("kind") == "road").alias("under_road"), _sum_if(F.col("kind") == "rail").alias("under_rail"), has.alias("with_clearance"), F.round(has * 100.0 / n, 1).alias("percent")
    ).orderBy("class")


def clearance_counts(rows: DataFrame) -> DataFrame:
    """(source, bucket, n) of the underpasses with a clearance."""
    return _times(rows).filter("source IS NOT NULL").groupBy("source", clearance_bucket(F.col("height")).alias("bucket")).agg(_sum_if().alias("n"))


def bridges_over_roads(rows: DataFrame) -> DataFrame:
    """(kind, bridges) of underpasses() or crossed_bridges()."""
    return rows.groupBy("kind").agg(F.count_distinct("bridge_id").alias("bridges"))


def report(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, key, value, n): the counts of both analyses in one table, and nothing else of the extract: classes, tags, structures, regions, units, buckets, bridges, underpasses, clearances."""
    rows = materialize(underpass_counts(ways, nodes), "underpasses")
    one = lambda part, df, key, value, n: df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value") if value else F.lit(None).cast("string").alias("value"), F.col(n).cast("long").alias("n"))
    coverage, structures, regions = class_coverage(ways), structure_totals(ways), region_totals(ways)
    parts = [
        one("class", coverage, "class", None, "ways"), one("class with height", coverage, "class", None, "with_height"), one("tag", tag_counts(ways, nodes), "kind", "tag", "n"), one("structure", structures, "structure", None, "total"),
        one("structure with height", structures, "structure", None, "with_height"), one("region", regions, "region", None, "ways"), one("unit", unit_histogram(ways), "unit", None, "n"), one("height", height_buckets(ways), "bucket", None, "n"),
        one("bridges", bridges_by_kind(ways), "kind", None, "n"), one("underpasses", underpass_classes(rows), "class", None, "underpasses"), one("bridges over roads", bridges_over_roads(crossed_bridges(ways)), "kind", None, "bridges"), one("clearance", clearance_counts(rows), "source", "bucket", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
