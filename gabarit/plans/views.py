"""Derived views for inputs that no table holds: routes, boxes, ways and nodes. Each is one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.sources.tables import table

#: A route for each order: its lines' numbers as vertices, from a place that depends on the order.
ROUTE_VERTICES = """SELECT DISTINCT l_orderkey AS route_id, l_linenumber AS seq,
 34.3e0 + ((l_orderkey * 7919) % 12000) / 1e4 + l_linenumber * 3e-3 AS x, 29.6e0 + ((l_orderkey * 15485863) % 36000) / 1e4 + l_linenumber * 2e-3 AS y FROM {lineitem}"""
#: Texts of boxes, some of them wrong.
BOXES = """SELECT p_partkey AS box_id, CASE p_partkey % 7 WHEN 0 THEN '34.5,31.0,35.2,32.0' WHEN 1 THEN '34.5,31.0,35.2' WHEN 2 THEN '34.5,x,35.2,32' WHEN 3 THEN '35.2,31,34.5,32'
 WHEN 4 THEN '34.5,31,190,32' WHEN 5 THEN '34.5, ,35.2,32' ELSE ' 34.5 , 31, 35.25,32.5 ' END AS txt FROM {part}"""
#: Ways of three positions in a small area, with tags as columns; the second node of every thirtieth is also the next one's.
WAYS = """SELECT o_orderkey AS way_id, 1700000000 + o_orderkey % 86400 AS ts,
 CASE o_orderkey % 13 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' WHEN 5 THEN 'residential' WHEN 6 THEN 'service'
  WHEN 7 THEN 'track' WHEN 8 THEN 'footway' WHEN 9 THEN 'raceway' WHEN 10 THEN 'unclassified' WHEN 11 THEN NULL ELSE 'living_street' END AS highway,
 CASE WHEN o_orderkey % 26 = 11 THEN 'rail' END AS railway,
 CASE WHEN o_orderkey % 10 = 1 THEN 'yes' WHEN o_orderkey % 40 = 2 THEN 'no' WHEN o_orderkey % 50 = 3 THEN 'viaduct' END AS bridge,
 CASE WHEN o_orderkey % 31 = 4 THEN 'yes' WHEN o_orderkey % 62 = 5 THEN 'no' END AS tunnel, CASE WHEN o_orderkey % 37 = 6 THEN 'yes' END AS covered,
 CASE o_orderkey % 11 WHEN 0 THEN '1' WHEN 1 THEN '-1' WHEN 2 THEN '2.7' WHEN 3 THEN 'x' END AS layer,
 CASE o_orderkey % 17 WHEN 0 THEN '4.2' WHEN 1 THEN '3,85 m' WHEN 2 THEN '13''6"' WHEN 3 THEN '14 ft' WHEN 4 THEN 'default' WHEN 5 THEN ' None ' WHEN 6 THEN '12''' WHEN 7 THEN '' WHEN 8 THEN '1.9' WHEN 9 THEN '7.5' END AS maxheight,
 CASE WHEN o_orderkey % 23 = 1 THEN '4.4' END AS maxheight_physical, CASE WHEN o_orderkey % 19 = 1 THEN '2.5' END AS maxwidth, CASE WHEN o_orderkey % 29 = 1 THEN 'no' END AS hgv,
 34.8e0 + ((o_orderkey * 7919) % 2000) / 1e4 AS x1, 31.4e0 + ((o_orderkey * 104729) % 2000) / 1e4 AS y1,
 34.8e0 + ((o_orderkey * 7919) % 2000) / 1e4 + ((o_orderkey % 7) - 3) * 1e-3 AS x2, 31.4e0 + ((o_orderkey * 104729) % 2000) / 1e4 + ((o_orderkey % 5) - 2) * 1.3e-3 AS y2,
 34.8e0 + ((o_orderkey * 7919) % 2000) / 1e4 + ((o_orderkey % 7) - 3) * 2.1e-3 AS x3, 31.4e0 + ((o_orderkey * 104729) % 2000) / 1e4 + ((o_orderkey % 5) - 2) * 2.3e-3 AS y3,
 o_orderkey * 4 AS n1, CASE WHEN o_orderkey % 30 = 0 THEN o_orderkey * 4 + 4 ELSE o_orderkey * 4 + 1 END AS n2, o_orderkey * 4 + 2 AS n3 FROM {orders}"""
#: Tagged nodes: the second and third of some ways.
NODES = """SELECT o_orderkey * 4 + 1 AS node_id, 1700000000 + o_orderkey % 90000 AS ts, 34.8e0 + ((o_orderkey * 7919) % 2000) / 1e4 + ((o_orderkey % 7) - 3) * 1e-3 AS lon,
 31.4e0 + ((o_orderkey * 104729) % 2000) / 1e4 + ((o_orderkey % 5) - 2) * 1.3e-3 AS lat, CASE WHEN o_orderkey % 4 = 0 THEN '4.1' ELSE 'none' END AS maxheight, CASE WHEN o_orderkey % 6 = 0 THEN 'no' END AS hgv
 FROM {orders} WHERE o_orderkey % 3 = 0"""
#: A batch of changes to the restriction store, from parts.
COMMANDS = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'N-' || p_partkey ELSE 'R-' || substr(CAST(1000000000 + 1000 + p_partkey AS STRING), 2) END AS id,
 CASE WHEN p_partkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'desk-' || (p_partkey % 4) END AS actor, CAST(p_size AS DOUBLE) AS value_numeric, 'unverified' AS status FROM {part}"""
#: Versions of profiles, the last of which counts.
PROFILES = """SELECT 'P-' || (user_id % 40) AS name, event_id AS version, value AS height_m, event_type = 'error' AS deleted FROM {events}"""


def view(spark: SparkSession, d: str, sql: str, *tables: str) -> DataFrame:
    """The view as a DataFrame over the tables of a folder."""
    return spark.sql(sql, **{t: table(spark, d, t) for t in tables})


def duck(sql: str, *tables: str) -> str:
    """The view as SQL over tables of the same names."""
    return sql.format(**{t: t for t in tables}).replace("AS STRING", "AS VARCHAR")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """ROUTE_VERTICES over lines that lie together by order, so that neither its DISTINCT nor a grouping by route moves them again."""
    return spark.sql(ROUTE_VERTICES, lineitem=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """(route_id, coords): routes with their vertices in order."""
    v = vertices(spark, d)
    return v.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v")).select("route_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    """(way_id, ts, tags, nodes, coords) in the form of an extract."""
    w = view(spark, d, WAYS, "orders")
    named = {"highway": "highway", "railway": "railway", "bridge": "bridge", "tunnel": "tunnel", "covered": "covered", "layer": "layer", "maxheight": "maxheight", "maxheight:physical": "maxheight_physical", "maxwidth": "maxwidth", "hgv": "hgv"}
    tags = F.map_filter(F.create_map(*[x for k, c in named.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    coords = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2, 3)])
    return w.select("way_id", F.col("ts").cast("long").alias("ts"), tags.alias("tags"), F.array("n1", "n2", "n3").alias("nodes"), coords.alias("coords"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, NODES, "orders")
    tags = F.map_filter(F.create_map(F.lit("maxheight"), F.col("maxheight"), F.lit("hgv"), F.col("hgv")), lambda k, v: v.isNotNull())
    return n.select("node_id", F.col("ts").cast("long").alias("ts"), tags.alias("tags"), "lon", "lat")
