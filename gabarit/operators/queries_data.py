"""The queries of the general data problems (2, 3 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.operators.profile import coverage_changes, expression_coverage, induce_expressions, load_findings, load_profile, profile_columns, shape_counts, value_counts
from gabarit.operators.osm import GAZA, WEST_BANK
from gabarit.operators.spatial import located, near_pairs, regions_of_points
from gabarit.operators.units import BASE, converted, learned_units, stated
from gabarit.session import materialize, small
from gabarit.sources.tables import table

NEAR_M = 30.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return load_findings(load_profile(table(spark, d, "restriction_loads")))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    p = load_profile(table(spark, d, "restriction_loads"))
    return p.select("load_id", "column_name", "rows", (F.col("rows") - F.col("filled")).alias("nulls"), "distincts", "readable", "out_of_range", F.col("top").alias("top_rows"), "min_num", "max_num", "median")


def p2_expressions(spark: SparkSession, d: str) -> DataFrame:
    loads = table(spark, d, "restriction_loads")
    shapes = materialize(shape_counts(value_counts(loads)), "shape-counts")
    return coverage_changes(expression_coverage(shapes, small(materialize(induce_expressions(shapes), "expressions"))), loads)


PROFILED = ["feed_name", "record_id", "road_segment_id", "restriction_type", "value_raw", "unit_raw", "remark", "review_due_at_raw"]


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every text column of the loads, for each load."""
    p = profile_columns(table(spark, d, "restriction_loads"), "load_id", PROFILED)
    return p.select("load_id", "column_name", "rows", "nulls", "distincts", "min_text", "max_text", "top_rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(located(table(spark, d, "restrictions")), NEAR_M).select("id_a", "id_b")


#: A region with a hole, for p3_regions, beside the outlines of the road network's analyses.
BELT, BELT_HOLE = [(34.4, 30.5), (35.4, 30.5), (35.4, 32.5), (34.4, 32.5)], [(34.8, 31.2), (35.1, 31.2), (35.1, 31.9), (34.8, 31.9)]


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions of every located record."""
    rows = [("belt", BELT, [BELT_HOLE]), ("gaza", GAZA, None), ("west_bank", WEST_BANK, [])]
    regions = spark.createDataFrame([(k, [list(map(float, p)) for p in ring], holes and [[list(map(float, p)) for p in h] for h in holes]) for k, ring, holes in rows], "region_id string, ring array<array<double>>, holes array<array<array<double>>>")
    return regions_of_points(located(table(spark, d, "restrictions")), regions, point_id="id", holes="holes").withColumnRenamed("point_id", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return converted(table(spark, d, "restriction_loads")).filter(~F.col("unit").isin(*BASE)).select("load_row_id", "std_unit", "std_value")


def p4_converted(spark: SparkSession, d: str) -> DataFrame:
    return converted(table(spark, d, "restriction_loads")).select("load_row_id", "std_unit", "std_value")


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    loads = table(spark, d, "restriction_loads")
    return learned_units(loads, materialize(stated(loads), "forms")).select("kind", "slot", "token", "n", "links", "log_scale", "offset", "learned", "worded", "unit")


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_expressions, p2_columns, p3_found, p3_regions, p4_found, p4_converted, p4_units)}

_TRIM = r"'^[\s\x{00a0}\x{202f}]+|[\s\x{00a0}\x{202f}]+$', '', 'g'"
_P2 = rf"""
WITH t AS (
  SELECT load_id, feed_name, load_no, restriction_type,
    nullif(regexp_replace(value_raw, {_TRIM}), '') v, nullif(regexp_replace(review_due_at_raw, {_TRIM}), '') d
  FROM restriction_loads WHERE load_id IS NOT NULL),
u AS (
  SELECT load_id, 'value_raw' column_name, v txt,
    CASE WHEN regexp_full_match(v, '[0-9]+([.,][0-9]+)?') THEN cast(replace(v, ',', '.') AS double) END num,
    restriction_type, restriction_type = 'max_height' typed FROM t
  UNION ALL
  SELECT load_id, 'review_due_at_raw', d,
    CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z')
      THEN cast(epoch(try_cast(replace(replace(d, 'T', ' '), 'Z', '') AS timestamp)) AS double) END,
    restriction_type, true FROM t),
s AS (
  SELECT load_id, column_name, count(*) "rows", count(txt) filled, count(DISTINCT txt) distincts, count(num) readable,
    count(*) FILTER (WHERE num IS NOT NULL AND CASE WHEN column_name = 'value_raw' THEN
        CASE WHEN restriction_type IN ('max_height', 'max_width', 'max_length') THEN NOT (num > 0 AND num <= 50)
             WHEN restriction_type IN ('max_gross_weight', 'max_axle_weight') THEN NOT (num > 0 AND num <= 200) ELSE false END
        ELSE NOT (num >= epoch(timestamp '2015-01-01') AND num < epoch(timestamp '2040-01-01')) END) out_of_range,
    min(num) min_num, max(num) max_num, median(num) FILTER (WHERE typed) median
  FROM u GROUP BY ALL),
m AS (SELECT load_id, column_name, max(n) top_rows FROM (SELECT load_id, column_name, txt, count(txt) n FROM u GROUP BY ALL) GROUP BY ALL),
f AS (SELECT load_id, min(feed_name) feed_name, min(load_no) load_no FROM t GROUP BY ALL),
p AS (SELECT s.*, m.top_rows, f.feed_name, f.load_no FROM s JOIN m USING (load_id, column_name) JOIN f USING (load_id))
"""
_DEPARTS = lambda part, whole: f"abs({part.format('a')}::double / nullif({whole.format('a')}, 0) - {part.format('b')}::double / nullif({whole.format('b')}, 0)) > 0.25"
_SHARES = {
    "null_share": ("({0}.rows - {0}.filled)", "{0}.rows"), "unreadable_share": ("({0}.filled - {0}.readable)", "{0}.filled"),
    "range_share": ("{0}.out_of_range", "{0}.readable"), "distinct_share": ("{0}.distincts", "{0}.filled"), "top_share": ("{0}.top_rows", "{0}.filled"),
}
_P2_PAIRS = ", q AS (SELECT *, lag(load_id) OVER (PARTITION BY feed_name, column_name ORDER BY load_no, load_id) prev FROM p WHERE feed_name IS NOT NULL AND load_no IS NOT NULL) "
_UNITS = {"mm": ("mm", "1"), "cm": ("mm", "10"), "in": ("mm", "25.4"), "ft": ("mm", "304.8"), "yd": ("mm", "914.4"), "kg": ("kg", "1"), "lb": ("kg", "0.45359237"), "short ton": ("kg", "907.18474")}
_WORDS = {
    "mm": "mm|millim|millimetres", "cm": "cm|c\\.m|centimetres|zentimeter", "ft": "ft|feet|foot", "yd": "yd|yards", "m": "m|metres?",
    "kg": "kgs?|kilograms|kilogramm", "lb": "lbs?|pounds", "short ton": "short tons?|sh tn|us tons", "t": "t|tonnes?",
    "in": "in|inch|inches",
}
_CASE = lambda col, wrap: "CASE " + " ".join(f"WHEN regexp_matches({col}, '{wrap.format(w)}') THEN '{u}'" for u, w in _WORDS.items()) + " END"
_P4 = rf"""
WITH t AS (
  SELECT load_row_id, lower(regexp_replace(value_raw, {_TRIM})) v, lower(coalesce(unit_raw, '')) u, lower(coalesce(remark, '')) r
  FROM restriction_loads WHERE restriction_type IN ('max_height', 'max_width', 'max_length', 'max_gross_weight', 'max_axle_weight')),
n AS (
  SELECT load_row_id, u, r, regexp_extract(v, '^([0-9]+)\s*(?:''|’|′|ft|feet)\s*-?\s*([0-9]+)\s*(?:"|”|″|in|inches)$', ['f', 'i']) fi,
    regexp_extract(v, '^([0-9][0-9.,\s\x{{00a0}}\x{{202f}}]*)([^0-9]*)$', ['n', 'u']) x FROM t),
k AS (
  SELECT load_row_id, CASE WHEN fi.f <> '' THEN 'in' ELSE coalesce({_CASE("trim(x.u)", "^({0})\\.?$")}, {_CASE("u", "^({0})\\.?$")}, {_CASE("r", "\\b({0})\\b")}) END unit,
    CASE WHEN fi.f <> '' THEN cast(fi.f AS decimal(18,6)) * 12 + cast(fi.i AS decimal(18,6))
      WHEN regexp_full_match(regexp_replace(x.n, '[\s\x{{00a0}}\x{{202f}}]', '', 'g'), '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN try_cast(replace(regexp_replace(x.n, '[\s\x{{00a0}}\x{{202f}}]', '', 'g'), ',', '') AS decimal(18,6))
      ELSE try_cast(replace(regexp_replace(x.n, '[\s\x{{00a0}}\x{{202f}}]', '', 'g'), ',', '.') AS decimal(18,6)) END num
  FROM n)
SELECT load_row_id, CASE {" ".join(f"WHEN unit = '{u}' THEN '{s}'" for u, (s, f) in _UNITS.items())} END std_unit,
  cast(floor(num * CASE {" ".join(f"WHEN unit = '{u}' THEN cast({f} AS decimal(13,8))" for u, (s, f) in _UNITS.items())} END + 0.5) AS bigint) std_value
FROM k WHERE num > 0 AND unit NOT IN ('m', 't')
"""
_LOCATED = """g AS (SELECT id, geometry.coordinates c FROM restrictions WHERE geometry IS NOT NULL AND id IS NOT NULL),
v AS (SELECT id, c[len(c) // 2 + 1][1] a, c[len(c) // 2 + 1][2] b FROM g),
t AS (SELECT id, a, b, NOT (a BETWEEN 34 AND 36 AND b BETWEEN 29 AND 34) AND b BETWEEN 34 AND 36 AND a BETWEEN 29 AND 34 turned FROM v),
l AS (SELECT DISTINCT id, CASE WHEN turned THEN b ELSE a END x, CASE WHEN turned THEN a ELSE b END y FROM t),
p AS (SELECT * FROM l WHERE NOT (x = 0 AND y = 0))"""


def _crossed(ring: list[tuple[float, float]]) -> str:
    """Whether a ray from (x, y) to the east crosses a ring an odd number of times."""
    edges = zip(ring, [*ring[1:], ring[0]])
    return "(" + " + ".join(f"(({y1} > y) <> ({y2} > y) AND x < {x1} + ({x2} - {x1}) * (y - {y1}) / nullif({y2} - {y1}, 0))::int" for (x1, y1), (x2, y2) in edges) + ") % 2 = 1"


_P3_REGIONS = f"""WITH {_LOCATED}
SELECT id, 'belt' region_id FROM p WHERE x BETWEEN 34.4 AND 35.4 AND y BETWEEN 30.5 AND 32.5 AND NOT (x > 34.8 AND x < 35.1 AND y > 31.2 AND y < 31.9)
UNION SELECT id, 'gaza' FROM p WHERE {_crossed(GAZA)} UNION SELECT id, 'west_bank' FROM p WHERE {_crossed(WEST_BANK)}"""
_P2_COLUMNS = "WITH u AS (" + " UNION ALL ".join(f"SELECT load_id, '{c}' column_name, nullif(regexp_replace({c}, {_TRIM}), '') t FROM restriction_loads" for c in PROFILED) + """)
SELECT load_id, column_name, cast(sum(n) AS bigint) "rows", cast(coalesce(sum(n) FILTER (t IS NULL), 0) AS bigint) nulls, count(t) distincts, min(t) min_text, max(t) max_text, coalesce(max(n) FILTER (t IS NOT NULL), 0) top_rows
FROM (SELECT load_id, column_name, t, count(*) n FROM u GROUP BY ALL) GROUP BY ALL"""
SQL: dict[str, str] = {
    "p2_columns": _P2_COLUMNS,
    "p3_regions": _P3_REGIONS,
    "p2_found": _P2 + _P2_PAIRS + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT a.load_id, a.column_name, '{k}' finding FROM q a JOIN p b ON a.prev = b.load_id AND a.column_name = b.column_name WHERE {_DEPARTS(*v)}" for k, v in _SHARES.items()
    ) + """ UNION ALL SELECT a.load_id, a.column_name, 'median' FROM q a JOIN p b ON a.prev = b.load_id AND a.column_name = b.column_name
      WHERE CASE WHEN a.column_name = 'value_raw' THEN a.median > 2 * b.median OR a.median * 2 < b.median ELSE abs(a.median - b.median) > 365 * 86400 END)""",
    "p2_profile": _P2 + 'SELECT load_id, column_name, "rows", "rows" - filled nulls, distincts, readable, out_of_range, top_rows, min_num, max_num, median FROM p',
    "p3_found": """
WITH g AS (SELECT id, geometry.coordinates c FROM restrictions WHERE geometry IS NOT NULL),
v AS (SELECT id, c[len(c) // 2 + 1][1] a, c[len(c) // 2 + 1][2] b FROM g),
t AS (SELECT id, a, b, NOT (a BETWEEN 34 AND 36 AND b BETWEEN 29 AND 34) AND b BETWEEN 34 AND 36 AND a BETWEEN 29 AND 34 turned FROM v),
l AS (SELECT DISTINCT id, CASE WHEN turned THEN b ELSE a END x, CASE WHEN turned THEN a ELSE b END y FROM t),
p AS (SELECT id, x, y, cast(floor(x * 1000) AS bigint) i, cast(floor(y * 1000) AS bigint) j FROM l WHERE NOT (x = 0 AND y = 0)),
n AS (SELECT id, x, y, i + di i, j + dj j FROM p, (SELECT unnest([-1, 0, 1]) di), (SELECT unnest([-1, 0, 1]) dj))
SELECT DISTINCT p.id id_a, n.id id_b FROM p JOIN n ON p.i = n.i AND p.j = n.j AND p.id < n.id
WHERE 2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(n.y - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(n.y)) * pow(sin(radians(n.x - p.x) / 2), 2))) <= 30
""",
    "p4_found": _P4,
}
