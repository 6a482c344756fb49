"""The queries of the problems tagged llm (1, 5, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.llm.leaks import leaks
from gabarit.llm.linkage import matched
from gabarit.llm.packing import fill, packed
from gabarit.llm.personal import personal_spans, replaced
from gabarit.llm.survivors import survivors
from gabarit.sources.tables import table



def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return matched(table(spark, d, "bridge_features"), table(spark, d, "restrictions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("objectid", "restriction_id")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p6_packed(spark, d), table(spark, d, "pack_sizes"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every pack: all documents are in it, none twice, no container holds more than its capacity, none is divided that fits."""
    packs = table(spark, d, "pack_sizes").select("pack_id", "capacity_tokens").distinct()
    rows = p6_packed(spark, d).join(packs, "pack_id")
    texts = rows.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("pieces"))
    texts = texts.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("divided"), F.count_if(F.col("n") != F.col("pieces")).alias("repeated"))
    full = rows.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.first("capacity_tokens").alias("c")).groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    return texts.join(full, "pack_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("verbatim").select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(table(spark, d, "documents"), table(spark, d, "members"))


def p8_replaced(spark: SparkSession, d: str) -> DataFrame:
    return replaced(table(spark, d, "documents"), table(spark, d, "members"))


FIELDS = {"status": True, "value_source": True, "verified_at": False}


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "restrictions"), table(spark, d, "source_registry"), FIELDS)


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("group_id", "restriction_type", "survivor_id", *[f"{f}_from" for f in FIELDS])


def p5_layers(spark: SparkSession, d: str) -> DataFrame:
    """How many groups take each field from which dominance layer."""
    fields = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_layer").alias("layer")) for f in FIELDS]))
    return _survivors(spark, d).select(fields).groupBy("field_name", "layer").agg(F.count(F.lit(1)).alias("groups"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_from").alias("source_id")) for f in FIELDS]))
    return _survivors(spark, d).select("group_id", pairs).filter("source_id IS NOT NULL")


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p5_found, p5_survivors, p5_layers, p6_packed, p6_fill, p6_invariants, p7_found, p7_paraphrases, p8_found, p8_replaced)}

_P5 = r"""
WITH r AS (SELECT DISTINCT id, restriction_type, regexp_replace(lower(source.reference), '[^a-z0-9]', '', 'g') k, coalesce(s.trust_rank, 2147483647) trust, updated_at,
    status, value_source, verified_at FROM restrictions LEFT JOIN source_registry s ON source.name = s.source_name WHERE source.reference IS NOT NULL),
g AS (SELECT *, min(id) OVER w group_id, max(id) OVER w hi FROM r WHERE k <> '' WINDOW w AS (PARTITION BY restriction_type, k)),
u AS (SELECT group_id, 'status' field_name, id, trust, updated_at FROM g WHERE group_id < hi AND lower(trim(status)) NOT IN ('', 'unknown')
  UNION ALL SELECT group_id, 'value_source', id, trust, updated_at FROM g WHERE group_id < hi AND lower(trim(value_source)) NOT IN ('', 'unknown')
  UNION ALL SELECT group_id, 'verified_at', id, trust, updated_at FROM g WHERE group_id < hi AND verified_at IS NOT NULL)
SELECT group_id, field_name, id source_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust, updated_at DESC NULLS LAST, id) n FROM u) WHERE n = 1
"""
_P5_ALL = (
    _P5[: _P5.index("SELECT group_id, field_name, id source_id")]
    + """, o AS (SELECT group_id, restriction_type, id, row_number() OVER (PARTITION BY group_id, restriction_type ORDER BY trust, updated_at DESC NULLS LAST, id) n, count(*) OVER (PARTITION BY group_id, restriction_type) c FROM g WHERE group_id < hi),
f AS (SELECT group_id, field_name, id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust, updated_at DESC NULLS LAST, id) n FROM u) WHERE n = 1),
p AS (SELECT group_id, max(id) FILTER (field_name = 'status') s, max(id) FILTER (field_name = 'value_source') v, max(id) FILTER (field_name = 'verified_at') w FROM f GROUP BY group_id)
SELECT o.group_id, o.restriction_type, o.id survivor_id, p.s status_from, p.v value_source_from, p.w verified_at_from FROM o LEFT JOIN p USING (group_id) WHERE o.n = 1"""
)
_GRAMS = "SELECT DISTINCT {0}, array_to_string(list_slice(w, i, i + 11), ' ') g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) i FROM (SELECT {0}, regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{Nd}}]+') w FROM {2} WHERE {1} IS NOT NULL) WHERE len(w) >= 12)"
_P7 = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format('doc_id', 'text', 'documents')}) JOIN ({_GRAMS.format('item_id', 'passage', 'eval_items')}) USING (g)"
_P6 = "SELECT pack_id, count(DISTINCT doc_id) documents, 0 divided, 0 repeated, 0 overfull FROM documents, (SELECT DISTINCT pack_id FROM pack_sizes) GROUP BY pack_id"
SQL: dict[str, str] = {"p5_found": _P5, "p5_survivors": _P5_ALL, "p6_invariants": _P6, "p7_found": _P7}
