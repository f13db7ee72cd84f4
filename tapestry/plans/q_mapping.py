"""Registered queries for the mapping-documentation operators (B9-B14, C6-C9,
D11-D12, E10-E17, G4, H1, I16, N, P, A8-A11), bound to mapping sets that Spark
derives from the ``part``, ``labels`` and ``conversations`` tables.

Mapping set "a" (code analysis) and "b" (legacy extraction) both key on
(source_table, source_column) = (brand, type); their rules and targets agree,
partly agree or disagree depending on the part size, and each has keys the
other lacks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.functions.names import clean_column, clean_field, clean_rule, clean_table, is_column_name, output_name
from tapestry.functions.text import confidence_band, similarity_native
from tapestry.operators.reconcile import (KEY, classify_matches, last_per_key, only_in, reconcile, reconcile_summary,
                                          resolve, score, union_methods)
from tapestry.operators.chunks import join_text_chunks, sources_of_chunks
from tapestry.operators.review import (apply_updates, close_session, confidence_summary, export_review, extract_counts,
                                       review_queue, rule_kinds, session_results, session_totals,
                                       session_view, standardize, store_report, to_document, to_standard, top_n,
                                       with_defaults)
from tapestry.plans.queries import T, register
from tapestry.session import ensure_checkpoint_dir
from tapestry.sources.sinks import save_partitioned

MAPPING_FIELDS = ["id", "source_table", "source_column", "transformation_rule", "target_field", "array_field",
                  "confidence_score", "needs_review"]


def mapping_a(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("source_table"),
        F.when(F.col("p_retailprice") > 990, F.concat(F.col("p_type"), F.lit("_NEW"))).otherwise(F.col("p_type")).alias("source_column"),
        F.col("p_name").alias("transformation_rule"),
        F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("target_field"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("arr_"), F.lower("p_type"))).alias("array_field"),
        (F.col("p_retailprice") / 2100.0).alias("confidence_score"),
        (F.col("p_size") < 10).alias("needs_review"),
    )


def mapping_b(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "part")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("source_table"),
        F.when(s > 45, F.concat(F.col("p_type"), F.lit("_LEGACY"))).otherwise(F.col("p_type")).alias("source_column"),
        F.when(s <= 20, F.col("p_name"))
        .when(s <= 35, F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")))
        .otherwise(F.concat(F.lit('when(col("'), F.col("p_type"), F.lit('"))'))).alias("transformation_rule"),
        F.when(s <= 30, F.concat(F.lit("size_"), s.cast("string"))).otherwise(F.concat(F.lit("sz"), s.cast("string"))).alias("target_field"),
        F.lit(None).cast("string").alias("array_field"),
        F.lit(0.7).alias("confidence_score"),
        F.lit(True).alias("needs_review"),
    )


MAPPING_A_SQL = """
a AS (SELECT p_partkey AS id, p_brand AS source_table,
  CASE WHEN p_retailprice > 990 THEN p_type || '_NEW' ELSE p_type END AS source_column,
  p_name AS transformation_rule, 'size_' || p_size::VARCHAR AS target_field,
  CASE WHEN p_size > 40 THEN 'arr_' || lower(p_type) END AS array_field,
  p_retailprice / 2100.0 AS confidence_score, p_size < 10 AS needs_review FROM part)"""
MAPPING_B_SQL = """
b AS (SELECT p_partkey AS id, p_brand AS source_table,
  CASE WHEN p_size > 45 THEN p_type || '_LEGACY' ELSE p_type END AS source_column,
  CASE WHEN p_size <= 20 THEN p_name WHEN p_size <= 35 THEN p_name || ' ' || lower(p_type)
       ELSE 'when(col("' || p_type || '"))' END AS transformation_rule,
  CASE WHEN p_size <= 30 THEN 'size_' || p_size::VARCHAR ELSE 'sz' || p_size::VARCHAR END AS target_field,
  NULL::VARCHAR AS array_field, 0.7 AS confidence_score, true AS needs_review FROM part)"""
LAST_SQL = """
al AS (SELECT source_table, source_column, arg_max_null(id, id) AS id, arg_max_null(transformation_rule, id) AS transformation_rule,
  arg_max_null(target_field, id) AS target_field, arg_max_null(array_field, id) AS array_field,
  arg_max_null(confidence_score, id) AS confidence_score, arg_max_null(needs_review, id) AS needs_review FROM a GROUP BY ALL),
bl AS (SELECT source_table, source_column, arg_max_null(id, id) AS id, arg_max_null(transformation_rule, id) AS transformation_rule,
  arg_max_null(target_field, id) AS target_field, arg_max_null(array_field, id) AS array_field,
  arg_max_null(confidence_score, id) AS confidence_score, arg_max_null(needs_review, id) AS needs_review FROM b GROUP BY ALL)"""
WITH_AB = "WITH " + MAPPING_A_SQL + "," + MAPPING_B_SQL + "," + LAST_SQL


def latest_sets(spark, d):
    return last_per_key(mapping_a(spark, d), list(KEY), "id"), last_per_key(mapping_b(spark, d), list(KEY), "id")


# similarity in SQL (native form): 1 - levenshtein / longest, two empty texts -> 1
def _sim_sql(x: str, y: str) -> str:
    return (f"(CASE WHEN greatest(length(coalesce({x},'')), length(coalesce({y},''))) = 0 THEN 1.0 ELSE "
            f"1.0 - levenshtein(coalesce({x},''), coalesce({y},'')) / greatest(length(coalesce({x},'')), length(coalesce({y},''))) END)")


CLASSIFIED_SQL = WITH_AB + f""",
r AS (SELECT coalesce(al.source_table, bl.source_table) AS source_table, coalesce(al.source_column, bl.source_column) AS source_column,
  al.id AS a_id, bl.id AS b_id, al.transformation_rule AS a_rule, bl.transformation_rule AS b_rule,
  al.target_field AS a_target, bl.target_field AS b_target, al.array_field AS a_array, bl.array_field AS b_array,
  al.confidence_score AS a_score, al.needs_review AS a_review,
  CASE WHEN al.id IS NOT NULL AND bl.id IS NOT NULL THEN
    0.7 * {_sim_sql('al.transformation_rule', 'bl.transformation_rule')} + 0.3 * {_sim_sql('al.target_field', 'bl.target_field')}
  END AS similarity
  FROM al FULL OUTER JOIN bl ON al.source_table = bl.source_table AND al.source_column = bl.source_column),
c AS (SELECT *, CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL AND similarity > 0.9 THEN 'exact'
  WHEN a_id IS NOT NULL AND b_id IS NOT NULL AND similarity > 0.5 THEN 'partial'
  WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN 'conflict' WHEN a_id IS NOT NULL THEN 'code_only' ELSE 'legacy_only' END AS match_class
  FROM r)"""


def classified(spark, d, method="levenshtein"):
    a, b = latest_sets(spark, d)
    return classify_matches(reconcile(a, b), method=method)


# ------------------------------------------------------------------ D11, D12, N1
@register("reconcile_full", WITH_AB + """
SELECT coalesce(al.source_table, bl.source_table) AS source_table, coalesce(al.source_column, bl.source_column) AS source_column,
  al.id::VARCHAR AS a_id, bl.id::VARCHAR AS b_id, al.transformation_rule AS a_rule, bl.transformation_rule AS b_rule
FROM al FULL OUTER JOIN bl ON al.source_table = bl.source_table AND al.source_column = bl.source_column
""")
def q_reconcile_full(spark, d):
    a, b = latest_sets(spark, d)
    r = reconcile(a, b)
    return r.select("source_table", "source_column", F.col("a.id").cast("string").alias("a_id"),
                    F.col("b.id").cast("string").alias("b_id"),
                    F.col("a.transformation_rule").alias("a_rule"), F.col("b.transformation_rule").alias("b_rule"))


@register("reconcile_only_a", WITH_AB + """
SELECT id, source_table, source_column FROM al WHERE NOT EXISTS
  (SELECT 1 FROM bl WHERE bl.source_table = al.source_table AND bl.source_column = al.source_column)
""")
def q_reconcile_only_a(spark, d):
    a, b = latest_sets(spark, d)
    return only_in(a, b).select("id", "source_table", "source_column")


@register("reconcile_only_b", WITH_AB + """
SELECT id, source_table, source_column FROM bl WHERE NOT EXISTS
  (SELECT 1 FROM al WHERE bl.source_table = al.source_table AND bl.source_column = al.source_column)
""")
def q_reconcile_only_b(spark, d):
    a, b = latest_sets(spark, d)
    return only_in(b, a).select("id", "source_table", "source_column")


@register("classify_matches", CLASSIFIED_SQL + """
SELECT source_table, source_column, a_id::VARCHAR AS a_id, b_id::VARCHAR AS b_id, similarity, match_class FROM c
""")
def q_classify_matches(spark, d):
    c = classified(spark, d)
    return c.select("source_table", "source_column", F.col("a.id").cast("string").alias("a_id"),
                    F.col("b.id").cast("string").alias("b_id"), "similarity", "match_class")


@register("similarity_native", WITH_AB + f"""
SELECT al.source_table, al.source_column, {_sim_sql('al.transformation_rule', 'bl.transformation_rule')} AS rule_similarity,
  {_sim_sql('al.target_field', 'bl.target_field')} AS target_similarity
FROM al JOIN bl ON al.source_table = bl.source_table AND al.source_column = bl.source_column
""")
def q_similarity_native(spark, d):
    a, b = latest_sets(spark, d)
    j = a.alias("x").join(b.alias("y"), list(KEY))
    return j.select("source_table", "source_column",
                    similarity_native(F.col("x.transformation_rule"), F.col("y.transformation_rule")).alias("rule_similarity"),
                    similarity_native(F.col("x.target_field"), F.col("y.target_field")).alias("target_similarity"))


RESOLVE_FIELDS = ["id", "source_table", "source_column", "transformation_rule", "target_field", "array_field",
                  "confidence_score", "needs_review"]

_RESOLVED_SQL = CLASSIFIED_SQL + """,
v AS (SELECT source_table, source_column,
  CASE WHEN match_class = 'legacy_only' THEN b_id ELSE a_id END AS id,
  CASE WHEN match_class = 'legacy_only' THEN b_rule ELSE a_rule END AS transformation_rule,
  CASE WHEN match_class = 'legacy_only' THEN b_target ELSE a_target END AS target_field,
  CASE WHEN match_class = 'legacy_only' THEN b_array ELSE a_array END AS array_field,
  CASE match_class WHEN 'exact' THEN {exact}
    WHEN 'partial' THEN greatest(coalesce(a_score, 0.5) - 0.2, 0.1) WHEN 'conflict' THEN 0.4
    WHEN 'code_only' THEN a_score ELSE 0.3 END AS confidence_score,
  match_class NOT IN ('exact', 'code_only') AS needs_review, match_class,
  CASE match_class WHEN 'exact' THEN '{exact_reason}'
    WHEN 'partial' THEN 'Fallback: Partial match, preferred code analysis'
    WHEN 'conflict' THEN 'Fallback: Conflict resolved by preferring code analysis'
    WHEN 'code_only' THEN 'Fallback: Code analysis only' ELSE 'Fallback: Legacy only (lower accuracy expected)' END
    AS validation_reasoning,
  CASE WHEN match_class IN ('exact', 'partial', 'conflict') THEN 'code_analysis;legacy'
       WHEN match_class = 'code_only' THEN 'code_analysis' ELSE 'legacy' END AS sources_used,
  CASE WHEN match_class = 'legacy_only' THEN 'legacy' ELSE 'code_analysis' END AS extraction_source
  FROM c)"""
RESOLVED_SQL = _RESOLVED_SQL.format(exact="a_score", exact_reason="Fallback: Exact match validation")
RESOLVED_BOOST_SQL = _RESOLVED_SQL.format(exact="least(coalesce(a_score, 0.8) + 0.1, 1.0)",
                                          exact_reason="Exact match between both agents")


def _resolved(spark, d, boost=False):
    return resolve(classified(spark, d), RESOLVE_FIELDS, boost_exact=boost)


def _resolved_out(r):
    return r.select("source_table", "source_column", "id", "transformation_rule", "target_field", "array_field",
                    "confidence_score", "needs_review", "match_class", "validation_reasoning",
                    F.array_join("sources_used", ";").alias("sources_used"), "extraction_source")


@register("resolve_matches", RESOLVED_SQL + " SELECT * FROM v")
def q_resolve_matches(spark, d):
    return _resolved_out(_resolved(spark, d))


@register("resolve_matches_boost", RESOLVED_BOOST_SQL + " SELECT * FROM v")
def q_resolve_matches_boost(spark, d):
    return _resolved_out(_resolved(spark, d, boost=True))


SCORED_SQL = RESOLVED_SQL + """,
s AS (SELECT *, greatest(least(coalesce(confidence_score, 0.5) + (0.0
    + CASE WHEN length(coalesce(transformation_rule, '')) > 10 AND (lower(coalesce(transformation_rule, '')) LIKE '%when(%'
           OR lower(coalesce(transformation_rule, '')) LIKE '%col(%') THEN 0.1 ELSE 0.0 END
    + CASE WHEN coalesce(source_table, 'unknown') <> 'unknown' AND coalesce(source_column, 'unknown') <> 'unknown' THEN 0.1 ELSE 0.0 END
    - CASE WHEN coalesce(needs_review, false) THEN 0.1 ELSE 0.0 END), 1.0), 0.1) AS final_score FROM v)"""


@register("score_confidence", SCORED_SQL + """
SELECT source_table, source_column, id, final_score AS confidence_score,
  CASE WHEN final_score < 0.6 THEN true ELSE coalesce(needs_review, false) END AS needs_review FROM s
""")
def q_score_confidence(spark, d):
    s = score(_resolved(spark, d))
    return s.select("source_table", "source_column", "id", "confidence_score", "needs_review")


@register("reconcile_summary", CLASSIFIED_SQL + """
SELECT (SELECT count(*) FROM a)::BIGINT AS code_mappings, (SELECT count(*) FROM b)::BIGINT AS legacy_mappings,
  ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - (SELECT count(*) FROM al) - (SELECT count(*) FROM bl))::BIGINT AS duplicates,
  count(*) AS final_mappings, count(*) FILTER (WHERE match_class = 'conflict') AS conflicts,
  count(*) FILTER (WHERE match_class = 'code_only') AS new_mappings,
  count(*) FILTER (WHERE match_class = 'exact') AS exact_matches,
  count(*) FILTER (WHERE match_class = 'partial') AS partial_matches,
  count(*) FILTER (WHERE match_class = 'legacy_only') AS legacy_only FROM c
""")
def q_reconcile_summary(spark, d):
    a, b = latest_sets(spark, d)
    return reconcile_summary(mapping_a(spark, d), mapping_b(spark, d), classify_matches(reconcile(a, b)))


@register("top_conflicts", CLASSIFIED_SQL + """
SELECT source_table, source_column, similarity FROM c WHERE match_class = 'conflict'
ORDER BY similarity, source_table, source_column LIMIT 10
""")
def q_top_conflicts(spark, d):
    """The ten lowest-similarity conflicts (a top-k report; the limit is the
    feature).  A deterministic order replaces the source's unordered 'first N'."""
    c = classified(spark, d).filter(F.col("match_class") == "conflict")
    return top_n(c, 10, "similarity", "source_table", "source_column").select("source_table", "source_column", "similarity")


@register("confidence_summary", SCORED_SQL + """
SELECT extraction_source, count(*) AS total_mappings,
  count(*) FILTER (WHERE coalesce(final_score, 0.0) >= 0.8) AS high_confidence_count,
  count(*) FILTER (WHERE coalesce(final_score, 0.0) >= 0.5 AND coalesce(final_score, 0.0) < 0.8) AS medium_confidence_count,
  count(*) FILTER (WHERE coalesce(final_score, 0.0) < 0.5) AS low_confidence_count,
  round(avg(coalesce(final_score, 0.0)), 9) AS average_confidence,
  count(*) FILTER (WHERE length(coalesce(transformation_rule, '')) > 50) AS complex_transformations,
  count(*) FILTER (WHERE CASE WHEN final_score < 0.6 THEN true ELSE coalesce(needs_review, false) END) AS review_required_count
FROM s GROUP BY extraction_source
""")
def q_confidence_summary(spark, d):
    out = confidence_summary(score(_resolved(spark, d)), keys=["extraction_source"])
    # the mean is rounded: the two engines sum in different orders
    return out.withColumn("average_confidence", F.round("average_confidence", 9))


# ------------------------------------------------------------------ B9-B14, C8, C9
def _messy(spark, d):
    p = T(spark, d, "part")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(s < 3, None).when(s > 47, "unknown").when(s == 47, "   ")
        .otherwise(F.concat(F.lit("  "), F.col("p_brand"), F.lit("_DF"), F.when(s > 25, F.lit("_df")).otherwise(F.lit("")), F.lit(" ")))
        .alias("source_table"),
        F.when(s <= 10, F.concat(F.lit('"'), F.col("p_type"), F.lit('"')))
        .when(s <= 20, F.concat(F.lit(" '"), F.col("p_type"), F.lit("'")))
        .when(s <= 25, F.concat(F.lit('"'), F.col("p_type"), F.lit("'")))
        .when(s == 26, F.lit('"'))
        .when(s > 48, F.lit("")).otherwise(F.col("p_type")).alias("source_column"),
        F.when(s > 45, None).otherwise(F.concat(F.lit(" F.col(\"x\") + pyspark.sql.functions.lit("), F.col("p_name"),
                                                F.lit(") + F.trim(F.upper(c)) "))).alias("transformation_rule"),
        F.when(s < 5, None).otherwise(F.concat(F.lit("\t"), F.col("p_name"), F.lit(" \n"))).alias("target_field"),
        F.when(s > 40, F.lit("arr")).alias("array_field"),
        F.when(s > 30, None).otherwise(F.col("p_retailprice") / 2100.0).alias("confidence_score"),
        F.when(s > 35, None).otherwise(s < 15).alias("needs_review"),
    )


MESSY_SQL = r"""
m AS (SELECT p_partkey AS id,
  CASE WHEN p_size < 3 THEN NULL WHEN p_size > 47 THEN 'unknown' WHEN p_size = 47 THEN '   '
       ELSE '  ' || p_brand || '_DF' || CASE WHEN p_size > 25 THEN '_df' ELSE '' END || ' ' END AS source_table,
  CASE WHEN p_size <= 10 THEN '"' || p_type || '"' WHEN p_size <= 20 THEN ' ''' || p_type || ''''
       WHEN p_size <= 25 THEN '"' || p_type || '''' WHEN p_size = 26 THEN '"' WHEN p_size > 48 THEN '' ELSE p_type END AS source_column,
  CASE WHEN p_size > 45 THEN NULL ELSE ' F.col("x") + pyspark.sql.functions.lit(' || p_name || ') + F.trim(F.upper(c)) ' END
    AS transformation_rule,
  CASE WHEN p_size < 5 THEN NULL ELSE chr(9) || p_name || ' ' || chr(10) END AS target_field,
  CASE WHEN p_size > 40 THEN 'arr' END AS array_field,
  CASE WHEN p_size > 30 THEN NULL ELSE p_retailprice / 2100.0 END AS confidence_score,
  CASE WHEN p_size > 35 THEN NULL ELSE p_size < 15 END AS needs_review FROM part)"""


SQL_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x):
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


CLEAN_SQL = f"""
cl AS (SELECT id,
  CASE WHEN source_table IS NULL OR source_table = '' OR source_table = 'unknown' THEN 'unknown'
       ELSE regexp_replace(lower({_strip('source_table')}), '_df$', '') END AS source_table,
  CASE WHEN source_column IS NULL OR source_column = '' OR source_column = 'unknown' THEN 'unknown'
       WHEN ({_strip('source_column')} LIKE '"%' AND {_strip('source_column')} LIKE '%"')
         OR ({_strip('source_column')} LIKE '''%' AND {_strip('source_column')} LIKE '%''')
       THEN CASE WHEN length({_strip('source_column')}) >= 2
                 THEN substring({_strip('source_column')}, 2, length({_strip('source_column')}) - 2) ELSE '' END
       ELSE {_strip('source_column')} END AS source_column,
  CASE WHEN transformation_rule IS NULL OR transformation_rule = '' THEN ''
       ELSE replace(replace({_strip('transformation_rule')}, 'F.', ''), 'pyspark.sql.functions.', '') END AS transformation_rule,
  CASE WHEN target_field IS NULL OR target_field = '' THEN '' ELSE {_strip('target_field')} END AS target_field,
  array_field, coalesce(confidence_score, 0.5) AS confidence_score, coalesce(needs_review, true) AS needs_review,
  'Standardized using fallback method' AS final_notes FROM m)"""


@register("clean_names", "WITH " + MESSY_SQL + "," + CLEAN_SQL + " SELECT id, source_table, source_column, target_field FROM cl")
def q_clean_names(spark, d):
    m = _messy(spark, d)
    return m.select("id", clean_table("source_table").alias("source_table"), clean_column("source_column").alias("source_column"),
                    clean_field("target_field").alias("target_field"))


@register("clean_rules", "WITH " + MESSY_SQL + "," + CLEAN_SQL + " SELECT id, transformation_rule FROM cl")
def q_clean_rules(spark, d):
    return _messy(spark, d).select("id", clean_rule("transformation_rule").alias("transformation_rule"))


@register("standardize_mappings", "WITH " + MESSY_SQL + "," + CLEAN_SQL + " SELECT * EXCLUDE (id) FROM cl")
def q_standardize_mappings(spark, d):
    return standardize(_messy(spark, d))


@register("review_queue", "WITH " + MESSY_SQL + "," + CLEAN_SQL + " SELECT * EXCLUDE (id) FROM cl WHERE needs_review")
def q_review_queue(spark, d):
    return review_queue(standardize(_messy(spark, d)))


@register("confidence_band", "WITH " + MAPPING_A_SQL + """
SELECT id, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium'
  WHEN confidence_score IS NOT NULL THEN 'low' END AS band FROM a
""")
def q_confidence_band(spark, d):
    return mapping_a(spark, d).select("id", confidence_band("confidence_score").alias("band"))


@register("valid_names", r"""
WITH t AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_brand || ' ' || lower(p_type) || ' ' || p_type ||
  ' col yyyy-MM-dd isNull a-b _x1 9lives', ' ')) AS token FROM part)
SELECT token, token <> '' AND token NOT IN ('alias', 'isNull', 'isNotNull', 'isin', 'otherwise', 'when', 'between',
    'startswith', 'endswith', 'contains', 'cast', 'substr', 'rlike', 'like', 'over', 'desc', 'asc', 'asc_nulls_first',
    'asc_nulls_last', 'desc_nulls_first', 'desc_nulls_last', 'getItem', 'coalesce', 'substring', 'upper', 'lower', 'trim',
    'ltrim', 'rtrim', 'regexp_replace', 'regexp_extract', 'concat', 'concat_ws', 'collect_set', 'length', 'date_format',
    'to_date', 'to_timestamp', 'from_unixtime', 'unix_timestamp', 'nvl', 'ifnull', 'explode', 'explode_outer', 'posexplode',
    'posexplode_outer', 'element_at', 'array', 'struct', 'yyyy-MM-dd', 'MM-dd-yyyy', 'dd-MM-yyyy', 'yyyyMMdd')
  AND NOT regexp_matches(token, '[-:<>/\\|&=+*^%$#@!~`]')
  AND regexp_matches(token, '^[\p{L}_][\p{L}\p{N}_]*$') AS is_column_name
FROM t
""")
def q_valid_names(spark, d):
    p = T(spark, d, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type"), "p_type", F.lit("col yyyy-MM-dd isNull a-b _x1 9lives"))
    t = p.select(F.explode(F.split(text, " ")).alias("token")).distinct()
    return t.select("token", is_column_name("token").alias("is_column_name"))


RAW_SQL = """
raw AS (SELECT p_partkey AS id,
  CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS target_column,
  CASE WHEN p_size < 5 THEN NULL ELSE 'col("' || p_type || '")' END AS transformation,
  CASE WHEN p_size BETWEEN 10 AND 20 THEN NULL ELSE p_brand END AS source_table,
  CASE WHEN p_size BETWEEN 15 AND 25 THEN NULL ELSE lower(p_type) END AS source_column,
  '.withColumn("' || p_name || '", ...)' AS source_line FROM part)"""


def _raw(spark, d):
    p = T(spark, d, "part")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(s > 45, None).otherwise(F.col("p_name")).alias("target_column"),
        F.when(s < 5, None).otherwise(F.concat(F.lit('col("'), F.col("p_type"), F.lit('")'))).alias("transformation"),
        F.when(s.between(10, 20), None).otherwise(F.col("p_brand")).alias("source_table"),
        F.when(s.between(15, 25), None).otherwise(F.lower("p_type")).alias("source_column"),
        F.concat(F.lit('.withColumn("'), F.col("p_name"), F.lit('", ...)')).alias("source_line"),
    )


STANDARD_SQL = """
st AS (
  SELECT id, coalesce(source_table, 'unknown') AS source_table, coalesce(source_column, 'unknown') AS source_column,
    coalesce(transformation, '') AS transformation_rule, coalesce(target_column, '') AS target_field, '' AS array_field,
    0.6 AS confidence_score, true AS needs_review, 'Extracted via AST parsing - needs validation' AS reasoning,
    source_line AS code_location, 'ast' AS extraction_method FROM raw
  UNION ALL
  SELECT id, 'unknown', coalesce(target_column, 'unknown'), coalesce(transformation, ''), coalesce(target_column, ''), '',
    0.5, true, 'Extracted via pattern matching - needs validation', source_line, 'pattern_matching' FROM raw
  UNION ALL
  SELECT id, coalesce(source_table, 'unknown'), coalesce(source_column, 'unknown'), coalesce(transformation, ''),
    coalesce(target_column, ''), '', 0.7, true, 'Extracted using legacy extractor', source_line, 'legacy' FROM raw)"""


@register("to_standard", "WITH " + RAW_SQL + "," + STANDARD_SQL + " SELECT * EXCLUDE (id) FROM st")
def q_to_standard(spark, d):
    raw = _raw(spark, d)
    out = None
    for m in ("ast", "pattern_matching", "legacy"):
        f = to_standard(raw, m)
        out = f if out is None else out.unionByName(f)
    return out


@register("union_methods", "WITH " + RAW_SQL + "," + STANDARD_SQL + """
SELECT source_table, source_column, transformation_rule, target_field, confidence_score, extraction_method,
  CASE WHEN extraction_method = 'ast' THEN reasoning END AS reasoning,
  CASE WHEN extraction_method = 'legacy' THEN code_location END AS code_location
FROM st WHERE extraction_method IN ('ast', 'legacy')
""")
def q_union_methods(spark, d):
    raw = _raw(spark, d)
    common = ["source_table", "source_column", "transformation_rule", "target_field", "confidence_score", "extraction_method"]
    ast = to_standard(raw, "ast").select(*common, "reasoning")
    legacy = to_standard(raw, "legacy").select(*common, "code_location")
    return union_methods(ast, legacy)


@register("extract_counts", "WITH " + RAW_SQL + "," + STANDARD_SQL + """
SELECT extraction_method, count(*) AS n FROM st GROUP BY extraction_method
""")
def q_extract_counts(spark, d):
    raw = _raw(spark, d)
    out = None
    for m in ("ast", "pattern_matching", "legacy"):
        f = to_standard(raw, m)
        out = f if out is None else out.unionByName(f)
    return extract_counts(out)


@register("rule_kinds", WITH_AB + """
SELECT CASE WHEN lower(r) LIKE '%concat(%' THEN 'concatenation' WHEN lower(r) LIKE '%when(%' THEN 'conditional'
  WHEN lower(r) LIKE '%coalesce(%' THEN 'coalesce' WHEN lower(r) LIKE '%lit(%' THEN 'literal'
  WHEN length(r) > 100 OR r LIKE '%(%' THEN 'complex' ELSE 'simple_mapping' END AS kind, count(*) AS n
FROM (SELECT transformation_rule AS r FROM a UNION ALL SELECT transformation_rule FROM b
      UNION ALL SELECT 'concat(' || transformation_rule || ')' FROM a WHERE needs_review
      UNION ALL SELECT 'coalesce(' || source_column || ', lit(0))' FROM b) GROUP BY 1
""")
def q_rule_kinds(spark, d):
    a, b = mapping_a(spark, d), mapping_b(spark, d)
    rules = (a.select("transformation_rule")
             .unionByName(b.select("transformation_rule"))
             .unionByName(a.filter("needs_review").select(F.concat(F.lit("concat("), F.col("transformation_rule"), F.lit(")")).alias("transformation_rule")))
             .unionByName(b.select(F.concat(F.lit("coalesce("), F.col("source_column"), F.lit(", lit(0))")).alias("transformation_rule"))))
    return rule_kinds(rules)


@register("store_report", "WITH " + MESSY_SQL + """
SELECT count(*) FILTER (WHERE ok) AS stored_count, count(*) FILTER (WHERE NOT ok) AS error_count, count(*) AS total_attempted,
  coalesce(count(*) FILTER (WHERE ok)::DOUBLE / NULLIF(count(*), 0)::DOUBLE, 0.0) AS success_rate
FROM (SELECT source_table IS NOT NULL AND source_column IS NOT NULL AND transformation_rule IS NOT NULL
        AND target_field IS NOT NULL AS ok FROM m)
""")
def q_store_report(spark, d):
    m = _messy(spark, d)
    ok = (F.col("source_table").isNotNull() & F.col("source_column").isNotNull() & F.col("transformation_rule").isNotNull()
          & F.col("target_field").isNotNull())
    return store_report(m.withColumn("stored", ok))


#: Values of a chunk in the registered queries: their rows grow with the data.
CHUNK = 100


@register("sources_of", WITH_AB + f"""
, m AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT target_field, chunk, array_to_string(list(source_column ORDER BY source_column), ', ') AS source_columns FROM (
  SELECT target_field, source_column, ((row_number() OVER (PARTITION BY target_field ORDER BY source_column) - 1) // {CHUNK})::INTEGER AS chunk
  FROM (SELECT DISTINCT target_field, source_column FROM m WHERE source_column IS NOT NULL)) GROUP BY ALL),
t AS (SELECT target_field, chunk, array_to_string(list(source_table ORDER BY source_table), ', ') AS source_tables FROM (
  SELECT target_field, source_table, ((row_number() OVER (PARTITION BY target_field ORDER BY source_table) - 1) // {CHUNK})::INTEGER AS chunk
  FROM (SELECT DISTINCT target_field, source_table FROM m WHERE source_table IS NOT NULL)) GROUP BY ALL)
SELECT target_field, chunk, coalesce(source_columns, '') AS source_columns, coalesce(source_tables, '') AS source_tables
FROM c FULL JOIN t USING (target_field, chunk)
""")
def q_sources_of(spark, d):
    return sources_of_chunks(mapping_a(spark, d).unionByName(mapping_b(spark, d)), size=CHUNK)


@register("join_text", WITH_AB + f"""
SELECT target_field, chunk, string_agg(transformation_rule, '; ' ORDER BY id) AS rules FROM (
  SELECT *, ((row_number() OVER (PARTITION BY target_field ORDER BY id) - 1) // {CHUNK})::INTEGER AS chunk FROM a) GROUP BY target_field, chunk
""")
def q_join_text(spark, d):
    return join_text_chunks(mapping_a(spark, d), "target_field", "transformation_rule", order="id", size=CHUNK)


# ------------------------------------------------------------------ A8, A9, A11, C7, P
RESULTS_SQL = """
res AS (SELECT p_partkey AS id, p_size AS session_id, p_brand AS source_table, lower(p_type) AS source_column,
  p_name AS transformation_rule, 'size_' || p_size::VARCHAR AS target_field,
  CASE WHEN p_size > 40 THEN 'arr' END AS array_field, p_retailprice / 2100.0 AS confidence_score,
  p_size < 10 AS needs_review, 'note ' || p_type AS agent_notes,
  CASE WHEN p_size > 30 THEN 'user ' || p_partkey::VARCHAR END AS user_notes FROM part)"""


def results(spark, d):
    p = T(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("session_id"), F.col("p_brand").alias("source_table"),
        F.lower("p_type").alias("source_column"), F.col("p_name").alias("transformation_rule"),
        F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("target_field"),
        F.when(F.col("p_size") > 40, F.lit("arr")).alias("array_field"),
        (F.col("p_retailprice") / 2100.0).alias("confidence_score"), (F.col("p_size") < 10).alias("needs_review"),
        F.concat(F.lit("note "), F.col("p_type")).alias("agent_notes"),
        F.when(F.col("p_size") > 30, F.concat(F.lit("user "), F.col("p_partkey").cast("string"))).alias("user_notes"),
    )


@register("session_results", "WITH " + RESULTS_SQL + " SELECT id, source_table, transformation_rule FROM res WHERE session_id = 7")
def q_session_results(spark, d):
    return session_results(results(spark, d), 7).select("id", "source_table", "transformation_rule")


@register("export_review", "WITH " + RESULTS_SQL + """
SELECT source_table AS "Source Table", source_column AS "Source Column", transformation_rule AS "Transformation / Mapping Rules",
  target_field AS "Field", array_field AS "Array Field", confidence_score AS "Confidence Score", needs_review AS "Needs Review",
  agent_notes AS "Agent Notes", coalesce(user_notes, '') AS "User Notes" FROM res WHERE session_id = 42
""")
def q_export_review(spark, d):
    return export_review(results(spark, d), 42)


@register("to_document", "WITH " + RESULTS_SQL + """
SELECT source_table AS "Source Table", source_column AS "Source Column", transformation_rule AS "Transformation / Mapping Rules",
  target_field AS "Field", coalesce(array_field, '') AS "Array Field" FROM res
""")
def q_to_document(spark, d):
    return to_document(results(spark, d))


@register("session_totals", "WITH " + RESULTS_SQL + """
SELECT session_id, count(*) AS total_mappings, count(*) FILTER (WHERE coalesce(confidence_score, 0.0) >= 0.8) AS high_confidence_count,
  count(*) FILTER (WHERE coalesce(needs_review, false)) AS needs_review_count FROM res GROUP BY session_id
""")
def q_session_totals(spark, d):
    return session_totals(results(spark, d))


@register("apply_updates", "WITH " + RESULTS_SQL + """,
u AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'reviewed_' || doc_id::VARCHAR END AS transformation_rule,
  toxic = 1 AS needs_review, CASE WHEN toxic = 1 THEN 'toxic' END AS user_notes FROM labels)
SELECT r.id, coalesce(u.transformation_rule, r.transformation_rule) AS transformation_rule,
  coalesce(u.needs_review, r.needs_review) AS needs_review, coalesce(u.user_notes, r.user_notes) AS user_notes
FROM res r LEFT JOIN u USING (id)
""")
def q_apply_updates(spark, d):
    lab = T(spark, d, "labels")
    upd = lab.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("reviewed_"), F.col("doc_id").cast("string"))).alias("transformation_rule"),
        (F.col("toxic") == 1).alias("needs_review"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("user_notes"),
    )
    return apply_updates(results(spark, d), upd).select("id", "transformation_rule", "needs_review", "user_notes")


@register("with_defaults", "WITH " + MESSY_SQL + """
SELECT id, coalesce(confidence_score, 0.5) AS confidence_score, coalesce(needs_review, false) AS needs_review,
  coalesce(CASE WHEN id > 100 THEN TIMESTAMP '2024-05-01 00:00:00' END, TIMESTAMP '2024-01-01 00:00:00') AS created_at FROM m
""")
def q_with_defaults(spark, d):
    m = _messy(spark, d).select("id", "confidence_score", "needs_review",
                                F.when(F.col("id") > 100, F.lit("2024-05-01 00:00:00").cast("timestamp")).alias("created_at"))
    return with_defaults(m, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))


SESSIONS_SQL = """
ses AS (SELECT conv_id AS session_id, 'conversations/' || conv_id::VARCHAR AS notebook_path,
  CASE WHEN min(turn) = 0 THEN 'processing' ELSE 'pending' END AS status, NULL::TIMESTAMP AS completed_at
  FROM conversations GROUP BY conv_id),
outc AS (SELECT conv_id AS session_id, bool_or(role = 'assistant') AS ok FROM conversations GROUP BY conv_id HAVING count(*) >= 2)"""


def sessions(spark, d):
    c = T(spark, d, "conversations")
    ses = c.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.when(F.min("turn") == 0, F.lit("processing")).otherwise(F.lit("pending")).alias("status"))
    ses = ses.select("session_id", F.concat(F.lit("conversations/"), F.col("session_id").cast("string")).alias("notebook_path"),
                     "status", F.lit(None).cast("timestamp").alias("completed_at"))
    outc = c.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.bool_or(F.col("role") == "assistant").alias("ok"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    return ses, outc


@register("session_status", "WITH " + SESSIONS_SQL + """
SELECT s.session_id, s.notebook_path,
  CASE WHEN o.ok IS NOT NULL AND s.status = 'processing' THEN CASE WHEN o.ok THEN 'completed' ELSE 'failed' END ELSE s.status END AS status,
  CASE WHEN o.ok IS NOT NULL AND s.status = 'processing' THEN TIMESTAMP '2024-06-01 12:00:00' ELSE s.completed_at END AS completed_at
FROM ses s LEFT JOIN outc o USING (session_id)
""")
def q_session_status(spark, d):
    ses, outc = sessions(spark, d)
    return close_session(ses, outc, now=F.lit("2024-06-01 12:00:00").cast("timestamp"))


@register("session_view", "WITH " + SESSIONS_SQL + """
SELECT s.session_id, s.status, count(c.turn)::INTEGER AS n_results,
  coalesce(string_agg(c.turn::VARCHAR || '|' || c.role || '|' || md5(c.text), ';' ORDER BY c.turn), '') AS results
FROM ses s LEFT JOIN conversations c ON c.conv_id = s.session_id GROUP BY s.session_id, s.status
""")
def q_session_view(spark, d):
    ses, _ = sessions(spark, d)
    res = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role",
                                              F.md5("text").alias("text_md5"))
    v = session_view(ses, res, ["id", "role", "text_md5"], order="id")
    return v.select("session_id", "status", F.size("results").alias("n_results"),
                    F.array_join(F.transform("results", lambda x: F.concat_ws("|", x["id"].cast("string"), x["role"], x["text_md5"])), ";")
                    .alias("results"))


@register("save_partitioned", """
SELECT ts::DATE::VARCHAR AS created_date, count(*) AS n, count(DISTINCT user_id) AS users,
  sum(value::DECIMAL(18,2))::DECIMAL(18,2)::VARCHAR AS total_value FROM events GROUP BY 1
""")
def q_save_partitioned(spark, d):
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/runs-{uuid.uuid4().hex}"
    events = T(spark, d, "events")
    save_partitioned(events.where("user_id % 2 = 0"), root, ts_col="ts", cluster_by="user_id")
    save_partitioned(events.where("user_id % 2 <> 0 OR user_id IS NULL"), root, ts_col="ts")  # a second run adds to the store
    back = spark.read.parquet(root)
    return back.groupBy(F.col("created_date").cast("string").alias("created_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total_value"))


@register("output_name", r"""
WITH x AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '[]:*?' ELSE
  'db.' || p_brand || '.<' || p_type || '>/' || p_name || '?' || repeat('x', p_size) END AS target FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN 'Sheet1' ELSE s END AS output_name FROM (
  SELECT p_partkey, substring(regexp_replace(replace(coalesce(nullif(target, ''), 'unknown'), '.', '_'), '[<>\[\]:*?/\\'']', '', 'g'), 1, 31) AS s
  FROM x)
""")
def q_output_name(spark, d):
    p = T(spark, d, "part")
    s = F.col("p_size")
    x = p.select("p_partkey", F.when(s == 1, None).when(s == 2, F.lit("[]:*?")).otherwise(F.concat(
        F.lit("db."), F.col("p_brand"), F.lit(".<"), F.col("p_type"), F.lit(">/"), F.col("p_name"), F.lit("?"),
        F.repeat(F.lit("x"), s))).alias("target"))
    return x.select("p_partkey", output_name("target").alias("output_name"))
