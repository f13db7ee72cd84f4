"""Registered queries for the text operators (M1, M2, M12) over whole texts of
the ``documents`` and ``pages`` tables and the ``supplier`` and ``part``
hierarchies, and for the script extractors (M3, M4, M6-M9, M11, M13, M14, D14)
over scripts derived from every ``part`` row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.operators.lineage import lineage_closure, lineage_edges, lineage_roots
from tapestry.operators.scripts import CODE_PATTERNS, extract_patterns, split_cells, split_lines
from tapestry.plans.queries import T, register
from tapestry.session import dealt

# --- fixed values of this binding ---------------------------------------------
HTML_PATTERNS = {
    "link": (r'<a href="([^"]*)">([^<]*)</a>', (1, 2), ""),
    "title": (r"<title>(.*?)</title>", (1,), "i"),
    "heading": (r"<h1>(.*?)</h1>", (1,), ""),
}
# -------------------------------------------------------------------------------


@register("split_lines", """
SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
""")
def q_split_lines(spark, d):
    return split_lines(T(spark, d, "documents"), keys=["doc_id"])


_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = "regexp_replace({x}, '^" + _WS + "+|" + _WS + "+$', '', 'g')"


def _starts(x: str, prefix: str) -> str:
    return f"starts_with({_STRIP.replace("{x}", x)}, '{prefix}')"


@register("split_cells", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, lines, list_concat([-1], list_filter(range(len(lines)), lambda i: {_starts('lines[i + 1]', '# COMMAND ----------')}),
      [len(lines)]) AS bounds FROM l),
c AS (SELECT doc_id, (generate_subscripts(cells, 1) - 1)::INTEGER AS cell_no, unnest(cells) AS cell FROM (
      SELECT doc_id, list_transform(range(len(bounds) - 1),
        lambda k: lines[bounds[k + 1] + 2 : bounds[k + 2]]) AS cells FROM b)),
k AS (SELECT doc_id, cell_no,
  CASE WHEN len(list_filter(cell, lambda x: {_starts('x', '# MAGIC %sql')})) > 0 THEN 'sql'
       WHEN len(list_filter(cell, lambda x: {_starts('x', '# MAGIC %md')})) > 0 THEN 'markdown' ELSE 'pyspark' END AS cell_type,
  list_filter(list_transform(cell, lambda x: CASE WHEN {_starts('x', '# MAGIC %sql')} OR {_starts('x', '# MAGIC %md')} THEN NULL
       WHEN {_starts('x', '# MAGIC')} THEN nullif({_STRIP.replace("{x}", "replace(x, '# MAGIC', '')")}, '') ELSE x END),
    lambda x: x IS NOT NULL) AS body
  FROM c WHERE len(cell) > 0)
SELECT doc_id, cell_no, cell_type, array_to_string(body, chr(10)) AS text FROM k WHERE len(body) > 0
""")
def q_split_cells(spark, d):
    return split_cells(T(spark, d, "documents"), keys=["doc_id"])


def _pattern_sql(table: str, key: str, col: str, catalog) -> str:
    parts = []
    for name, (pattern, groups, flags) in catalog.items():
        rx = (f"(?{flags})" if flags else "") + pattern
        rx = rx.replace("'", "''")
        g1 = f"regexp_extract_all({col}, '{rx}', {groups[0]})"
        g2 = f"regexp_extract_all({col}, '{rx}', {groups[1]})" if len(groups) > 1 else None
        sel = (f"SELECT {key}, '{name}' AS pattern, unnest(range(len(g1)))::INTEGER AS match_no, unnest(g1) AS g1, "
               + ("unnest(g2) AS g2" if g2 else "NULL::VARCHAR AS g2")
               + f" FROM (SELECT {key}, {g1} AS g1" + (f", {g2} AS g2" if g2 else "") + f" FROM {table})")
        parts.append(sel)
    return "\nUNION ALL\n".join(parts)


@register("extract_patterns", _pattern_sql("pages", "page_id", "html", HTML_PATTERNS))
def q_extract_patterns(spark, d):
    return extract_patterns(T(spark, d, "pages"), HTML_PATTERNS, text_col="html", keys=["page_id"])


@register("extract_code_patterns", _pattern_sql("documents", "doc_id", "text", CODE_PATTERNS))
def q_extract_code_patterns(spark, d):
    """The fixed code-pattern catalog over every document (whole texts)."""
    return extract_patterns(T(spark, d, "documents"), CODE_PATTERNS, text_col="text", keys=["doc_id"])


_CLOSURE_SQL = """
WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0),
r(node, ancestor, depth) AS (
  SELECT child, parent, 1 FROM e
  UNION ALL
  SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON r.ancestor = e.child WHERE r.depth < 64)
"""


def _supplier_edges(spark, d):
    s = T(spark, d, "supplier")
    return s.filter(F.col("s_suppkey") > 0).select(F.col("s_suppkey").alias("target"),
                                                   F.floor(F.col("s_suppkey") / 2).cast("long").alias("source"))


@register("lineage_closure", _CLOSURE_SQL + "SELECT node, ancestor, depth FROM r")
def q_lineage_closure(spark, d):
    return lineage_closure(spark, _supplier_edges(spark, d))


@register("lineage_roots", _CLOSURE_SQL + """
SELECT node, ancestor AS root, depth FROM r WHERE ancestor NOT IN (SELECT child FROM e)
""")
def q_lineage_roots(spark, d):
    return lineage_roots(spark, _supplier_edges(spark, d))


# chains of 100 (even hundreds) and diamonds with a cycle (odd hundreds), from part
_DAG_SQL = """
WITH RECURSIVE k AS (SELECT p_partkey AS k FROM part),
e AS (SELECT k AS child, k + 1 AS parent FROM k WHERE (k // 100) % 2 = 0 AND k % 100 < 99
  UNION SELECT k, k + 1 FROM k WHERE (k // 100) % 2 = 1 AND k % 20 < 19
  UNION SELECT k, k + 3 FROM k WHERE (k // 100) % 2 = 1 AND k % 20 < 17
  UNION SELECT k, k - 5 FROM k WHERE (k // 100) % 2 = 1 AND k % 20 = 19),
w(node, ancestor, depth) AS (
  SELECT child, parent, 1 FROM e
  UNION
  SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON w.ancestor = e.child WHERE w.depth < 110),
r AS (SELECT node, ancestor, min(depth)::INTEGER AS depth FROM w WHERE node <> ancestor GROUP BY ALL)
"""


def _dag_edges(spark, d):
    k = F.col("p_partkey")
    even = F.floor(k / 100) % 2 == 0
    steps = F.array(
        F.when(even & (k % 100 < 99), k + 1), F.when(~even & (k % 20 < 19), k + 1),
        F.when(~even & (k % 20 < 17), k + 3), F.when(~even & (k % 20 == 19), k - 5))
    return T(spark, d, "part").select(k.alias("target"), F.explode(F.array_compact(steps)).alias("source"))


@register("lineage_dag_closure", _DAG_SQL + "SELECT node, ancestor, depth FROM r")
def q_lineage_dag_closure(spark, d):
    return lineage_closure(spark, _dag_edges(spark, d))


@register("lineage_dag_roots", _DAG_SQL + """
SELECT node, ancestor AS root, depth FROM r WHERE ancestor NOT IN (SELECT child FROM e)
""")
def q_lineage_dag_roots(spark, d):
    return lineage_roots(spark, _dag_edges(spark, d))


# ------------------------------------------------------------------ scripts derived from part, one a row
def part_scripts(spark, d):
    """A script for every part: a list of tables, bindings (one variable is
    bound twice), a join, a target and a rule block."""
    p = dealt(T(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    text = F.concat(
        F.lit("# part script\nmember_tables = ["), q("p_brand"), F.lit(", "), q("p_type"), F.lit("]\n"),
        F.lit("x_df = tables["), q("p_brand"), F.lit("]\n"),
        F.lit('y_df = x_df.filter("size > '), F.col("p_size").cast("string"), F.lit('")\n'),
        F.lit("x_df = spark.table("), q("p_type"), F.lit(")\n"),
        F.lit('z_df = x_df.select("a", "b")\n'),
        F.lit("m_df = load(spark, schema, member_tables)\n"),
        F.when(F.col("p_size") % 2 == 0, F.lit('j_df = y_df.join(z_df, "k", "left")\n')).otherwise(F.lit('j_df = y_df.join(z_df, "k")\n')),
        F.lit('target_table = f"{db}.silver.'), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), F.lit('"\n'),
        F.lit("dq_rule_string = \"\"\"\nsize must be "), F.col("p_size").cast("string"), F.lit("\n\"\"\"\n"),
    )
    return p.select("p_partkey", text.alias("text"))


@register("resolve_bindings", """
SELECT p_partkey, unnest(['m_df', 'x_df', 'y_df', 'z_df']) AS var, unnest([p_brand, p_type, p_brand, p_type]) AS table_name FROM part
""")
def q_resolve_bindings(spark, d):
    s = part_scripts(spark, d)
    keys = ["p_partkey"]
    return S.resolve_bindings(spark, S.extract_bindings(s, keys=keys), S.extract_table_lists(s, keys=keys), keys=keys)


@register("extract_table_lists", """
SELECT p_partkey, 'member_tables' AS list_name, unnest([0, 1])::INTEGER AS position, unnest([p_brand, p_type]) AS table_name FROM part
""")
def q_extract_table_lists(spark, d):
    return S.extract_table_lists(part_scripts(spark, d), keys=["p_partkey"])


@register("extract_joins", """
SELECT p_partkey, 'y_df' AS left_df, 'z_df' AS right_df, CASE WHEN p_size % 2 = 0 THEN 'LEFT' ELSE 'INNER' END AS join_type, '"k"' AS condition FROM part
""")
def q_extract_joins(spark, d):
    return S.extract_joins(part_scripts(spark, d), keys=["p_partkey"]).drop("join_no")


@register("resolve_joins", """
SELECT p_partkey, p_brand AS primary_table, p_type AS secondary_table,
  CASE WHEN p_size % 2 = 0 THEN 'LEFT' ELSE 'INNER' END AS join_type, '"k"' AS condition FROM part
""")
def q_resolve_joins(spark, d):
    s, keys = part_scripts(spark, d), ["p_partkey"]
    bound = S.resolve_bindings(spark, S.extract_bindings(s, keys=keys), S.extract_table_lists(s, keys=keys), keys=keys)
    return S.resolve_joins(S.extract_joins(s, keys=keys), bound, keys=keys).select(
        *keys, "primary_table", "secondary_table", "join_type", "condition")


@register("extract_target", r"""
SELECT p_partkey, 'silver.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS target_table FROM part
""")
def q_extract_target(spark, d):
    return S.extract_target(part_scripts(spark, d), keys=["p_partkey"])


@register("extract_rule_block", """
SELECT p_partkey, chr(10) || 'size must be ' || p_size || chr(10) AS rule_block FROM part
""")
def q_extract_rule_block(spark, d):
    return S.extract_rule_block(part_scripts(spark, d), keys=["p_partkey"])


@register("lineage_edges", """
SELECT p_partkey, unnest(['j_df', 'j_df', 'x_df', 'y_df', 'z_df']) AS target, unnest(['y_df', 'z_df', p_type, 'x_df', 'x_df']) AS source FROM part
""")
def q_lineage_edges(spark, d):
    e = lineage_edges(part_scripts(spark, d), keys=["p_partkey"])
    return e.where(~F.col("source").startswith("tables["))


# calls nested 1 to 12 deep, a parenthesis inside a string, chains, dictionaries and aggregates
def part_calls(spark, d):
    p = T(spark, d, "part")
    n = F.col("p_size") % 12 + 1
    nested = F.concat(F.repeat(F.lit("f("), n), F.lit('col("'), F.col("p_type"), F.lit('")'), F.repeat(F.lit(")"), n))
    text = F.concat(
        F.lit('x_df = a_df.withColumn("u", '), nested, F.lit(').withColumn("t", concat(lit("("), col("p")))  # not ) this (\n'),
        F.lit('y_df = x_df.withColumns({"m": coalesce(col("a"), lit("NA, x")), "n": when(col("b") > 1, lit("y"))})\n'),
        F.lit('j_df = y_df.join(b_df, y_df.k == b_df.k, "left").join(c_df.select("k"), ["k", "z"])\n'),
        F.lit('g_df = j_df.groupBy("k").agg(sum('), nested, F.lit(').alias("total"), collect_list(struct("a", "b")).alias("arr"))\n'),
    )
    return p.select("p_partkey", text.alias("text"))


_NESTED = "repeat('f(', (p_size % 12 + 1)::INTEGER) || 'col(\"' || p_type || '\")' || repeat(')', (p_size % 12 + 1)::INTEGER)"


@register("extract_with_column", f"""
SELECT p_partkey, unnest([0, 1, 2, 3])::INTEGER AS match_no, unnest(['a_df', 'a_df', 'x_df', 'x_df']) AS receiver,
  unnest(['u', 't', 'm', 'n']) AS target_column,
  unnest([{_NESTED}, 'concat(lit("("), col("p"))', 'coalesce(col("a"), lit("NA, x"))', 'when(col("b") > 1, lit("y"))']) AS transformation
FROM part
""")
def q_extract_with_column(spark, d):
    return S.extract_with_column(part_calls(spark, d), keys=["p_partkey"])


@register("extract_chained_joins", """
SELECT p_partkey, unnest([0, 1])::INTEGER AS join_no, 'y_df' AS left_df, unnest(['b_df', 'c_df']) AS right_df,
  unnest(['LEFT', 'INNER']) AS join_type, unnest(['y_df.k == b_df.k', '["k", "z"]']) AS condition FROM part
""")
def q_extract_chained_joins(spark, d):
    return S.extract_joins(part_calls(spark, d), keys=["p_partkey"])


@register("extract_aggregates", f"""
SELECT p_partkey, unnest([0, 1])::INTEGER AS item_no, unnest(['total', 'arr']) AS target_column,
  unnest(['sum(' || {_NESTED} || ')', 'collect_list(struct("a", "b"))']) AS transformation FROM part
""")
def q_extract_aggregates(spark, d):
    return S.extract_aliased(part_calls(spark, d), "agg", keys=["p_partkey"]).select("p_partkey", "item_no", "target_column", "transformation")


@register("extract_when", """
SELECT p_partkey, 0 AS match_no, 'col("b") > 1' AS condition, 'lit("y")' AS result FROM part
""")
def q_extract_when(spark, d):
    return S.extract_when(part_calls(spark, d), keys=["p_partkey"]).drop("transformation")


@register("extract_select", """
SELECT p_partkey, 0 AS match_no, '"k"' AS transformation FROM part
""")
def q_extract_select(spark, d):
    return S.extract_select(part_calls(spark, d), keys=["p_partkey"])
