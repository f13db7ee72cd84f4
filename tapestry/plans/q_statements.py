"""Registered queries for versioned lineage, column references, nested fields,
column lists and condition names (M4, M8, M10-M12, M15, D14) over scripts
derived from every ``part`` row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.operators import statements as V
from tapestry.operators.lineage import lineage_closure, lineage_roots
from tapestry.plans.queries import T, register
from tapestry.session import dealt

KEYS = ["p_partkey"]


def _script(spark, d, *parts: Column | str):
    p = dealt(T(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    return p.select("p_partkey", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))


# names bound again, an indented block, statements over several lines, two on a line, code-like text in a string
def part_history(spark, d):
    again = F.repeat(F.lit('a_df = a_df.withColumn("v",\n  F.col("v") + 1)\n'), F.col("p_size") % 4)
    return _script(
        spark, d, 'from pyspark.sql import functions as F\na_df = tables["', F.col("p_brand"), '"]\nif full:\n    a_df = a_df.filter(\n"x = 1")\n',
        'b_df = (\n    a_df.alias("a")\n\n    .join(c_df, "k")  # a_df = none\n)\n', again,
        'a_df = spark.table("', F.col("p_type"), '"); d_df = b_df.join(a_df.select("k"), "k") \\\n    .where("""q = 1;\na_df = no_df.join(x_df)""")\n',
        "for i in range(3): s_df = d_df\n",
    )


_HISTORY = """
WITH RECURSIVE p AS (SELECT p_partkey, p_brand AS b, p_type AS t, p_size % 4 AS n FROM part),
e AS (
  SELECT p_partkey, 'var:a_df#1' AS node, 'table:' || b || '#0' AS source FROM p
  UNION ALL SELECT p_partkey, 'var:a_df#2', 'var:a_df#1' FROM p
  UNION ALL SELECT p_partkey, 'var:b_df#1', unnest(['var:a_df#2', 'name:c_df#0']) FROM p
  UNION ALL SELECT p_partkey, 'var:a_df#' || (i + 2), 'var:a_df#' || (i + 1) FROM p, range(1, 4) r(i) WHERE i <= n
  UNION ALL SELECT p_partkey, 'var:a_df#' || (n + 3), 'table:' || t || '#0' FROM p
  UNION ALL SELECT p_partkey, 'var:d_df#1', unnest(['var:b_df#1', 'var:a_df#' || (n + 3)]) FROM p
  UNION ALL SELECT p_partkey, 'var:s_df#1', 'var:d_df#1' FROM p),
w(p_partkey, node, ancestor, depth) AS (
  SELECT p_partkey, node, source, 1 FROM e
  UNION ALL SELECT w.p_partkey, w.node, e.source, w.depth + 1 FROM w JOIN e ON e.p_partkey = w.p_partkey AND e.node = w.ancestor),
c AS (SELECT p_partkey, node, ancestor, min(depth)::INTEGER AS depth FROM w GROUP BY ALL)
"""


def node_text(c: str) -> Column:
    return F.concat(F.col(f"{c}.kind"), F.lit(":"), F.col(f"{c}.name"), F.lit("#"), F.col(f"{c}.version").cast("string")).alias(c)


@register("lineage_versions", _HISTORY + "SELECT p_partkey, node, ancestor, depth FROM c")
def q_lineage_versions(spark, d):
    edges = V.lineage_versions(part_history(spark, d), keys=KEYS)
    return lineage_closure(spark, edges, keys=KEYS).select(*KEYS, node_text("node"), node_text("ancestor"), "depth")


@register("lineage_version_roots", _HISTORY + "SELECT p_partkey, node, ancestor AS root, depth FROM c WHERE ancestor NOT LIKE 'var:%'")
def q_lineage_version_roots(spark, d):
    edges = V.lineage_versions(part_history(spark, d), keys=KEYS)
    return lineage_roots(spark, edges, keys=KEYS).select(*KEYS, node_text("node"), node_text("root"), "depth")


@register("table_versions", """
WITH p AS (SELECT p_partkey, p_brand AS b, p_type AS t, p_size % 4 AS n FROM part)
SELECT p_partkey, 'a_df' AS var, unnest(range(1, n + 4))::INTEGER AS version, unnest(list_transform(range(1, n + 4), lambda i: CASE WHEN i < n + 3 THEN b ELSE t END)) AS table_name FROM p
UNION ALL SELECT p_partkey, 'b_df', 1, b FROM p
UNION ALL SELECT p_partkey, unnest(['d_df', 's_df']), 1, NULL FROM p
""")
def q_table_versions(spark, d):
    return V.table_versions(part_history(spark, d), keys=KEYS).drop("until")


# every form of a column's name, before and after its variable is bound again
def part_references(spark, d):
    return _script(
        spark, d, 'from pyspark.sql import functions as F, Window as W\na_df = spark.table("', F.col("p_brand"), '")\n',
        'x_df = a_df.withColumn("v", a_df.total + F.col("q") * 1.5 + a_df["', F.lower(F.regexp_replace("p_type", " ", "_")),
        '"].cast("double") + f(z)["no"].m - c_df.info.city)\n',
        'a_df = tables["', F.col("p_type"), '"]\n',
        'y_df = a_df.withColumns({"w": F.when(a_df.s == "a_df.t", a_df["u"]["z"]).otherwise(col("r")).over(W.rows),\n  "m": a_df.zone.other(x_df.v)})\n',
    )


@register("column_references", """
WITH p AS (SELECT p_partkey, p_brand AS b, p_type AS t, lower(replace(p_type, ' ', '_')) AS c FROM part)
SELECT p_partkey, 'v' AS target_column, unnest([b, b, b, 'c_df']) AS table_name, unnest(['total', 'q', c, 'info.city']) AS column FROM p
UNION ALL SELECT p_partkey, unnest(['w', 'w', 'w', 'm', 'm']), unnest([t, t, t, t, b]), unnest(['s', 'u.z', 'r', 'zone', 'v']) FROM p
""")
def q_column_references(spark, d):
    s = part_references(spark, d)
    e = V.expressions(s, keys=KEYS)
    one = [*KEYS, "at", "item_no", "target_column", "receiver"]
    refs = V.references(e, keys=one).join(V.imported_names(s, keys=KEYS), [*KEYS, "var"], "left_anti")
    return V.bind_references(refs, V.table_versions(s, keys=KEYS), KEYS).select(*KEYS, "target_column", "table_name", "column")


# fields three levels deep, in an aggregate and in a list comprehension
def part_fields(spark, d):
    return _script(
        spark, d, 'g_df = t_df.groupBy("k").agg(collect_list(struct(coalesce(col("a"), lit("NA, x)")).alias("k"), struct(col("', F.col("p_type"),
        '").alias("x"), array(struct(col("y").alias("z"), lit(', F.col("p_size").cast("string"),
        ').alias("n"))).alias("deep")).alias("inner"))).alias("arr"), count("*").alias("rows"))\n',
        'h_df = g_df.select(array(*[struct(lit(v).alias("code"), col(v).alias("value")) for v in names]).alias("pairs"))\n',
    )


@register("field_tree", """
WITH p AS (SELECT p_partkey, 'col("' || p_type || '")' AS x, 'lit(' || p_size || ')' AS n FROM part)
SELECT p_partkey, 'arr' AS target_column, unnest([0, 1, 2, 3, 4, 5])::INTEGER AS field_no,
  unnest(['k', 'inner', 'inner.x', 'inner.deep', 'inner.deep.z', 'inner.deep.n']) AS path,
  unnest(['', '', 'inner', 'inner', 'inner.deep', 'inner.deep']) AS parent, unnest(['k', 'inner', 'x', 'deep', 'z', 'n']) AS alias,
  unnest([1, 1, 2, 2, 3, 3])::INTEGER AS depth,
  unnest(['coalesce(col("a"), lit("NA, x)"))',
    'struct(' || x || '.alias("x"), array(struct(col("y").alias("z"), ' || n || '.alias("n"))).alias("deep"))', x,
    'array(struct(col("y").alias("z"), ' || n || '.alias("n")))', 'col("y")', n]) AS transformation FROM p
UNION ALL SELECT p_partkey, 'pairs', unnest([0, 1]), unnest(['code', 'value']), '', unnest(['code', 'value']), 1, unnest(['lit(v)', 'col(v)']) FROM p
""")
def q_field_tree(spark, d):
    e = V.expressions(part_fields(spark, d), keys=KEYS)
    return V.field_tree(e, keys=[*KEYS, "target_column"])


# a list of columns bound twice, starred, passed plainly, and used in a comprehension
def part_lists(spark, d):
    return _script(
        spark, d, 'names = ["a", "', F.col("p_brand"), '"]\ncols = [\n  col("x").alias("u"),  # first\n  t_df["', F.lower("p_brand"), '"]]\n',
        'a_df = t_df.select("k", *cols, lit(1).alias("one"))\ncols = [col(c).alias(c) for c in names]\n',
        'b_df = t_df.select(cols)\nc_df = b_df.select(*[upper(c).alias(c) for c in names], *more)\n',
    )


@register("expand_column_lists", """
WITH p AS (SELECT p_partkey, p_brand AS b, lower(p_brand) AS l FROM part)
SELECT p_partkey, 't_df' AS receiver, unnest([0, 1, 2, 3])::INTEGER AS item_no, unnest(['"k"', 'col("x").alias("u")', 't_df["' || l || '"]', 'lit(1).alias("one")']) AS item FROM p
UNION ALL SELECT p_partkey, 't_df', unnest([0, 1]), unnest(['col("a").alias("a")', 'col("' || b || '").alias("' || b || '")']) FROM p
UNION ALL SELECT p_partkey, 'b_df', unnest([0, 1, 2]), unnest(['upper("a").alias("a")', 'upper("' || b || '").alias("' || b || '")', '*more']) FROM p
""")
def q_expand_column_lists(spark, d):
    s = part_lists(spark, d)
    calls = S.calls_of(s, "select", keys=KEYS)
    items = calls.select(*KEYS, F.col("call").alias("at"), "receiver", F.posexplode("args").alias("item_no", "item"))
    items = items.withColumn("item", F.trim("item"))
    return V.expand_items(items, V.list_versions(s, keys=KEYS), KEYS).drop("at")


@register("select_targets", """
WITH p AS (SELECT p_partkey, p_brand AS b, lower(p_brand) AS l FROM part)
SELECT p_partkey, 't_df' AS receiver, unnest(['k', 'u', 'one', 'a']) AS target_column, unnest(['"k"', 'col("x")', 'lit(1)', 'col("a")']) AS transformation FROM p
UNION ALL SELECT p_partkey, unnest(['t_df', 'b_df', 'b_df']), unnest([b, 'a', b]), unnest(['col("' || b || '")', 'upper("a")', 'upper("' || b || '")']) FROM p
""")
def q_select_targets(spark, d):
    """Brands hold '#': subscripts of such names are no plain columns."""
    return V.expressions(part_lists(spark, d), keys=KEYS).select(*KEYS, "receiver", "target_column", "transformation")


# tables called like other variables: a -> b, b -> c
def part_shadows(spark, d):
    return _script(
        spark, d, 'a = spark.table("b")\nb = spark.table("', F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")),
        '")\nj = a.join(b, (a.k == b.k) & (a.x.b == "a.k") & (f(a).b != b.a))\n')


@register("resolve_shadowed_joins", """
SELECT p_partkey, 'b' AS primary_table, t AS secondary_table, 'INNER' AS join_type,
  '(b.k == ' || t || '.k) & (b.x.b == "a.k") & (f(a).b != ' || t || '.a)' AS condition
FROM (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS t FROM part)
""")
def q_resolve_shadowed_joins(spark, d):
    s = part_shadows(spark, d)
    bound = S.resolve_bindings(spark, S.extract_bindings(s, keys=KEYS), S.extract_table_lists(s, keys=KEYS), keys=KEYS)
    return S.resolve_joins(S.extract_joins(s, keys=KEYS), bound, keys=KEYS).select(*KEYS, "primary_table", "secondary_table", "join_type", "condition")
