"""Registered queries for the corpus workflow, incremental extraction, rules as
rows, the exact similarity, notebooks' cells and the document exports (A3, A5-A7,
D13, I16, J13, L1-L8, M1, M2, M5, N1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapestry.functions.text import similarity_ratio
from tapestry.operators import scripts as S
from tapestry.operators.quality import rule_lines, rules_by_column
from tapestry.operators.review import attach_rules
from tapestry.operators.rule_table import apply_rule_table, rule_rows
from tapestry.plans.corpus_job import run_corpus
from tapestry.plans.q_mapping import classified
from tapestry.plans.queries import T, register
from tapestry.session import dealt, ensure_checkpoint_dir
from tapestry.sources.catalog import read_scripts
from tapestry.sources.corpus import Corpus
from tapestry.sources.run_store import RunStore
from tapestry.sources.sinks import conform, export_joins, export_mappings, overwrite_into

KEYS = ["p_partkey"]


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


# ------------------------------------------------------------------ I16, N1
def _ratio_sql(pairs: str) -> str:
    """``ratios(id, a, b, ratio)`` of ``pairs(id, a, b)`` by recursion over the
    intervals left and right of each longest block (texts under 200 characters)."""
    cells = ("flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform("
             "range(1, least(length({a}) - i + 1, length({b})) + 1), lambda k: [k, i])))")
    best = f"list_max(list_transform(list_filter({cells}, lambda t: contains({{b}}, substr({{a}}, t[2], t[1]))), lambda t: t[1] * 1000 - t[2]))"
    return f"""
pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
w(x, y, a, b, s) AS (
  SELECT a, b, a, b, {best.format(a="a", b="b")} FROM pairs WHERE a <> b AND a <> '' AND b <> ''
  UNION ALL
  SELECT x, y, r.a, r.b, {best.format(a="r.a", b="r.b")} FROM (
    SELECT x, y, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS r
    FROM (SELECT *, strpos(b, substr(a, i, k)) AS j FROM (SELECT *, ((s + 999) // 1000) AS k, ((s + 999) // 1000) * 1000 - s AS i FROM w WHERE s IS NOT NULL)))
  WHERE r.a <> '' AND r.b <> ''),
ratios AS (SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 1.0::DOUBLE
  ELSE 2.0::DOUBLE * coalesce(sum((s + 999) // 1000), 0)::DOUBLE / (length(p.a) + length(p.b)) END AS ratio
  FROM pairs p LEFT JOIN w ON w.x = p.a AND w.y = p.b GROUP BY p.a, p.b)"""


_PAIR = "p_name || ' ' || p_type AS a, p_brand || ' ' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE lower(p_type) || ' ' || reverse(p_name) || ' ' || p_size END AS b"


@register("similarity_ratio", "WITH RECURSIVE " + _ratio_sql(f"SELECT {_PAIR} FROM part") + f"""
SELECT p_partkey, round(ratio, 9) AS ratio FROM (SELECT p_partkey, {_PAIR} FROM part) JOIN ratios USING (a, b)
""")
def q_similarity_ratio(spark, d):
    p = dealt(T(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    b = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", F.lower("p_type"), F.reverse("p_name"), F.col("p_size").cast("string")))
    return p.select("p_partkey", F.round(similarity_ratio(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_brand", b)), 9).alias("ratio"))


@register("match_classes_ratio", None)
def q_match_classes_ratio(spark, d):
    """Match classes by the exact ratio (its values are held against SQL above)."""
    c = classified(spark, d, "ratio")
    return c.groupBy("match_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean"))


# ------------------------------------------------------------------ L1-L8
RULES = [
    ("customer", "\nCustomer\n    name must not be null\n    length(name) must be 18\n    balance should be greater than 0\n    segment should be in ['BUILDING', 'MACHINERY']\n"),
    ("supplier", "\nSupplier\n    balance should be less than 5000.5\n    name must be label\n    segment must not be null\n    since should be less than now\n    missing must not be null\n    odd rule\n"),
]


@register("rules_as_rows", """
WITH x AS (
  SELECT 'customer' AS entity, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
  UNION ALL SELECT 'nation', n_nationkey, n_name, NULL, NULL FROM nation)
SELECT entity, id, CASE entity
  WHEN 'customer' THEN concat_ws(';', CASE WHEN name IS NULL THEN 'name must not be null:error' END,
    CASE WHEN NOT coalesce(length(name) = 18, false) THEN 'length(name) must be 18:error' END,
    CASE WHEN NOT coalesce(balance > 0, false) THEN 'balance should be greater than 0:warning' END,
    CASE WHEN NOT coalesce(segment IN ('BUILDING', 'MACHINERY'), false) THEN 'segment should be in [''BUILDING'', ''MACHINERY'']:warning' END)
  WHEN 'supplier' THEN concat_ws(';', CASE WHEN NOT coalesce(balance < 5000.5, false) THEN 'balance should be less than 5000.5:warning' END,
    CASE WHEN id % 3 = 0 THEN 'name must be label:error' END, 'segment must not be null:error',
    CASE WHEN id % 2 = 0 THEN 'since should be less than now:warning' END, 'missing must not be null:error', 'odd rule:warning')
  ELSE '' END AS failures,
  CASE entity WHEN 'customer' THEN 4 WHEN 'supplier' THEN 6 ELSE 0 END AS n_rules FROM x
""")
def q_rules_as_rows(spark, d):
    """Three entities, two of them with rules of their own, in one pass."""
    c, s, n = (T(spark, d, t) for t in ("customer", "supplier", "nation"))
    none = lambda t: F.lit(None).cast(t)
    label = F.when(F.col("s_suppkey") % 3 == 0, F.lit("?")).otherwise(F.col("s_name"))
    since = F.when(F.col("s_suppkey") % 2 == 0, F.lit("2031-01-01")).otherwise(F.lit("2020-01-01")).cast("timestamp")
    rows = c.select(F.lit("customer").alias("entity"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                    F.col("c_mktsegment").alias("segment"), none("string").alias("label"), none("timestamp").alias("since"))
    rows = rows.unionAll(s.select(F.lit("supplier"), "s_suppkey", "s_name", "s_acctbal", none("string"), label, since))
    rows = rows.unionAll(n.select(F.lit("nation"), F.col("n_nationkey").cast("long"), "n_name", none("double"), none("string"), none("string"), none("timestamp")))
    rules = rule_rows(spark.createDataFrame(RULES, "entity string, text string"))
    out = apply_rule_table(rows, rules, now=F.lit("2026-01-01").cast("timestamp"))
    failed = F.transform(F.filter("dq_results", lambda x: ~x["passed"]), lambda x: F.concat_ws(":", x["rule"], x["severity"]))
    return out.select("entity", "id", F.array_join(failed, ";").alias("failures"), F.size("dq_results").alias("n_rules"))


# ------------------------------------------------------------------ notebooks (M1, M2, M5)
def part_notebooks(spark, d):
    text = _text(
        "x_df = 1\n# COMMAND ----------\n# MAGIC %sql\n# MAGIC SELECT ", F.col("p_brand"), " AS b,\n# MAGIC   CASE WHEN size > ",
        F.col("p_size").cast("string"), " THEN 'big' END AS s FROM part\n# COMMAND ----------\n\n# COMMAND ----------\n# MAGIC %md\n# MAGIC ", F.col("p_name"),
        '\n# COMMAND ----------\ndf = df.withColumn("u", upper("a")).select(col("', F.col("p_type"), '"))')
    return T(spark, d, "part").select("p_partkey", text.alias("text"))


_CASE = "'CASE WHEN size > ' || p_size || ' THEN ''big'' END AS s'"


@register("split_notebook_cells", f"""
SELECT p_partkey, unnest([0, 1, 2, 3, 4])::INTEGER AS cell_no, unnest(['pyspark', 'sql', 'pyspark', 'markdown', 'pyspark']) AS cell_type,
  unnest(['x_df = 1', 'SELECT ' || p_brand || ' AS b,' || chr(10) || {_CASE} || ' FROM part', '', p_name,
    'df = df.withColumn("u", upper("a")).select(col("' || p_type || '"))']) AS text FROM part
""")
def q_split_notebook_cells(spark, d):
    return S.split_cells(part_notebooks(spark, d), keys=KEYS)


@register("notebook_code_patterns", f"""
SELECT p_partkey, unnest([4, 4, 1, 1])::INTEGER AS cell_no, unnest(['column_transformation', 'select_transformation', 'sql_select', 'sql_case']) AS type,
  unnest(['u', NULL, NULL, NULL]) AS target_column,
  unnest(['upper("a"', 'col("' || p_type || '"', p_brand || ' AS b,' || chr(10) || {_CASE}, NULL]) AS transformation,
  unnest([NULL, NULL, NULL, 'size > ' || p_size]) AS condition, unnest([NULL, NULL, NULL, '''big''']) AS result FROM part
""")
def q_notebook_code_patterns(spark, d):
    cells = S.split_cells(part_notebooks(spark, d), keys=KEYS)
    return S.code_patterns(cells, keys=[*KEYS, "cell_no"]).drop("match_no")


# ------------------------------------------------------------------ rule blocks and documents
def part_rules(spark, d):
    text = _text("Part\n    p_size must not be null\n    length(p_name) must be ", F.col("p_size").cast("string"), "\n    p_size should be in ['",
                 F.col("p_type"), "']\n\nnot a rule\n")
    return T(spark, d, "part").select("p_partkey", text.alias("text"))


@register("rule_lines", """
SELECT p_partkey, unnest([1, 2, 3])::INTEGER AS line_no, unnest(['p_size must not be null', 'length(p_name) must be ' || p_size, 'p_size should be in [''' || p_type || ''']']) AS rule,
  unnest(['p_size', 'p_name', 'p_size']) AS column, unnest(['error', 'error', 'warning']) AS severity FROM part
""")
def q_rule_lines(spark, d):
    return rule_lines(part_rules(spark, d), keys=KEYS)


def part_mappings(spark, d):
    """Two mappings a part, one with array fields, with their rules attached."""
    p = T(spark, d, "part")
    field = "array(named_struct('alias', 'x', 'transformation', p_brand), named_struct('alias', 'y', 'transformation', cast(null as string)))"
    rows = p.select("p_partkey", F.explode(F.expr(f"""array(
      named_struct('n', 0, 'source_table', p_brand, 'source_columns', p_type, 'target_column', 'p_size', 'transformation', concat('col("', p_name, '"), 1'), 'array_fields', slice(array(named_struct('alias', '', 'transformation', '')), 1, 0)),
      named_struct('n', 1, 'source_table', p_type, 'source_columns', '', 'target_column', 'arr', 'transformation', 'struct', 'array_fields', {field}))""")).alias("m"))
    rules = rules_by_column(rule_lines(part_rules(spark, d), keys=KEYS), KEYS)
    return attach_rules(rows.select("p_partkey", "m.*"), rules, keys=KEYS)


@register("attach_rules", """
SELECT p_partkey, unnest([0, 1])::INTEGER AS n, unnest(['p_size', 'arr']) AS target_column,
  unnest(['p_size must not be null; p_size should be in [''' || p_type || ''']', '']) AS dq_rules FROM part
""")
def q_attach_rules(spark, d):
    return part_mappings(spark, d).select("p_partkey", "n", "target_column", "dq_rules")


@register("export_mappings", """
SELECT unnest([p_brand, p_type, '', '']) AS "Source Table", unnest([p_type, '', '', '']) AS "Source Column(s)", unnest(['p_size', 'arr', '', '']) AS "Target Column(s)",
  unnest(['', '', 'x', 'y']) AS "Array Field", unnest(['col("' || p_name || '"), 1', 'struct', p_brand, '']) AS "Transformation",
  unnest(['p_size must not be null; p_size should be in [''' || p_type || ''']', '', '', '']) AS "DQ Rules" FROM part
""")
def q_export_mappings(spark, d):
    """The mapping document as written to CSV and read back."""
    path = _scratch(spark, "mappings")
    export_mappings(part_mappings(spark, d), path, order=["p_partkey", "n"])
    back = spark.read.option("header", "true").csv(path)
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in back.columns])


@register("export_joins", """
SELECT p_brand AS "Primary Table", p_type AS "Secondary Table", CASE WHEN p_size % 2 = 0 THEN 'LEFT' ELSE 'INNER' END AS "Join Type", 'a.k == "' || p_name || '"' AS "Join Condition",
  '' AS "Remarks" FROM part
""")
def q_export_joins(spark, d):
    how = F.when(F.col("p_size") % 2 == 0, "LEFT").otherwise("INNER")
    joins = T(spark, d, "part").select(F.col("p_brand").alias("left_df"), F.col("p_type").alias("right_df"), how.alias("join_type"),
                                       _text('a.k == "', F.col("p_name"), '"').alias("condition"), F.lit(None).cast("string").alias("remarks"))
    path = _scratch(spark, "joins")
    export_joins(joins, path)
    back = spark.read.option("header", "true").csv(path)
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in back.columns])


# ------------------------------------------------------------------ files and tables (A3, A5)
@register("read_script_files", "SELECT s_name || ' = ' || s_suppkey AS line FROM supplier")
def q_read_script_files(spark, d):
    """Files of lines, read whole and cut into lines again."""
    path = _scratch(spark, "scripts")
    T(spark, d, "supplier").select(_text(F.col("s_name"), " = ", F.col("s_suppkey").cast("string"))).write.text(path)
    return S.split_lines(read_scripts(spark, path, ext=".txt")).where("line <> ''").select("line")


@register("overwrite_into", "SELECT p_partkey::VARCHAR AS key, p_name AS name, p_size::DOUBLE AS size FROM part WHERE p_size < 20")
def q_overwrite_into(spark, d):
    """A target table overwritten by position, twice."""
    name = f"target_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (key STRING, name STRING, size DOUBLE) USING parquet LOCATION '{_scratch(spark, 'target')}'")
    p = T(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    for rows in (p, p.where("size < 20")):
        overwrite_into(conform(rows, spark.table(name).schema), name)
    return spark.table(name)


# ------------------------------------------------------------------ incremental corpus (A3)
@register("corpus_update", """
WITH b AS (SELECT p_partkey, p_size % 4 AS v, p_type FROM part),
now AS (SELECT * FROM b WHERE v <> 3),
r AS (SELECT 'part/' || p_partkey AS path, CASE WHEN v = 1 THEN 'w' ELSE 'u' END AS target_column, 'col("' || p_type || '")' AS transformation FROM now)
SELECT path, target_column, transformation, 'row' AS kind FROM r
UNION ALL SELECT 'part/' || p_partkey, NULL, NULL, CASE v WHEN 0 THEN 'same' WHEN 1 THEN 'changed' WHEN 2 THEN 'new' ELSE 'removed' END FROM b WHERE v > 0
""")
def q_corpus_update(spark, d):
    """A corpus, then one with scripts changed, added and removed, then the same
    one again: the rows, and what the second update touched."""
    p = T(spark, d, "part").withColumn("v", F.col("p_size") % 4)
    script = lambda target: _text('x_df = a_df.withColumn("', target, '", col("', F.col("p_type"), '"))\n')
    path = _text("part/", F.col("p_partkey").cast("string")).alias("path")
    first = p.where("v <> 2").select(path, script("u").alias("text"))
    second = p.where("v <> 3").select(path, script(F.when(F.col("v") == 1, F.lit("w")).otherwise(F.lit("u"))).alias("text"))
    corpus = Corpus(spark, _scratch(spark, "corpus"), {"mappings": lambda s: S.extract_with_column(s)}, buckets=8)
    corpus.update(first)
    touched = corpus.update(second)
    again = corpus.update(second)  # touches nothing
    rows = corpus.read("mappings").select("path", "target_column", "transformation", F.lit("row").alias("kind"))
    none = F.lit(None).cast("string")
    return rows.unionByName(touched.unionByName(again).select("path", none.alias("target_column"), none.alias("transformation"), F.col("change").alias("kind")))


# ------------------------------------------------------------------ the whole workflow
def part_jobs(spark, d):
    t = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    text = _text(
        'from pyspark.sql import functions as F\na_df = spark.table("db.', t("p_brand"), '")\n',
        'x_df = a_df.withColumn("u", F.upper(F.col("a"))).withColumn("v", a_df.b + a_df["c"])\n',
        'a_df = spark.table("db.', t("p_type"), '")\n',
        'y_df = a_df.withColumn("w", when(col("d") > ', F.col("p_size").cast("string"), ', lit("x")).otherwise(col("d")))\n',
        'z_df = y_df.select("k", col("e").alias("f"))\n')
    p = dealt(T(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    return p.select(_text("job/", F.col("p_partkey").cast("string")).alias("path"), text.alias("text"))


@register("corpus_job", """
WITH p AS (SELECT 'job/' || p_partkey AS path, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS b, lower(p_type) AS t, p_size AS n FROM part)
SELECT path, unnest(['code_only', 'legacy_only', 'code_only', 'legacy_only', 'exact', 'code_only']) AS match_class,
  unnest(['code_analysis', 'legacy', 'code_analysis', 'legacy', 'code_analysis', 'code_analysis']) AS extraction_source,
  unnest(['db.' || b, 'db.' || t, 'db.' || b, 'unknown', 'db.' || t, 'db.' || t]) AS source_table,
  unnest([b || '.a', t || '.a', b || '.b, ' || b || '.c', 'unknown', t || '.d', t || '.e']) AS source_column,
  unnest(['upper(col("a"))', 'upper(col("a"))', 'a_df.b + a_df["c"]', 'a_df.b + a_df["c"]', 'when(col("d") > ' || n || ', lit("x")).otherwise(col("d"))', 'col("e")']) AS transformation_rule,
  unnest(['u', 'u', 'v', 'v', 'w', 'f']) AS target_field, unnest([0.8, 0.4, 0.7, 0.2, 0.8, 0.7])::DOUBLE AS confidence_score,
  unnest([false, true, false, true, false, false]) AS needs_review FROM p
""")
def q_corpus_job(spark, d):
    """A job for every part, saved twice into one store."""
    store = RunStore(spark, _scratch(spark, "jobs"), buckets=8)
    rows = run_corpus(spark, part_jobs(spark, d), store, F.lit("2024-03-01 12:00:00").cast("timestamp"))
    store.save(rows)
    rows = store.read()
    return rows.select("path", "match_class", "extraction_source", "source_table", "source_column", "transformation_rule", "target_field",
                       F.round("confidence_score", 6).alias("confidence_score"), "needs_review")
