"""Registered queries for the entity-consolidation operators (A, B, C, D, E,
H, I, J, L), bound to the TPC-H-style tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tapestry.functions.arrays import (cross_apply, distinct_groups, first_field, first_of, keyed_map,
                                       merge_arrays, merge_maps, pick, shape)
from tapestry.functions.codes import classify, role_of, translate, yes_no
from tapestry.functions.keys import (base_name, first_non_empty, full_name, iso_ts, padded_name, split_code,
                                     surrogate_key)
from tapestry.operators.lookup import Lookup, attach, join_back, lookup, lookup_chain
from tapestry.operators.nest import Nest, NestConcat, NestUnion, nest_many, nest_schedules, primary_of, unpivot_schedule
from tapestry.operators.project import const, derive, lower_columns, null_as, prefix_columns, project, trim_strings
from tapestry.operators.quality import apply_rules, dq_summary, flatten_results
from tapestry.operators.reconcile import dedupe_first, last_per_key
from tapestry.plans.canonical import arr_text, map_text
from tapestry.plans.queries import TABLES, T, register, tables
from tapestry.sources.catalog import isin_trimmed, row_counts
from tapestry.sources.sinks import conform

# ---------------------------------------------------------------------------- A
_COUNT_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)


@register("load_tables", _COUNT_SQL)
def q_load_tables(spark: SparkSession, d: str) -> DataFrame:
    return row_counts(tables(spark, d))


CONFORM_SCHEMA = StructType([
    StructField("c_name", StringType()),
    StructField("c_custkey", StringType()),
    StructField("c_acctbal", DoubleType()),
    StructField("c_nationkey", LongType()),
    StructField("c_mktsegment", StringType()),
])


@register("conform_schema", """
SELECT c_name, c_custkey::VARCHAR AS c_custkey, c_acctbal, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer
""")
def q_conform_schema(spark, d):
    upper = T(spark, d, "customer").toDF(*[c.upper() for c in T(spark, d, "customer").columns])
    return conform(upper, CONFORM_SCHEMA, strict=True)


# ---------------------------------------------------------------------------- B
@register("lower_columns", "SELECT * FROM customer")
def q_lower_columns(spark, d):
    c = T(spark, d, "customer")
    return lower_columns(c.toDF(*[x.upper() for x in c.columns]))


@register("prefix_columns", """
SELECT n_nationkey AS nation__n_nationkey, n_name AS nation__n_name, n_regionkey AS nation__n_regionkey FROM nation
""")
def q_prefix_columns(spark, d):
    return prefix_columns(T(spark, d, "nation"), "nation")


@register("trim_strings", """
SELECT doc_id, trim(text) AS text, trim(lang) AS lang, trim(source) AS source, n_chars FROM documents
""")
def q_trim_strings(spark, d):
    return trim_strings(T(spark, d, "documents"))


@register("derive_columns", """
WITH b1 AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS order_year,
  CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS price_band
  FROM orders)
SELECT o_orderkey, order_year, price_band, order_year::VARCHAR || '-' || price_band AS label FROM b1
""")
def q_derive_columns(spark, d):
    o = T(spark, d, "orders")
    out = derive(
        o,
        {"order_year": F.year("o_orderdate"),
         "price_band": F.when(F.col("o_totalprice") >= 300000, "high").when(F.col("o_totalprice") >= 100000, "mid").otherwise("low")},
        {"label": F.concat(F.col("order_year").cast("string"), F.lit("-"), F.col("price_band"))},
    )
    return out.select("o_orderkey", "order_year", "price_band", "label")


@register("project_spec", """
SELECT o_orderkey::VARCHAR AS order_id, 'TPCH' AS id_system, 'usual' AS id_use, NULL::VARCHAR AS id_type,
  NULL::DOUBLE AS discount_placeholder, true AS active, o_orderstatus AS status, o_custkey AS customer_key
FROM orders
""")
def q_project_spec(spark, d):
    spec = [
        (F.col("o_orderkey").cast("string"), "order_id"),
        (const("TPCH"), "id_system"),
        (const("usual"), "id_use"),
        (null_as("string"), "id_type"),
        (null_as("double"), "discount_placeholder"),
        (const(True), "active"),
        ("o_orderstatus", "status"),
        ("o_custkey", "customer_key"),
    ]
    return project(T(spark, d, "orders"), spec)


# ---------------------------------------------------------------------------- C
@register("filter_isin", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE trim(o_orderpriority) IN ('1-URGENT', '2-HIGH')
""")
def q_filter_isin(spark, d):
    return T(spark, d, "orders").filter(isin_trimmed("o_orderpriority", ["1-URGENT", "2-HIGH"])).select(
        "o_orderkey", "o_orderpriority")


@register("filter_ci_equals", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey WHERE lower(r.r_name) = 'asia'
""")
def q_filter_ci_equals(spark, d):
    c = T(spark, d, "customer")
    chain = lookup_chain(c, [
        Lookup(T(spark, d, "nation"), "c_nationkey", "n_nationkey", "inner"),
        Lookup(T(spark, d, "region"), "n_regionkey", "r_regionkey", "inner", where=F.lower(F.col("r_name")) == "asia"),
    ])
    return chain.select("c_custkey", "n_name", "r_name")


_NAME_PARTS = """
  c_custkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE split_part(c_name, '#', 1) END AS first_name,
  CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN NULL ELSE c_mktsegment END AS middle_name,
  CASE WHEN c_acctbal > 9000 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name
"""


def _name_parts(spark, d):
    c = T(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.split_part("c_name", F.lit("#"), F.lit(1))).alias("first_name"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), None).otherwise(F.col("c_mktsegment")).alias("middle_name"),
        F.when(F.col("c_acctbal") > 9000, None).otherwise(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("last_name"),
    )


@register("full_name", f"""
WITH p AS (SELECT {_NAME_PARTS} FROM customer)
SELECT c_custkey,
  coalesce(first_name, '') ||
  CASE WHEN first_name IS NOT NULL AND middle_name IS NOT NULL THEN ' ' ELSE '' END ||
  coalesce(middle_name, '') ||
  CASE WHEN (first_name IS NOT NULL OR middle_name IS NOT NULL) AND last_name IS NOT NULL THEN ' ' ELSE '' END ||
  coalesce(last_name, '') AS full_name
FROM p
""")
def q_full_name(spark, d):
    p = _name_parts(spark, d)
    return p.select("c_custkey", full_name("first_name", "middle_name", "last_name").alias("full_name"))


@register("padded_name", f"""
WITH p AS (SELECT {_NAME_PARTS} FROM customer)
SELECT c_custkey, trim(coalesce(first_name, ' ') || coalesce(middle_name, ' ') || coalesce(last_name, ' ')) AS padded_name
FROM p
""")
def q_padded_name(spark, d):
    p = _name_parts(spark, d)
    return p.select("c_custkey", padded_name("first_name", "middle_name", "last_name").alias("padded_name"))


_SHIFTS = """
  CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS s1,
  l_linestatus AS s2
"""


@register("first_non_empty", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SHIFTS} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s1 <> '' THEN s1 ELSE s2 END AS shift FROM x
""")
def q_first_non_empty(spark, d):
    li = T(spark, d, "lineitem")
    x = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") == "A", None).otherwise(F.col("l_returnflag")).alias("s1"),
        F.col("l_linestatus").alias("s2"),
    )
    return x.select("l_orderkey", "l_linenumber", "l_partkey", first_non_empty("s1", "s2").alias("shift"))


# ---------------------------------------------------------------------------- D
@register("lookup_inner", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
JOIN (SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'AFRICA') n
  ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def q_lookup_inner(spark, d):
    nation = T(spark, d, "nation")
    region = T(spark, d, "region")
    coded = lookup(nation, Lookup(region, "n_regionkey", "r_regionkey", "inner", select=["r_name"],
                                  where=F.col("r_name") != "AFRICA")).select("n_nationkey", "n_name", "r_name")
    return lookup(T(spark, d, "customer"), Lookup(coded, "c_nationkey", "n_nationkey", "inner")).select(
        "c_custkey", "n_name", "r_name")


@register("lookup_left", """
SELECT c.c_custkey, n.n_name FROM customer c
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON c.c_nationkey = n.n_nationkey
""")
def q_lookup_left(spark, d):
    nation = T(spark, d, "nation").filter(F.col("n_regionkey") != 0)
    return lookup(T(spark, d, "customer"), Lookup(nation, "c_nationkey", "n_nationkey", "left", select=["n_name"])).select(
        "c_custkey", "n_name")


@register("lookup_chain", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, s.s_name, n.n_name AS supplier_nation
FROM lineitem l
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
""")
def q_lookup_chain(spark, d):
    li = T(spark, d, "lineitem")
    out = lookup_chain(li, [
        Lookup(T(spark, d, "part"), "l_partkey", "p_partkey", "left", select=["p_name"]),
        Lookup(T(spark, d, "supplier"), "l_suppkey", "s_suppkey", "left", select=["s_name", "s_nationkey"]),
        Lookup(T(spark, d, "nation"), "s_nationkey", "n_nationkey", "left", select=["n_name"]),
    ])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "s_name", F.col("n_name").alias("supplier_nation"))


@register("join_trimmed_key", """
SELECT c.c_custkey, n.n_name FROM customer c
JOIN nation n ON trim('NATION_' || c.c_nationkey::VARCHAR || '  ') = trim('  ' || n.n_name)
""")
def q_join_trimmed_key(spark, d):
    c = T(spark, d, "customer").withColumn("nation_code", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("  ")))
    n = T(spark, d, "nation").withColumn("code", F.concat(F.lit("  "), F.col("n_name")))
    return lookup(c, Lookup(n, "nation_code", "code", "inner", select=["n_name"], trim=True)).select("c_custkey", "n_name")


@register("join_back", """
WITH a AS (SELECT o_custkey, count(*) AS customer_orders, max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, o.o_custkey, a.customer_orders, a.max_price FROM orders o JOIN a USING (o_custkey)
""")
def q_join_back(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = join_back(o, "o_custkey", [F.count(F.lit(1)).alias("customer_orders"), F.max("o_totalprice").alias("max_price")])
    return out.select("o_orderkey", "o_custkey", "customer_orders", "max_price")


@register("lookup_distinct", """
SELECT o.o_orderkey, f.l_returnflag FROM orders o
LEFT JOIN (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) f ON o.o_orderkey = f.l_orderkey
""")
def q_lookup_distinct(spark, d):
    flags = T(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return lookup(T(spark, d, "orders"), Lookup(flags, "o_orderkey", "l_orderkey", "left", distinct=True)).select("o_orderkey", "l_returnflag")


@register("attach_satellites", """
WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, sum(o_totalprice)::DECIMAL(18,2) AS order_value
           FROM orders GROUP BY o_custkey),
     l AS (SELECT oo.o_custkey AS c_custkey, count(*) AS n_lines FROM lineitem JOIN orders oo ON l_orderkey = oo.o_orderkey
           GROUP BY oo.o_custkey)
SELECT c.c_custkey, o.n_orders, o.order_value::VARCHAR AS order_value, l.n_lines::VARCHAR AS n_lines
FROM customer c JOIN o USING (c_custkey) LEFT JOIN l USING (c_custkey)
""")
def q_attach_satellites(spark, d):
    o = T(spark, d, "orders")
    # lines are counted by order first, so the join moves one row an order
    li = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    oagg = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("order_value"))
    lagg = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == o["o_orderkey"]).groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("n_lines"))
    spine = attach(T(spark, d, "customer").select("c_custkey"), oagg, "c_custkey", "inner")
    spine = attach(spine, lagg, "c_custkey", "left")
    return spine.select("c_custkey", "n_orders", F.col("order_value").cast("decimal(18,2)").cast("string").alias("order_value"),
                        F.col("n_lines").cast("string").alias("n_lines"))


@register("join_double_match", """
SELECT l.l_orderkey, l.l_linenumber, p1.p_name, p2.p_brand FROM lineitem l
JOIN part p1 ON l.l_partkey = p1.p_partkey
JOIN (SELECT * FROM part WHERE p_size > 10) p2 ON l.l_partkey = p2.p_partkey
""")
def q_join_double_match(spark, d):
    part = T(spark, d, "part")
    p2 = part.filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("p2_partkey"), "p_brand")
    out = lookup_chain(T(spark, d, "lineitem"), [
        Lookup(part, "l_partkey", "p_partkey", "inner", select=["p_name"]),
        Lookup(p2, "l_partkey", "p2_partkey", "inner"),
    ])
    return out.select("l_orderkey", "l_linenumber", "p_name", "p_brand")


# ---------------------------------------------------------------------------- E
def _order_struct():
    return shape([
        ("reference_id", surrogate_key("o_orderkey", "o_orderstatus", "o_orderdate")),
        ("order_key", F.col("o_orderkey")),
        ("status", F.col("o_orderstatus")),
        ("order_date", iso_ts("o_orderdate")),
    ])


_ORDER_STRUCT_SQL = """struct_pack(
    reference_id := md5(coalesce(o_orderkey::VARCHAR,'NA') || coalesce(o_orderstatus,'NA') || coalesce(o_orderdate::VARCHAR,'NA')),
    order_key := o_orderkey, status := o_orderstatus,
    order_date := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"""
_ORDER_TEXT_SQL = """array_to_string(list_transform({arr}, lambda x: concat_ws('|', coalesce(x.reference_id, '~'),
    coalesce(x.order_key::VARCHAR, '~'), coalesce(x.status, '~'), coalesce(x.order_date, '~'))), ';')"""
ORDER_FIELDS = ["reference_id", "order_key", "status", "order_date"]


@register("nest_list", f"""
SELECT o_custkey, {_ORDER_TEXT_SQL.format(arr="list_sort(list(" + _ORDER_STRUCT_SQL + "), 'DESC')")} AS orders
FROM orders GROUP BY o_custkey
""")
def q_nest_list(spark, d):
    out = nest_many(T(spark, d, "orders"), "o_custkey", {"orders": Nest(_order_struct(), "desc")})
    return out.select("o_custkey", arr_text("orders", ORDER_FIELDS).alias("orders"))


@register("nest_list_salted", f"""
SELECT o_custkey, {_ORDER_TEXT_SQL.format(arr="list_sort(list(" + _ORDER_STRUCT_SQL + "), 'DESC')")} AS orders,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS priorities
FROM orders GROUP BY o_custkey
""")
def q_nest_list_salted(spark, d):
    out = nest_many(T(spark, d, "orders"), "o_custkey", {
        "orders": Nest(_order_struct(), "desc"),
        "priorities": Nest(F.col("o_orderpriority"), "asc", distinct=True),
    }, salt_buckets=8)
    return out.select("o_custkey", arr_text("orders", ORDER_FIELDS).alias("orders"), arr_text("priorities").alias("priorities"))


@register("nest_set", """
SELECT l_orderkey,
  array_to_string(list_transform(list_sort(list(DISTINCT struct_pack(flag := l_returnflag, status := l_linestatus)), 'DESC'),
    lambda x: concat_ws('|', coalesce(x.flag, '~'), coalesce(x.status, '~'))), ';') AS flags
FROM lineitem GROUP BY l_orderkey
""")
def q_nest_set(spark, d):
    v = shape([("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus"))])
    out = nest_many(T(spark, d, "lineitem"), "l_orderkey", {"flags": Nest(v, "desc", distinct=True)})
    return out.select("l_orderkey", arr_text("flags", ["flag", "status"]).alias("flags"))


@register("nest_scalar_set", """
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS priorities FROM orders GROUP BY o_custkey
""")
def q_nest_scalar_set(spark, d):
    out = nest_many(T(spark, d, "orders"), "o_custkey", {"priorities": Nest(F.col("o_orderpriority"), "asc", distinct=True)})
    return out.select("o_custkey", arr_text("priorities").alias("priorities"))


@register("nest_multikey", """
SELECT l_orderkey, l_returnflag,
  array_to_string(list_transform(list_sort(list(struct_pack(part := l_partkey, supp := l_suppkey, line := l_linenumber,
    qty := l_quantity::DECIMAL(12,2))), 'DESC'),
    lambda x: concat_ws('|', x.part::VARCHAR, x.supp::VARCHAR, x.line::VARCHAR, x.qty::VARCHAR)), ';') AS lines
FROM lineitem GROUP BY l_orderkey, l_returnflag
""")
def q_nest_multikey(spark, d):
    v = shape([("part", F.col("l_partkey")), ("supp", F.col("l_suppkey")), ("line", F.col("l_linenumber")),
               ("qty", F.col("l_quantity").cast("decimal(12,2)"))])
    out = nest_many(T(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], {"lines": Nest(v, "desc")})
    return out.select("l_orderkey", "l_returnflag", arr_text("lines", ["part", "supp", "line", "qty"]).alias("lines"))


@register("nest_many", """
SELECT l_orderkey,
  array_to_string(list_transform(list_sort(list(struct_pack(part := l_partkey, supp := l_suppkey, line := l_linenumber)), 'DESC'),
    lambda x: concat_ws('|', x.part::VARCHAR, x.supp::VARCHAR, x.line::VARCHAR)), ';') AS lines,
  array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags,
  array_to_string(list_sort(list(DISTINCT l_linestatus), 'DESC'), ';') AS statuses,
  count(*) AS n_lines
FROM lineitem GROUP BY l_orderkey
""")
def q_nest_many(spark, d):
    v = shape([("part", F.col("l_partkey")), ("supp", F.col("l_suppkey")), ("line", F.col("l_linenumber"))])
    out = nest_many(T(spark, d, "lineitem"), "l_orderkey", {
        "lines": Nest(v, "desc"),
        "flags": Nest(F.col("l_returnflag"), "asc", distinct=True),
        "statuses": Nest(F.col("l_linestatus"), "desc", distinct=True),
        "n_lines": F.count(F.lit(1)),
    })
    return out.select("l_orderkey", arr_text("lines", ["part", "supp", "line"]).alias("lines"),
                      arr_text("flags").alias("flags"), arr_text("statuses").alias("statuses"), "n_lines")


@register("nest_concat", """
SELECT o_custkey,
  array_to_string(list_transform(list_sort(list_concat(
      list(struct_pack(kind := 'status', code := o_orderstatus, k := o_orderkey)),
      list(struct_pack(kind := 'priority', code := o_orderpriority, k := o_orderkey)))),
    lambda x: x.kind || '|' || x.code || '|' || x.k::VARCHAR), ';') AS codes
FROM orders GROUP BY o_custkey
""")
def q_nest_concat(spark, d):
    a = shape([("kind", F.lit("status")), ("code", F.col("o_orderstatus")), ("k", F.col("o_orderkey"))])
    b = shape([("kind", F.lit("priority")), ("code", F.col("o_orderpriority")), ("k", F.col("o_orderkey"))])
    out = nest_many(T(spark, d, "orders"), "o_custkey", {"codes": NestConcat([a, b], "asc")})
    return out.select("o_custkey", arr_text("codes", ["kind", "code", "k"]).alias("codes"))


@register("collect_conditional", """
SELECT o_custkey,
  array_to_string(list_sort(coalesce(list(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O')), []), 'DESC'), ';') AS closed_or_open,
  array_to_string(list_sort(coalesce(list(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), []), 'DESC'), ';') AS other,
  max(o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS top_status
FROM orders GROUP BY o_custkey
""")
def q_collect_conditional(spark, d):
    s = F.col("o_orderstatus")
    out = nest_many(T(spark, d, "orders"), "o_custkey", {
        "closed_or_open": Nest(F.when(s.isin("F", "O"), s), "desc", distinct=True),
        "other": Nest(F.when(~s.isin("F", "O"), s), "desc", distinct=True),
    })
    return out.select("o_custkey", arr_text("closed_or_open").alias("closed_or_open"), arr_text("other").alias("other"),
                      first_of("closed_or_open").alias("top_status"))


@register("primary_of_list", """
WITH a AS (SELECT o_custkey, list_sort(list(struct_pack(priority := o_orderpriority, k := o_orderkey))) AS l
           FROM orders GROUP BY o_custkey)
SELECT o_custkey, l[1].priority AS primary_priority, l[1].k AS primary_order, len(l)::INTEGER AS n FROM a
""")
def q_primary_of_list(spark, d):
    v = shape([("priority", F.col("o_orderpriority")), ("k", F.col("o_orderkey"))])
    out = nest_many(T(spark, d, "orders"), "o_custkey", {"l": Nest(v, "asc")})
    return out.select("o_custkey", first_field("l", "priority").alias("primary_priority"),
                      primary_of(F.col("l"), "k").alias("primary_order"), F.size("l").alias("n"))


# ---------------------------------------------------------------------------- H
_LI_ORDER_SQL = "struct_pack(a := l_partkey, b := l_suppkey, c := l_quantity, d := l_extendedprice, e := l_shipdate)"


@register("dedupe_first", f"""
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, {_LI_ORDER_SQL}) AS l_partkey,
  arg_min(l_suppkey, {_LI_ORDER_SQL}) AS l_suppkey, arg_min(l_returnflag, {_LI_ORDER_SQL}) AS l_returnflag
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def q_dedupe_first(spark, d):
    li = T(spark, d, "lineitem").withColumn(
        "ord", F.struct(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("c"),
                        F.col("l_extendedprice").alias("d"), F.col("l_shipdate").alias("e")))
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "ord")
    return dedupe_first(x, ["l_orderkey", "l_linenumber"], "ord").drop("ord")


@register("last_per_key", f"""
SELECT l_orderkey, l_linenumber, arg_max(l_partkey, {_LI_ORDER_SQL}) AS l_partkey,
  arg_max(l_suppkey, {_LI_ORDER_SQL}) AS l_suppkey, arg_max(l_returnflag, {_LI_ORDER_SQL}) AS l_returnflag
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def q_last_per_key(spark, d):
    li = T(spark, d, "lineitem").withColumn(
        "ord", F.struct(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("c"),
                        F.col("l_extendedprice").alias("d"), F.col("l_shipdate").alias("e")))
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "ord")
    return last_per_key(x, ["l_orderkey", "l_linenumber"], "ord").drop("ord")


# ---------------------------------------------------------------------------- I
_KEY_PARTS_SQL = """l_orderkey::VARCHAR AS a, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS b,
  CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS c, l_shipdate AS dt"""


@register("surrogate_key", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_KEY_PARTS_SQL} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  md5(coalesce(a, 'NA') || coalesce(b, 'NA') || coalesce(c, 'NA')) AS key_na,
  md5(coalesce(a, '') || coalesce(b, '') || coalesce(dt::DATE::VARCHAR, '')) AS key_empty,
  md5(a || b || c) AS key_strict
FROM x
""")
def q_surrogate_key(spark, d):
    li = T(spark, d, "lineitem")
    x = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("a"),
        F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag")).alias("b"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_linestatus")).alias("c"),
        F.to_date("l_shipdate").alias("dt"),
    )
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        surrogate_key("a", "b", "c", null="NA").alias("key_na"),
        surrogate_key("a", "b", "dt", null="").alias("key_empty"),
        surrogate_key("a", "b", "c", null=None).alias("key_strict"),
    )


@register("split_code", """
WITH x AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 5, '0') ||
  CASE WHEN p_size > 25 THEN '-' || lpad((p_size * 97)::VARCHAR, 4, '0') ELSE '' END AS code FROM part)
SELECT p_partkey, code, substring(code, 1, 5) AS code_base, substring(code, 7, 10) AS code_ext FROM x
""")
def q_split_code(spark, d):
    p = T(spark, d, "part")
    x = p.select("p_partkey", F.concat(
        F.lpad(F.col("p_partkey").cast("string"), 5, "0"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("-"), F.lpad((F.col("p_size") * 97).cast("string"), 4, "0"))).otherwise(F.lit(""))
    ).alias("code"))
    ext = split_code("code")[1]
    base = split_code("code")[0]
    # the extension is derived from the original code before the base replaces it
    return x.withColumn("code_ext", ext).withColumn("code_base", base).select("p_partkey", "code", "code_base", "code_ext")


PRIORITY_CODES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


@register("translate_codes", """
SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE '' END AS p_else_empty,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' END AS p_else_null,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE o_orderpriority END
    AS p_else_self
FROM orders
""")
def q_translate_codes(spark, d):
    o = T(spark, d, "orders")
    return o.select(
        "o_orderkey",
        translate("o_orderpriority", PRIORITY_CODES, "").alias("p_else_empty"),
        translate("o_orderpriority", PRIORITY_CODES, None).alias("p_else_null"),
        translate("o_orderpriority", PRIORITY_CODES, keep_other=True).alias("p_else_self"),
    )


EVENT_CLASSES = {"engagement": ["view", "click"], "revenue": ["purchase"], "lifecycle": ["signup"]}


@register("classify_lists", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'engagement' WHEN event_type IN ('purchase') THEN 'revenue'
  WHEN event_type IN ('signup') THEN 'lifecycle' END AS event_class FROM events
""")
def q_classify_lists(spark, d):
    return T(spark, d, "events").select("event_id", classify("event_type", EVENT_CLASSES).alias("event_class"))


@register("yes_no", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN 'N' ELSE l_returnflag END AS flag FROM lineitem)
SELECT *, CASE WHEN flag = 'Y' THEN true WHEN flag = 'N' THEN false END AS returned FROM x
""")
def q_yes_no(spark, d):
    li = T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "A", "N").otherwise(F.col("l_returnflag")).alias("flag"))
    return li.withColumn("returned", yes_no("flag"))


@register("iso_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso FROM events
""")
def q_iso_timestamp(spark, d):
    return T(spark, d, "events").select("event_id", iso_ts("ts").alias("ts_iso"))


@register("year_of", """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS order_year, year(o_orderdate::DATE)::INTEGER AS order_year_date FROM orders
""")
def q_year_of(spark, d):
    o = T(spark, d, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").alias("order_year"), F.year(F.to_date("o_orderdate")).alias("order_year_date"))


@register("safe_casts", """
SELECT event_id, TRY_CAST(props AS INTEGER)::VARCHAR AS props_int,
  TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)::VARCHAR AS k_value,
  ts::DATE::VARCHAR AS ts_date, CAST(value AS DECIMAL(12,2))::VARCHAR AS value_text
FROM events
""")
def q_safe_casts(spark, d):
    e = T(spark, d, "events")
    return e.select(
        "event_id",
        F.col("props").try_cast("int").cast("string").alias("props_int"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").cast("string").alias("k_value"),
        F.to_date("ts").cast("string").alias("ts_date"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("value_text"),
    )


@register("base_name", """
WITH x AS (SELECT p_partkey, lower(p_brand) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '_') AS qualified FROM part)
SELECT p_partkey, qualified, split_part(qualified, '.', -1) AS last_segment, split_part(qualified, '.', 1) AS first_segment FROM x
""")
def q_base_name(spark, d):
    p = T(spark, d, "part").select("p_partkey", F.concat_ws(".", F.lower("p_brand"), F.lower("p_type"),
                                                              F.regexp_replace("p_name", " ", "_")).alias("qualified"))
    return p.select("p_partkey", "qualified", base_name("qualified").alias("last_segment"),
                    base_name("qualified", first=True).alias("first_segment"))


# ---------------------------------------------------------------------------- J
DAYS = {
    "ret": ("s_ret_1", "s_ret_2", "e_ret_1", "e_ret_2"),
    "line": ("s_line_1", "s_line_2", "e_line_1", "e_line_2"),
    "qty": ("s_qty_1", "s_qty_2", "e_qty_1", "e_qty_2"),
    "tax": ("s_tax_1", "s_tax_2", "e_tax_1", "e_tax_2"),
}


def _shifts(li: DataFrame) -> DataFrame:
    """Four lineitem measures read as weekly-schedule "days" with two shifts:
    the first shift is empty or NULL for some rows so the fallback is used."""
    def blank_if(c, cond):
        return F.when(cond, F.lit("")).otherwise(c)

    q = F.col("l_quantity").cast("int").cast("string")
    t = F.col("l_tax").cast("decimal(6,2)").cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        blank_if(F.col("l_returnflag"), F.col("l_returnflag") == "N").alias("s_ret_1"), F.lit("X").alias("s_ret_2"),
        F.col("l_linestatus").alias("e_ret_1"), F.lit("Y").alias("e_ret_2"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_linestatus")).alias("s_line_1"),
        F.col("l_returnflag").alias("s_line_2"),
        F.col("l_linenumber").cast("string").alias("e_line_1"), F.lit("0").alias("e_line_2"),
        blank_if(q, F.col("l_quantity") < 10).alias("s_qty_1"), F.lit("small").alias("s_qty_2"),
        q.alias("e_qty_1"), F.lit("-").alias("e_qty_2"),
        t.alias("s_tax_1"), F.lit("none").alias("s_tax_2"),
        blank_if(t, F.col("l_tax") > 0.05).alias("e_tax_1"), F.lit("high").alias("e_tax_2"),
    )


_SHIFTS_SQL = """
WITH li AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS s_ret_1, 'X' AS s_ret_2, l_linestatus AS e_ret_1, 'Y' AS e_ret_2,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS s_line_1, l_returnflag AS s_line_2,
    l_linenumber::VARCHAR AS e_line_1, '0' AS e_line_2,
    CASE WHEN l_quantity < 10 THEN '' ELSE l_quantity::INTEGER::VARCHAR END AS s_qty_1, 'small' AS s_qty_2,
    l_quantity::INTEGER::VARCHAR AS e_qty_1, '-' AS e_qty_2,
    l_tax::DECIMAL(6,2)::VARCHAR AS s_tax_1, 'none' AS s_tax_2,
    CASE WHEN l_tax > 0.05 THEN '' ELSE l_tax::DECIMAL(6,2)::VARCHAR END AS e_tax_1, 'high' AS e_tax_2
  FROM lineitem),
u AS (
  SELECT l_orderkey, l_linenumber, l_partkey, 'ret' AS day,
    CASE WHEN s_ret_1 <> '' THEN s_ret_1 ELSE s_ret_2 END AS st, CASE WHEN e_ret_1 <> '' THEN e_ret_1 ELSE e_ret_2 END AS en FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'line',
    CASE WHEN s_line_1 <> '' THEN s_line_1 ELSE s_line_2 END, CASE WHEN e_line_1 <> '' THEN e_line_1 ELSE e_line_2 END FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'qty',
    CASE WHEN s_qty_1 <> '' THEN s_qty_1 ELSE s_qty_2 END, CASE WHEN e_qty_1 <> '' THEN e_qty_1 ELSE e_qty_2 END FROM li
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax',
    CASE WHEN s_tax_1 <> '' THEN s_tax_1 ELSE s_tax_2 END, CASE WHEN e_tax_1 <> '' THEN e_tax_1 ELSE e_tax_2 END FROM li)
"""


@register("weekly_schedule", _SHIFTS_SQL + """
SELECT l_orderkey, array_to_string(list_transform(list_sort(list(struct_pack(
    ref := md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR), day := day, st := st, en := en))),
  lambda x: concat_ws('|', x.ref, x.day, coalesce(x.st, '~'), coalesce(x.en, '~'))), ';') AS schedule
FROM u GROUP BY l_orderkey
""")
def q_weekly_schedule(spark, d):
    li = _shifts(T(spark, d, "lineitem")).withColumn(
        "ref", F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                 F.col("l_partkey").cast("string"))))
    out = nest_schedules(li, "l_orderkey", DAYS, extra=[("ref", F.col("ref"))], day_field="day", start_field="st", end_field="en")
    return out.select("l_orderkey", arr_text("schedule", ["ref", "day", "st", "en"]).alias("schedule"))


@register("unpivot_schedule", _SHIFTS_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, day, st, en FROM u
""")
def q_unpivot_schedule(spark, d):
    """J4 as rows: one row per line item and "day", first non-empty shift."""
    li = _shifts(T(spark, d, "lineitem"))
    return unpivot_schedule(li, DAYS, keep=["l_orderkey", "l_linenumber", "l_partkey"], day_field="day",
                            start_field="st", end_field="en")


def _order_lists(spark, d):
    o = T(spark, d, "orders")
    li = T(spark, d, "lineitem")
    codes = nest_many(li, "l_orderkey", {
        "flags": Nest(F.col("l_returnflag"), "asc", distinct=True),
        "lines": Nest(shape([("number", F.col("l_linenumber")), ("type", F.col("l_linestatus"))]), "asc", distinct=True),
    }).withColumnRenamed("l_orderkey", "o_orderkey")
    return attach(o, codes, "o_orderkey", "left")


_ORDER_LISTS_SQL = """
WITH c AS (SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags,
             list_sort(list(DISTINCT struct_pack(number := l_linenumber, type := l_linestatus))) AS lines
           FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o.*, c.flags, c.lines FROM orders o LEFT JOIN c USING (o_orderkey))
"""


@register("merge_arrays", _ORDER_LISTS_SQL + """
SELECT o_orderkey,
  array_to_string(list_concat(coalesce(flags, []), [o_orderstatus], coalesce(flags, [])), ';') AS merged,
  array_to_string(list_sort(list_concat(coalesce(flags, []), [o_orderstatus])), ';') AS merged_sorted,
  len(list_concat(coalesce(flags, []), coalesce(flags, [])))::INTEGER AS n
FROM x
""")
def q_merge_arrays(spark, d):
    x = _order_lists(spark, d)
    return x.select(
        "o_orderkey",
        arr_text(merge_arrays("flags", F.array("o_orderstatus"), "flags")).alias("merged"),
        arr_text(merge_arrays("flags", F.array("o_orderstatus"), sort="asc")).alias("merged_sorted"),
        F.size(merge_arrays("flags", "flags")).alias("n"),
    )


def _identifier_lists(spark, d):
    o = T(spark, d, "orders")
    ident = shape([("identifier_type", F.col("o_orderpriority")), ("identifier", F.col("o_orderkey").cast("string")),
                   ("identifier_source", F.lit("orders"))])
    return nest_many(o, "o_custkey", {
        "ids": Nest(ident, "asc"),
        "status_ids": Nest(shape([("identifier_type", F.concat(F.lit("st_"), F.col("o_orderstatus"))),
                                  ("identifier", F.col("o_orderkey").cast("string")),
                                  ("identifier_source", F.lit("status"))]), "asc"),
    })


_IDS_SQL = """
WITH a AS (SELECT o_custkey,
  list_sort(list(struct_pack(identifier_type := o_orderpriority, identifier := o_orderkey::VARCHAR, identifier_source := 'orders'))) AS ids,
  list_sort(list(struct_pack(identifier_type := 'st_' || o_orderstatus, identifier := o_orderkey::VARCHAR, identifier_source := 'status'))) AS status_ids
  FROM orders GROUP BY o_custkey),
e AS (
  SELECT o_custkey, 'ids' AS which, CASE WHEN len(ids) = 1 THEN x.identifier_type ELSE x.identifier_type || '_' || i::VARCHAR END AS k,
         x.identifier_type || '|' || x.identifier || '|' || x.identifier_source AS v
  FROM a, unnest(ids) WITH ORDINALITY AS t(x, i)
  UNION ALL
  SELECT o_custkey, 'status', CASE WHEN len(status_ids) = 1 THEN x.identifier_type ELSE x.identifier_type || '_' || i::VARCHAR END,
         x.identifier_type || '|' || x.identifier || '|' || x.identifier_source
  FROM a, unnest(status_ids) WITH ORDINALITY AS t(x, i))
"""


@register("keyed_map", _IDS_SQL + """
SELECT o_custkey, string_agg(k || '=' || v, ';' ORDER BY k) AS identifiers, count(*)::INTEGER AS n FROM e WHERE which = 'ids' GROUP BY o_custkey
""")
def q_keyed_map(spark, d):
    a = _identifier_lists(spark, d)
    m = keyed_map("ids", "identifier_type")
    fields = ["identifier_type", "identifier", "identifier_source"]
    return a.select("o_custkey", map_text(m, fields).alias("identifiers"), F.size(m).alias("n"))


@register("merge_maps", _IDS_SQL + """
SELECT o_custkey, string_agg(k || '=' || v, ';' ORDER BY k) AS identifiers, count(*)::INTEGER AS n FROM e GROUP BY o_custkey
""")
def q_merge_maps(spark, d):
    a = _identifier_lists(spark, d)
    m = merge_maps(keyed_map("ids", "identifier_type"), keyed_map("status_ids", "identifier_type"), F.lit(None).cast(
        "map<string,struct<identifier_type:string,identifier:string,identifier_source:string>>"))
    fields = ["identifier_type", "identifier", "identifier_source"]
    return a.select("o_custkey", map_text(m, fields).alias("identifiers"), F.size(m).alias("n"))


def _qualifications(spark, d):
    """Per order: codes (distinct return flags), a struct list (line number /
    status) and qualification structs built from the order itself."""
    x = _order_lists(spark, d)
    qual = F.array(
        shape([("reference_id", F.col("o_orderkey").cast("string")), ("qualification_code", F.col("o_orderstatus")),
               ("qualification_number", F.lit(None).cast("int")), ("qualification_type", F.lit(None).cast("string")),
               ("taxonomy", F.col("o_orderpriority"))]),
        shape([("reference_id", F.col("o_custkey").cast("string")), ("qualification_code", F.lit("C")),
               ("qualification_number", F.lit(None).cast("int")), ("qualification_type", F.lit(None).cast("string")),
               ("taxonomy", F.lit(None).cast("string"))]),
    )
    return x.withColumn("quals", qual)


QUAL_FIELDS = ["reference_id", "qualification_code", "qualification_number", "qualification_type", "taxonomy"]
_QUALS_SQL = _ORDER_LISTS_SQL + """,
q AS (SELECT o_orderkey, flags, lines, [
    struct_pack(reference_id := o_orderkey::VARCHAR, qualification_code := o_orderstatus, qualification_number := NULL::INTEGER,
                qualification_type := NULL::VARCHAR, taxonomy := o_orderpriority),
    struct_pack(reference_id := o_custkey::VARCHAR, qualification_code := 'C', qualification_number := NULL::INTEGER,
                qualification_type := NULL::VARCHAR, taxonomy := NULL::VARCHAR)] AS quals FROM x)
"""
_QTEXT = """array_to_string(list_transform({a}, lambda z: concat_ws('|', coalesce(z.reference_id, '~'),
  coalesce(z.qualification_code, '~'), coalesce(z.qualification_number::VARCHAR, '~'), coalesce(z.qualification_type, '~'),
  coalesce(z.taxonomy, '~'))), ';')"""


@register("cross_apply_codes", _QUALS_SQL + f"""
SELECT o_orderkey,
  {_QTEXT.format(a='''CASE WHEN len(coalesce(flags, [])) > 0 THEN flatten(list_transform(flags, lambda t:
      list_transform(quals, lambda qq: struct_pack(reference_id := qq.reference_id, qualification_code := t,
        qualification_number := qq.qualification_number, qualification_type := qq.qualification_type, taxonomy := t))))
    ELSE quals END''')} AS qualifications
FROM q
""")
def q_cross_apply_codes(spark, d):
    x = _qualifications(spark, d)
    out = cross_apply("flags", "quals", {"qualification_code": lambda t, q: t, "taxonomy": lambda t, q: t})
    return x.select("o_orderkey", arr_text(out, QUAL_FIELDS).alias("qualifications"))


@register("cross_apply_structs", _QUALS_SQL + f"""
SELECT o_orderkey,
  {_QTEXT.format(a='''flatten(list_transform(lines, lambda t:
      list_transform(quals, lambda qq: struct_pack(reference_id := qq.reference_id, qualification_code := qq.qualification_code,
        qualification_number := t.number, qualification_type := t.type, taxonomy := qq.qualification_code))))''')} AS qualifications
FROM q
""")
def q_cross_apply_structs(spark, d):
    x = _qualifications(spark, d)
    out = cross_apply("lines", "quals", {
        "qualification_number": lambda t, q: t["number"],
        "qualification_type": lambda t, q: t["type"],
        "taxonomy": lambda t, q: q["qualification_code"],
    }, keep_when_empty=False)
    return x.select("o_orderkey", arr_text(out, QUAL_FIELDS).alias("qualifications"))


@register("distinct_groups", """
WITH g AS (SELECT o_custkey, list(list_sort(g0)) AS groups FROM (
    SELECT o.o_custkey, o.o_orderkey, list(DISTINCT l.l_returnflag) AS g0
    FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey) GROUP BY o_custkey)
SELECT o_custkey, len(flatten(list_distinct(groups)))::INTEGER AS n_distinct_group_elems, len(flatten(groups))::INTEGER AS n_all_elems FROM g
""")
def q_distinct_groups(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = T(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    per_order = nest_many(li.join(o, li["l_orderkey"] == o["o_orderkey"]), ["o_custkey", "o_orderkey"],
                          {"g0": Nest(F.col("l_returnflag"), "asc", distinct=True)})
    g = per_order.groupBy("o_custkey").agg(F.collect_list("g0").alias("groups"))
    return g.select("o_custkey", F.size(distinct_groups("groups")).alias("n_distinct_group_elems"),
                    F.size(F.flatten("groups")).alias("n_all_elems"))


@register("pick_first", f"""
WITH a AS (SELECT o_custkey, list_sort(list({_ORDER_STRUCT_SQL}), 'DESC') AS orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, (list_filter(orders, lambda x: x.status = 'F'))[1].order_key::VARCHAR AS first_f_order,
  (list_filter(orders, lambda x: x.status = 'F'))[1].order_date AS first_f_date,
  (list_filter(orders, lambda x: x.status = 'Z'))[1].order_key::VARCHAR AS never
FROM a
""")
def q_pick_first(spark, d):
    a = nest_many(T(spark, d, "orders"), "o_custkey", {"orders": Nest(_order_struct(), "desc")})
    hit = pick("orders", lambda x: x["status"] == "F")
    return a.select("o_custkey", hit["order_key"].cast("string").alias("first_f_order"), hit["order_date"].alias("first_f_date"),
                    pick("orders", lambda x: x["status"] == "Z", "order_key").cast("string").alias("never"))


@register("role_of_codes", """
WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))) AS codes
           FROM orders GROUP BY o_custkey)
SELECT o_custkey,
  CASE WHEN len(coalesce(codes, [])) > 1 THEN true WHEN len(codes) = 1 AND codes[1] = 'P' THEN true
       WHEN len(codes) = 1 AND codes[1] = 'S' THEN false WHEN len(codes) = 1 AND codes[1] = 'B' THEN true END AS pcp_ind,
  CASE WHEN len(coalesce(codes, [])) > 1 THEN 'Both PCP and Specialist' WHEN len(codes) = 1 AND codes[1] = 'P' THEN 'PCP'
       WHEN len(codes) = 1 AND codes[1] = 'S' THEN 'Specialist' WHEN len(codes) = 1 AND codes[1] = 'B' THEN 'Both PCP and Specialist'
  END AS service_provider_role
FROM a
""")
def q_role_of_codes(spark, d):
    o = T(spark, d, "orders")
    code = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus"))
    a = nest_many(o, "o_custkey", {"codes": Nest(code, "asc", distinct=True)})
    r = role_of("codes")
    return a.select("o_custkey", r["pcp_ind"].alias("pcp_ind"), r["service_provider_role"].alias("service_provider_role"))


# ---------------------------------------------------------------------------- L
ORDER_RULES = """
Orders
    o_orderkey must not be null
    length(o_orderpriority) must be 5
    o_orderdate should be less than now
    o_orderdate should be greater than '1996-01-01'
    o_orderstatus should be in ['F','O']
    o_totalprice should be less than 400000
    o_custkey must be o_orderkey
"""
DQ_NOW = "2000-01-01 00:00:00"
_DQ_CHECKS_SQL = f"""
  [struct_pack(rule := 'o_orderkey must not be null', col := 'o_orderkey', sev := 'error', ok := o_orderkey IS NOT NULL),
   struct_pack(rule := 'length(o_orderpriority) must be 5', col := 'o_orderpriority', sev := 'error',
               ok := coalesce(length(o_orderpriority) = 5, false)),
   struct_pack(rule := 'o_orderdate should be less than now', col := 'o_orderdate', sev := 'warning',
               ok := coalesce(o_orderdate < TIMESTAMP '{DQ_NOW}', false)),
   struct_pack(rule := 'o_orderdate should be greater than ''1996-01-01''', col := 'o_orderdate', sev := 'warning',
               ok := coalesce(o_orderdate > TIMESTAMP '1996-01-01 00:00:00', false)),
   struct_pack(rule := 'o_orderstatus should be in [''F'',''O'']', col := 'o_orderstatus', sev := 'warning',
               ok := coalesce(o_orderstatus IN ('F', 'O'), false)),
   struct_pack(rule := 'o_totalprice should be less than 400000', col := 'o_totalprice', sev := 'warning',
               ok := coalesce(o_totalprice < 400000.0, false)),
   struct_pack(rule := 'o_custkey must be o_orderkey', col := 'o_custkey', sev := 'error',
               ok := coalesce(o_custkey::VARCHAR = o_orderkey::VARCHAR, false))]
"""


def _dq_orders(spark, d):
    return apply_rules(T(spark, d, "orders"), ORDER_RULES, now=F.lit(DQ_NOW).cast("timestamp"))


@register("dq_apply", f"""
SELECT o_orderkey, array_to_string(list_transform({_DQ_CHECKS_SQL}, lambda x: x.col || '|' || x.sev || '|' || x.ok::VARCHAR), ';')
  AS results FROM orders
""")
def q_dq_apply(spark, d):
    df = _dq_orders(spark, d)
    return df.select("o_orderkey", arr_text("dq_results", ["column", "severity", "passed"]).alias("results"))


@register("dq_flatten", f"""
SELECT o_orderkey, array_to_string(list_transform(list_filter({_DQ_CHECKS_SQL}, lambda x: NOT x.ok), lambda x: x.rule), ';')
  AS data_quality_result, len(list_filter({_DQ_CHECKS_SQL}, lambda x: NOT x.ok))::INTEGER AS failures FROM orders
""")
def q_dq_flatten(spark, d):
    df = flatten_results(_dq_orders(spark, d))
    return df.select("o_orderkey", F.array_join(F.transform("data_quality_result", lambda x: x["rule"]), ";").alias("data_quality_result"),
                     F.size("data_quality_result").alias("failures"))


@register("dq_summary", f"""
SELECT x.rule AS rule, x.col AS "column", x.sev AS severity, count(*) AS failures
FROM (SELECT unnest(list_filter({_DQ_CHECKS_SQL}, lambda x: NOT x.ok)) AS x FROM orders) GROUP BY ALL
""")
def q_dq_summary(spark, d):
    return dq_summary(flatten_results(_dq_orders(spark, d)))
