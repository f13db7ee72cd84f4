"""Registered queries: each reads the given tables (or data Spark derives from
them) and exercises one operator family over the WHOLE tables.  Each Spark
query has the equivalent DuckDB SQL next to it (``None`` when an operator is
not expressible in SQL; those are covered by fixture tests instead).

Nested results are flattened to text with ``plans.canonical`` so the two
engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.plans.canonical import arr_text
from tapestry.plans.customer import customer_profile
from tapestry.sources.catalog import load_tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, d: str, names=TABLES) -> dict[str, DataFrame]:
    return load_tables(spark, d, names)


# ---------------------------------------------------------------------------
# Entity profile (flagship): B1-B3, B6, B7, D2, D3, D8, E1-E5, I1, I4, I8, I12,
# J1-J3, J10, J14, L2-L9
# ---------------------------------------------------------------------------
ORDER_FIELDS = ["reference_id", "order_key", "status", "total_price", "order_date", "priority"]


def profile_text(df: DataFrame) -> DataFrame:
    return df.select(
        "customer_id", "customer_id_system", "customer_name", "display_name",
        F.col("account_balance").cast("string").alias("account_balance"),
        "market_segment", "nation_name", "region_name",
        arr_text("orders", ORDER_FIELDS).alias("orders"),
        arr_text("order_statuses").alias("order_statuses"),
        "pcp_ind", "service_provider_role",
        F.col("latest_open_order").cast("string").alias("first_open_order"),
        arr_text("all_codes").alias("all_codes"),
        F.date_format("first_order_date", "yyyy-MM-dd HH:mm:ss").alias("first_order_date"),
        "alternate_id", "source_id",
        F.array_join(F.transform("data_quality_result", lambda x: x["rule"]), ";").alias("dq_failures"),
    )


SQL_PROFILE = r"""
WITH o AS (
  SELECT o_custkey AS k,
    list_sort(list(struct_pack(
        reference_id := md5(coalesce(o_orderkey::VARCHAR,'NA') || coalesce(o_orderstatus,'NA') || coalesce(o_orderdate::VARCHAR,'NA')),
        order_key := o_orderkey, status := o_orderstatus, total_price := o_totalprice::DECIMAL(18,2),
        order_date := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z',
        priority := CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
                    WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified'
                    WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END)), 'DESC') AS orders,
    list_sort(list(DISTINCT o_orderstatus)) AS order_statuses,
    min(o_orderdate) AS first_order_date
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT oo.o_custkey AS k, list_sort(list(DISTINCT l_returnflag)) AS return_flags,
         list_sort(list(DISTINCT l_linestatus)) AS line_statuses
  FROM lineitem JOIN orders oo ON l_orderkey = oo.o_orderkey GROUP BY oo.o_custkey),
p AS (
  SELECT c.c_custkey::VARCHAR AS customer_id, 'TPCH' AS customer_id_system, c.c_name AS customer_name,
    concat_ws(' ', c.c_name, c.c_mktsegment) AS display_name,
    c.c_acctbal::DECIMAL(18,2) AS account_balance, c.c_mktsegment AS market_segment,
    n.n_name AS nation_name, r.r_name AS region_name,
    coalesce(o.orders, []) AS orders, coalesce(o.order_statuses, []) AS order_statuses,
    CASE WHEN len(coalesce(o.order_statuses, [])) > 1 THEN true
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'P' THEN true
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'S' THEN false
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'B' THEN true END AS pcp_ind,
    CASE WHEN len(coalesce(o.order_statuses, [])) > 1 THEN 'Both PCP and Specialist'
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'P' THEN 'PCP'
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'S' THEN 'Specialist'
         WHEN len(coalesce(o.order_statuses, [])) = 1 AND o.order_statuses[1] = 'B' THEN 'Both PCP and Specialist' END
      AS service_provider_role,
    (list_filter(o.orders, lambda x: x.status = 'O'))[1].order_key AS first_open_order,
    list_sort(list_concat(coalesce(o.order_statuses, []), coalesce(l.return_flags, []), coalesce(l.line_statuses, [])))
      AS all_codes,
    o.first_order_date,
    NULL::VARCHAR AS alternate_id, c.c_custkey::VARCHAR AS source_id
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN o ON o.k = c.c_custkey
  LEFT JOIN l ON l.k = c.c_custkey)
SELECT customer_id, customer_id_system, customer_name, display_name, account_balance::VARCHAR AS account_balance,
  market_segment, nation_name, region_name,
  array_to_string(list_transform(orders, lambda x: concat_ws('|', coalesce(x.reference_id::VARCHAR, '~'),
     coalesce(x.order_key::VARCHAR, '~'), coalesce(x.status::VARCHAR, '~'), coalesce(x.total_price::VARCHAR, '~'),
     coalesce(x.order_date::VARCHAR, '~'), coalesce(x.priority::VARCHAR, '~'))), ';') AS orders,
  array_to_string(list_transform(order_statuses, lambda x: coalesce(x::VARCHAR, '~')), ';') AS order_statuses,
  pcp_ind, service_provider_role, first_open_order::VARCHAR AS first_open_order,
  array_to_string(list_transform(all_codes, lambda x: coalesce(x::VARCHAR, '~')), ';') AS all_codes,
  strftime(first_order_date, '%Y-%m-%d %H:%M:%S') AS first_order_date,
  alternate_id, source_id,
  concat_ws(';',
    CASE WHEN customer_id IS NULL THEN 'customer_id must not be null' END,
    CASE WHEN coalesce(length(customer_name) = 18, false) = false THEN 'length(customer_name) must be 18' END,
    CASE WHEN nation_name IS NULL THEN 'nation_name must not be null' END,
    CASE WHEN coalesce(TRY_CAST(account_balance AS DOUBLE) > 0.0, false) = false THEN 'account_balance should be greater than 0' END,
    CASE WHEN coalesce(market_segment IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'), false) = false
         THEN 'market_segment should be in [''AUTOMOBILE'',''BUILDING'',''FURNITURE'',''HOUSEHOLD'',''MACHINERY'']' END,
    CASE WHEN coalesce(first_order_date > TIMESTAMP '1995-06-01 00:00:00', false) = false
         THEN 'first_order_date should be greater than ''1995-06-01''' END,
    CASE WHEN coalesce(first_order_date < TIMESTAMP '2026-01-01 00:00:00', false) = false
         THEN 'first_order_date should be less than now' END,
    CASE WHEN coalesce(source_id = customer_id, false) = false THEN 'source_id must be customer_id' END
  ) AS dq_failures
FROM p
"""


@register("profile", SQL_PROFILE)
def q_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_text(customer_profile(tables(spark, d, ["customer", "nation", "region", "orders", "lineitem"])))


# query modules register themselves on import
from tapestry.plans import q_chunks, q_corpus, q_entity, q_mapping, q_scripts, q_statements  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
