"""The entity profile bound to the TPC-H-style tables: customer is the hub,
nation/region are code tables, orders and lineitem (reached through orders)
are satellites.  Used by ``entry()``, the registered ``profile`` query and the
bench."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.functions.arrays import merge_arrays, pick, shape
from tapestry.functions.codes import role_of, translate
from tapestry.functions.keys import full_name, iso_ts, surrogate_key
from tapestry.operators.lookup import Lookup
from tapestry.operators.nest import Nest
from tapestry.operators.project import bronze, const, null_as
from tapestry.plans.profile import ProfileSpec, Satellite, build_profile

KEY = "customer__c_custkey"

# --- fixed values of this binding --------------------------------------------
PRIORITY_TEXT = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ID_SYSTEM = "TPCH"
DQ_RULES = """
Customer
    customer_id must not be null
    length(customer_name) must be 18
    nation_name must not be null
    account_balance should be greater than 0
    market_segment should be in ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']
    first_order_date should be greater than '1995-06-01'
    first_order_date should be less than now
    source_id must be customer_id
"""
# ------------------------------------------------------------------------------


def order_shape(o: str = "orders") -> "F.Column":
    c = lambda n: F.col(f"{o}__{n}")
    return shape(
        [
            ("reference_id", surrogate_key(c("o_orderkey"), c("o_orderstatus"), c("o_orderdate"))),
            ("order_key", c("o_orderkey")),
            ("status", c("o_orderstatus")),
            ("total_price", c("o_totalprice").cast("decimal(18,2)")),
            ("order_date", iso_ts(c("o_orderdate"))),
            ("priority", translate(c("o_orderpriority"), PRIORITY_TEXT, keep_other=True)),
        ]
    )


def customer_spec(tables: dict[str, DataFrame], salt_buckets: int = 0) -> ProfileSpec:
    nation = bronze(tables["nation"], "nation")
    region = bronze(tables["region"], "region")
    orders = bronze(tables["orders"], "orders")
    lineitem = bronze(tables["lineitem"], "lineitem")

    def orders_by_customer(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("orders__o_custkey", KEY)

    def lines_by_customer(df: DataFrame) -> DataFrame:
        # pre-aggregate before the shuffle: only the distinct (order, flag,
        # status) combinations travel to the join with the order -> customer link
        codes = df.select("lineitem__l_orderkey", "lineitem__l_returnflag", "lineitem__l_linestatus").distinct()
        link = orders.select(F.col("orders__o_orderkey"), F.col("orders__o_custkey").alias(KEY))
        return codes.join(link, codes["lineitem__l_orderkey"] == link["orders__o_orderkey"], "inner")

    order_nests = {
        "orders": Nest(order_shape(), "desc"),
        "order_statuses": Nest(F.col("orders__o_orderstatus"), "asc", distinct=True),
        "first_order_ts": Nest(F.col("orders__o_orderdate"), "asc", distinct=True),
    }
    line_nests = {
        "return_flags": Nest(F.col("lineitem__l_returnflag"), "asc", distinct=True),
        "line_statuses": Nest(F.col("lineitem__l_linestatus"), "asc", distinct=True),
    }
    satellites = [
        Satellite("orders", orders, KEY, order_nests, "left", orders_by_customer, salt_buckets),
        Satellite("lineitem", lineitem, KEY, line_nests, "left", lines_by_customer, salt_buckets),
    ]
    lookups = [
        Lookup(nation, "customer__c_nationkey", "nation__n_nationkey", "left", select=["nation__n_name", "nation__n_regionkey"]),
        Lookup(region, "nation__n_regionkey", "region__r_regionkey", "left", select=["region__r_name"]),
    ]
    derive_blocks = [
        {
            "role": role_of(F.col("order_statuses")),
            "latest_open_order": pick("orders", lambda x: x["status"] == "O", "order_key"),
            "all_codes": merge_arrays("order_statuses", "return_flags", "line_statuses", sort="asc"),
            "first_order_date": F.get(F.col("first_order_ts"), F.lit(0)),
        }
    ]
    projection = [
        (F.col(KEY).cast("string"), "customer_id"),
        (const(ID_SYSTEM), "customer_id_system"),
        (F.col("customer__c_name"), "customer_name"),
        (full_name(F.col("customer__c_name"), F.col("customer__c_mktsegment")), "display_name"),
        (F.col("customer__c_acctbal").cast("decimal(18,2)"), "account_balance"),
        (F.col("customer__c_mktsegment"), "market_segment"),
        (F.col("nation__n_name"), "nation_name"),
        (F.col("region__r_name"), "region_name"),
        (F.coalesce(F.col("orders"), F.array()), "orders"),
        (F.coalesce(F.col("order_statuses"), F.array()), "order_statuses"),
        (F.col("role.pcp_ind"), "pcp_ind"),
        (F.col("role.service_provider_role"), "service_provider_role"),
        (F.col("latest_open_order"), "latest_open_order"),
        (F.col("all_codes"), "all_codes"),
        (F.col("first_order_date"), "first_order_date"),
        (null_as("string"), "alternate_id"),
        (F.col(KEY).cast("string"), "source_id"),
    ]
    return ProfileSpec(key=KEY, lookups=lookups, satellites=satellites, derive=derive_blocks, projection=projection,
                       dq_rules=DQ_RULES, dq_now=F.lit("2026-01-01 00:00:00").cast("timestamp"))


def customer_profile(tables: dict[str, DataFrame], salt_buckets: int = 0) -> DataFrame:
    hub = bronze(tables["customer"], "customer")
    return build_profile(hub, customer_spec(tables, salt_buckets))
