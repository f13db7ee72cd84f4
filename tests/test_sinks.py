"""Sinks, conformance and layout (A4-A7, A10, J13, D13) plus plan-shape checks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tapestry.operators.lookup import Lookup, lookup
from tapestry.operators.nest import Nest, NestConcat, nest_many
from tapestry.sources.sinks import (SchemaMismatch, conform, document_rows, export_joins, export_mappings, overwrite_into,
                                    save_partitioned)

TARGET = StructType([StructField("b", StringType()), StructField("a", IntegerType())])


def test_conform_strict_and_loose(spark):
    df = spark.createDataFrame([("1", "x")], "A string, B string")
    out = conform(df, TARGET)
    assert out.columns == ["b", "a"] and out.first().a == 1
    with pytest.raises(SchemaMismatch):
        conform(df.withColumn("extra", F.lit(1)), TARGET)
    with pytest.raises(SchemaMismatch):
        conform(df.drop("B"), TARGET)
    loose = conform(df.drop("B").withColumn("extra", F.lit(1)), TARGET, strict=False)
    assert loose.columns == ["b", "a"] and loose.first().b is None


def test_overwrite_into_is_positional(spark):
    name = "tapestry_test_target"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (b STRING, a INT) USING parquet")
    df = spark.createDataFrame([("1", "x")], "A string, B string")
    overwrite_into(conform(df, TARGET), name)
    overwrite_into(conform(df, TARGET), name)
    assert [tuple(r) for r in spark.table(name).collect()] == [("x", 1)]
    spark.sql(f"DROP TABLE {name}")


MAPS = [(0, "member", "member.first_name", "name_first", 'col("first_name")', "name_first must not be null",
         [("given", 'col("first_name")'), ("family", None)]),
        (1, "member", "member.state_cd", "state", "upper(state_cd)", None, [])]
MAP_SCHEMA = ("mapping_no int, source_table string, source_columns string, target_column string, transformation string, "
              "dq_rules string, array_fields array<struct<alias:string,transformation:string>>")


def test_document_rows_layout(spark):
    rows = document_rows(spark.createDataFrame(MAPS, MAP_SCHEMA)).orderBy("mapping_no", "row_no").collect()
    got = [(r["Source Table"], r["Target Column(s)"], r["Array Field"], r["Transformation"], r["DQ Rules"]) for r in rows]
    assert got == [
        ("member", "name_first", "", 'col("first_name")', "name_first must not be null"),
        ("", "", "given", 'col("first_name")', ""),
        ("", "", "family", "", ""),
        ("member", "state", "", "upper(state_cd)", ""),
    ]


def test_exports_write_folders(spark):
    root = tempfile.mkdtemp(prefix="tapestry-export-")
    export_mappings(spark.createDataFrame(MAPS, MAP_SCHEMA), os.path.join(root, "mappings"))
    back = spark.read.option("header", "true").csv(os.path.join(root, "mappings"))
    assert back.columns == ["Source Table", "Source Column(s)", "Target Column(s)", "Array Field", "Transformation", "DQ Rules"]
    assert back.count() == 4
    joins = spark.createDataFrame([("a", "b", "LEFT", "a.k == b.k", None)], "left_df string, right_df string, join_type string, "
                                  "condition string, remarks string")
    export_joins(joins, os.path.join(root, "joins"))
    j = spark.read.option("header", "true").csv(os.path.join(root, "joins")).first()
    assert (j["Primary Table"], j["Join Type"]) == ("a", "LEFT")


def test_save_partitioned_by_date(spark):
    root = tempfile.mkdtemp(prefix="tapestry-runs-")
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00"), (1, "2024-01-02 00:00:00")],
                               "session_id int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    save_partitioned(df, root, cluster_by="session_id")
    assert sorted(d for d in os.listdir(root) if d.startswith("created_date=")) == ["created_date=2024-01-01", "created_date=2024-01-02"]
    assert spark.read.parquet(root).filter("created_date = '2024-01-02'").count() == 1


def test_salted_nest_equals_one_phase(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    nests = {"ids": Nest(F.struct("id", "v"), "desc"), "vs": Nest(F.col("v"), "asc", distinct=True),
             "both": NestConcat([F.col("v"), (F.col("v") + 100)], "asc")}
    one = {r.k: (r.ids, r.vs, r.both) for r in nest_many(df, "k", nests).collect()}
    two = {r.k: (r.ids, r.vs, r.both) for r in nest_many(df, "k", nests, salt_buckets=16).collect()}
    assert one == two and len(one[0][0]) == 1667


def test_building_a_lookup_runs_no_job(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = lookup(spark.range(1000).withColumnRenamed("id", "k"), Lookup(spark.range(10), "k", "id", "left"))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()  # small enough in bytes
    merged = lookup(spark.range(1000).withColumnRenamed("id", "k"), Lookup(spark.range(10), "k", "id", "left", hint="merge"))
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString()


def test_two_saves_keep_both_runs(spark):
    root = tempfile.mkdtemp(prefix="tapestry-runs-")
    run = lambda i, day: spark.createDataFrame([(i, f"2024-01-0{day} 10:00:00")], "session_id int, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    save_partitioned(run(1, 1), root, cluster_by="session_id")
    save_partitioned(run(2, 2), root, cluster_by="session_id")
    save_partitioned(run(3, 2), root)
    assert sorted(r.session_id for r in spark.read.parquet(root).collect()) == [1, 2, 3]
