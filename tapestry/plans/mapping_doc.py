"""Mapping document job: a corpus of transformation scripts -> one row per
target-column mapping (source table, source columns, target, transformation,
array fields, DQ rules) plus join details and lineage, as DataFrames.

    scripts ─┬─ withColumn(s), select and agg items, column lists expanded
             │     ─ col("x"), df.x, df["x"] ─⟕ tables of the versions in force
             │     ─ nested fields under aliases -> array fields
             │     ─⟕ rules per column (rule block)
             ├─ join calls ───────⟕ resolved bindings -> join details
             └─ assignments ──────  versioned lineage -> closure to root tables

Every stage is per-file string work or a join keyed by (path, name); no
stage gathers the corpus in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.operators import statements as V
from tapestry.operators.calls import calls_among
from tapestry.operators.lineage import lineage_roots
from tapestry.operators.quality import rule_lines, rules_by_column
from tapestry.operators.review import attach_rules
from tapestry.session import written
from tapestry.sources.sinks import export_joins, export_mappings

KEYS = ["path"]


@dataclass
class MappingDocument:
    mappings: DataFrame
    joins: DataFrame
    lineage: DataFrame
    targets: DataFrame


def maker_calls(scripts: DataFrame) -> DataFrame:
    """The calls that make target columns, written for all their readers."""
    return written(calls_among(scripts, V.MAKERS).drop("match_no", "arg1", "arg2"), "calls")


def mapping_rows(scripts: DataFrame, direct: bool = False, calls: DataFrame | None = None) -> DataFrame:
    """The document's mapping rows.  ``direct``: columns that a select passes on
    as they are count as mappings too.  ``calls`` are the ``maker_calls``, if they
    are at hand.  Statements, assignments and lists are found once for all steps."""
    cut = written(V.statements(scripts), "statements")
    assigned = written(V.assignments(scripts, cut=cut), "assignments")
    lists = written(V.list_versions(scripts, assigned=assigned), "lists")
    versions = V.table_versions(scripts, assigned=assigned, lists=lists)
    e = V.expressions(scripts, lists=lists, calls=calls)
    e = written(e if direct else e.where("NOT direct"), "expressions")
    one = [*KEYS, "at", "item_no"]
    refs = V.references(e, keys=[*one, "receiver"]).join(V.imported_names(scripts, cut=cut), [*KEYS, "var"], "left_anti")
    refs = V.bind_references(refs, versions, KEYS).withColumn("table_name", F.coalesce("table_name", F.lit("unknown")))
    short = F.element_at(F.split("table_name", r"\."), -1)
    sources = refs.groupBy(*one).agg(
        F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("source_table"),
        F.array_join(F.sort_array(F.collect_set(F.concat(short, F.lit("."), "column"))), ", ").alias("source_columns"),
    )
    field = F.struct("field_no", F.col("path").alias("alias"), "transformation")
    tree = V.field_tree(e.withColumnRenamed("path", "_path"), keys=["_path", "at", "item_no"])
    fields = tree.groupBy(F.col("_path").alias("path"), "at", "item_no").agg(F.array_sort(F.collect_list(field)).alias("f"))
    pair = lambda f: F.struct(f["alias"].alias("alias"), f["transformation"].alias("transformation"))
    order = Window.partitionBy(*KEYS).orderBy("at", "item_no")
    m = e.join(sources, one, "left").join(fields, one, "left").select(
        *KEYS,
        (F.row_number().over(order) - 1).alias("mapping_no"),
        F.coalesce("source_table", F.lit("")).alias("source_table"),
        F.coalesce("source_columns", F.lit("")).alias("source_columns"),
        "target_column",
        "transformation",
        F.coalesce(F.transform("f", pair), F.array().cast("array<struct<alias:string,transformation:string>>")).alias("array_fields"),
    )
    rules = rules_by_column(rule_lines(S.extract_rule_block(scripts), "rule_block", keys=KEYS), KEYS)
    return attach_rules(m, rules, on_mapping="target_column", keys=KEYS)


def extract_mappings(spark: SparkSession, scripts: DataFrame, direct: bool = False) -> MappingDocument:
    """Mapping rows, join details, lineage to root tables and targets."""
    m = mapping_rows(scripts, direct)
    bound = S.resolve_bindings(spark, S.extract_bindings(scripts), S.extract_table_lists(scripts))
    joins = S.resolve_joins(S.extract_joins(scripts), bound).select(
        *KEYS, "join_no", F.col("primary_table").alias("left_df"), F.col("secondary_table").alias("right_df"),
        "join_type", "condition", "remarks")
    roots = lineage_roots(spark, V.lineage_versions(scripts), keys=KEYS)
    lineage = roots.select(*KEYS, F.col("node.name").alias("node"), F.col("node.version").alias("version"), F.col("root.name").alias("root"), "depth")
    return MappingDocument(m, joins, lineage, S.extract_target(scripts))


def write_document(doc: MappingDocument, out_dir: str, fmt: str = "csv") -> None:
    """Mapping rows (with array-field continuation rows) and join details, each
    in its own folder."""
    export_mappings(doc.mappings, f"{out_dir.rstrip('/')}/mappings", fmt, order=["path", "mapping_no"])
    export_joins(doc.joins, f"{out_dir.rstrip('/')}/joins", fmt)
