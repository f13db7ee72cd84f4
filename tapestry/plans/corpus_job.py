"""The whole mapping workflow over a corpus as one plan: scripts -> two method
sets -> reconcile -> resolve -> score -> standardise -> run store.

    scripts ─┬─ every call, versioned bindings, all forms of references ── a
             └─ withColumn calls, col("x"), last bindings ──────────────── b
    a, b ── last row a key ── full-outer match by (path, table, column) ──
         exact / partial / conflict / one-sided ── resolve ── score ──
         standardise ── run store, a session for each script

Sides meet by an equi-join on (path, source table, source column) and
similarity is computed on matched pairs only; every stage is keyed by the
script, so corpora are spread by their scripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.operators.reconcile import KEY, classify_matches, last_per_key, reconcile, resolve, score
from tapestry.operators.review import resolve_tables, standardize, to_standard
from tapestry.plans.mapping_doc import maker_calls, mapping_rows
from tapestry.session import written
from tapestry.sources.run_store import RunStore

KEYS = ["path", *KEY]
FIELDS = ["path", "source_table", "source_column", "transformation_rule", "target_field", "array_field", "confidence_score", "needs_review"]


def _standard(rows: DataFrame, method: str) -> DataFrame:
    """Standard rows of a method with their script and place; a side without
    columns has an unknown source."""
    known = {c: F.nullif(F.col(c), F.lit("")) for c in ("source_table", "source_column")}
    rows = rows.withColumns(known)
    std = to_standard(rows.withColumn("source_line", F.concat_ws("\u0001", "path", F.format_string("%010d", "mapping_no"))), method)
    place = F.split("code_location", "\u0001")
    return std.withColumns({"path": place[0], "mapping_no": place[1].cast("int")}).drop("code_location")


def code_mappings(spark: SparkSession, scripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Side a: the mapping document's rows."""
    m = mapping_rows(scripts, calls=calls)
    fields = F.array_join(F.transform("array_fields", lambda f: f["alias"]), ", ")
    return _standard(m.withColumns({"source_column": F.col("source_columns"), "array_field": fields}), "ast")


def legacy_mappings(spark: SparkSession, scripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Side b: ``withColumn`` calls with the last binding of their variable and
    the columns named by ``col("x")``."""
    bound = S.resolve_bindings(spark, S.extract_bindings(scripts), S.extract_table_lists(scripts))
    m = S.extract_with_column(scripts, calls=calls).withColumn("receiver", F.nullif("receiver", F.lit("")))
    m = resolve_tables(m, bound, var_col="receiver", keys=["path"], out="table").withColumn("cols", S.column_refs(F.col("transformation")))
    short = F.element_at(F.split("table", r"\."), -1)
    columns = F.array_join(F.transform("cols", lambda c: F.concat(short, F.lit("."), c)), ", ")
    return _standard(m.withColumnRenamed("match_no", "mapping_no").withColumns(
        {"source_table": F.when(F.size("cols") > 0, F.col("table")), "source_column": columns, "array_field": F.lit("")}), "legacy")


def corpus_mappings(spark: SparkSession, scripts: DataFrame, method: str = "ratio", boost_exact: bool = False) -> DataFrame:
    """The corpus' resolved, scored and standardised mappings, with ``path``,
    ``match_class`` and ``extraction_source``."""
    calls = maker_calls(scripts)
    a, b = (last_per_key(written(side(spark, scripts, calls), "side"), KEYS, "mapping_no") for side in (code_mappings, legacy_mappings))
    matched = classify_matches(reconcile(a, b, KEYS), method)
    return standardize(score(resolve(matched, FIELDS, boost_exact)), keep=("path", "match_class", "extraction_source"))


def run_corpus(spark: SparkSession, scripts: DataFrame, store: RunStore, created_at: Column, method: str = "ratio") -> DataFrame:
    """Run the workflow over ``scripts (path, text)`` and save it as one session a
    script; returns the store's rows.  The same run again leaves one run."""
    rows = corpus_mappings(spark, scripts, method)
    rows = rows.withColumns({"session_id": F.col("path"), "created_at": created_at, "id": F.xxhash64("path", "target_field", "source_table", "source_column")})
    store.save(rows)
    return store.read()
