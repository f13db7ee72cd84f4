"""Review, reporting and the run store (A8, A9, B13, B14, C6, C7, E10, E11,
E16, E17, P1-P5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.functions.names import clean_column, clean_field, clean_rule, clean_table
from tapestry.functions.text import BAND_HIGH, BAND_MEDIUM

# --- fixed values -----------------------------------------------------------
STANDARD_NOTE = "Standardized using fallback method"
METHOD_DEFAULTS = {
    # method: (confidence, reasoning)
    "ast": (0.6, "Extracted via AST parsing - needs validation"),
    "pattern_matching": (0.5, "Extracted via pattern matching - needs validation"),
    "legacy": (0.7, "Extracted using legacy extractor"),
}
LONG_RULE = 50
COMPLEX_RULE = 100
DOCUMENT_COLUMNS = [
    ("source_table", "Source Table"),
    ("source_column", "Source Column"),
    ("transformation_rule", "Transformation / Mapping Rules"),
    ("target_field", "Field"),
    ("array_field", "Array Field"),
]
REVIEW_COLUMNS = DOCUMENT_COLUMNS + [
    ("confidence_score", "Confidence Score"),
    ("needs_review", "Needs Review"),
    ("agent_notes", "Agent Notes"),
    ("user_notes", "User Notes"),
]
RESULT_DEFAULTS = {"confidence_score": 0.5, "needs_review": False, "user_validated": False}
# ---------------------------------------------------------------------------


def standardize(df: DataFrame, keep=()) -> DataFrame:
    """Clean names and rules; confidence defaults to 0.5, review to true;
    a fixed note.  ``keep``: columns to carry along in front."""
    return df.select(
        *keep,
        clean_table("source_table").alias("source_table"),
        clean_column("source_column").alias("source_column"),
        clean_rule("transformation_rule").alias("transformation_rule"),
        clean_field("target_field").alias("target_field"),
        F.col("array_field"),
        F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.5)).alias("confidence_score"),
        F.coalesce(F.col("needs_review"), F.lit(True)).alias("needs_review"),
        F.lit(STANDARD_NOTE).alias("final_notes"),
    )


def to_standard(df: DataFrame, method: str) -> DataFrame:
    """Raw extraction rows (``target_column``, ``transformation``, optional
    ``source_table``/``source_column``/``source_line``/``array_field``) -> the
    standard mapping row with the fixed confidence of the method, review=true."""
    conf, reason = METHOD_DEFAULTS[method]
    cols = set(df.columns)

    def opt(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)

    if method == "pattern_matching":
        table = F.lit("unknown")
        column = opt("target_column", "unknown")
    else:
        table = opt("source_table", "unknown")
        column = opt("source_column", "unknown")
    return df.select(
        table.alias("source_table"),
        column.alias("source_column"),
        opt("transformation", "").cast("string").alias("transformation_rule"),
        opt("target_column", "").alias("target_field"),
        opt("array_field", "").alias("array_field"),
        F.lit(conf).alias("confidence_score"),
        F.lit(True).alias("needs_review"),
        F.lit(reason).alias("reasoning"),
        opt("source_line", "").alias("code_location"),
        F.lit(method).alias("extraction_method"),
    )


def review_queue(df: DataFrame) -> DataFrame:
    """Rows flagged for review."""
    return df.filter(F.coalesce(F.col("needs_review"), F.lit(False)))


def session_results(df: DataFrame, session_id) -> DataFrame:
    """Results of one session (a partition-pruning filter when the store is
    partitioned by session)."""
    return df.filter(F.col("session_id") == F.lit(session_id))


def confidence_summary(df: DataFrame, keys=()) -> DataFrame:
    """Band counts, mean score, long-rule (> 50 chars) count and review
    count in one pass.  A missing score counts as 0."""
    s = F.coalesce(F.col("confidence_score"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.count_if(s >= BAND_HIGH).alias("high_confidence_count"),
        F.count_if((s >= BAND_MEDIUM) & (s < BAND_HIGH)).alias("medium_confidence_count"),
        F.count_if(s < BAND_MEDIUM).alias("low_confidence_count"),
        F.avg(s).alias("average_confidence"),
        F.count_if(F.length(F.coalesce(F.col("transformation_rule"), F.lit(""))) > LONG_RULE).alias("complex_transformations"),
        F.count_if(F.coalesce(F.col("needs_review"), F.lit(False))).alias("review_required_count"),
    )


def rule_kind(rule) -> Column:
    """E11 classifier, first match wins: concat(, when(, coalesce(, lit(,
    complex (> 100 chars or any '('), simple."""
    r = F.lower(F.coalesce(rule if isinstance(rule, Column) else F.col(rule), F.lit("")))
    return (
        F.when(r.contains("concat("), "concatenation")
        .when(r.contains("when("), "conditional")
        .when(r.contains("coalesce("), "coalesce")
        .when(r.contains("lit("), "literal")
        .when((F.length(r) > COMPLEX_RULE) | r.contains("("), "complex")
        .otherwise("simple_mapping")
    )


def rule_kinds(df: DataFrame) -> DataFrame:
    """Histogram of rule kinds."""
    return df.groupBy(rule_kind("transformation_rule").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def store_report(df: DataFrame, ok: str = "stored") -> DataFrame:
    """Stored / failed / attempted counts and success ratio (0 when empty)."""
    okc = F.coalesce(F.col(ok), F.lit(False))
    total = F.count(F.lit(1))
    return df.agg(
        F.count_if(okc).alias("stored_count"),
        F.count_if(~okc).alias("error_count"),
        total.alias("total_attempted"),
        F.coalesce(F.try_divide(F.count_if(okc).cast("double"), total.cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def extract_counts(df: DataFrame, keys=("extraction_method",)) -> DataFrame:
    """Number of extracted rows per method (and run)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def to_document(df: DataFrame) -> DataFrame:
    """The standard five-column document row; NULL array field -> ''."""
    cols = []
    for src, name in DOCUMENT_COLUMNS:
        c = F.col(src)
        cols.append((F.coalesce(c, F.lit("")) if src == "array_field" else c).alias(name))
    return df.select(*cols)


def export_review(df: DataFrame, session_id=None) -> DataFrame:
    """Nine display columns of one session's results; NULL user notes -> ''."""
    if session_id is not None:
        df = session_results(df, session_id)
    cols = []
    for src, name in REVIEW_COLUMNS:
        c = F.col(src)
        cols.append((F.coalesce(c, F.lit("")) if src == "user_notes" else c).alias(name))
    return df.select(*cols)


def with_defaults(df: DataFrame, now: Column | None = None, defaults: dict | None = None) -> DataFrame:
    """P5: column defaults on insert (score 0.5, review false, validated false,
    created_at now)."""
    defaults = RESULT_DEFAULTS if defaults is None else defaults
    now = F.current_timestamp() if now is None else now
    out = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k in df.columns}
    if "created_at" in df.columns:
        out["created_at"] = F.coalesce(F.col("created_at"), now)
    return df.withColumns(out)


def close_session(sessions: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Sessions with an outcome row (``session_id``, ``ok``) move from
    'processing' to 'completed' / 'failed' and get ``completed_at``; others are
    unchanged.  The (small or large) outcome set is joined by key."""
    now = F.current_timestamp() if now is None else now
    o = outcomes.select(F.col("session_id"), F.col("ok").alias("__ok"))
    j = sessions.join(o, ["session_id"], "left")
    closing = F.col("__ok").isNotNull() & (F.col("status") == "processing")
    return j.withColumns(
        {
            "status": F.when(closing & F.col("__ok"), F.lit("completed")).when(closing, F.lit("failed")).otherwise(F.col("status")),
            "completed_at": F.when(closing, now).otherwise(F.col("completed_at")),
        }
    ).drop("__ok").select(*sessions.columns)


def apply_updates(results: DataFrame, updates: DataFrame, fields=("transformation_rule", "needs_review", "user_notes"),
                  key: str = "id") -> DataFrame:
    """Patch selected fields from an update table keyed by result id; a field
    absent (NULL) in the update keeps the old value."""
    u = updates.select(F.col(key), *[F.col(f).alias(f"__u_{f}") for f in fields if f in updates.columns])
    j = results.join(u, [key], "left")
    patched = {f: F.coalesce(F.col(f"__u_{f}"), F.col(f)) for f in fields if f in updates.columns}
    return j.withColumns(patched).select(*results.columns)


def session_view(sessions: DataFrame, results: DataFrame, result_fields, order: str = "id") -> DataFrame:
    """Each session header with its results nested as an array ordered by
    ``order`` (results are aggregated per session first, then joined 1:1)."""
    nested = results.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(f) for f in result_fields if f != order]))).alias("results")
    )
    return sessions.join(nested, ["session_id"], "left").withColumn(
        "results", F.coalesce(F.col("results"), F.array())
    )


def session_totals(results: DataFrame) -> DataFrame:
    """Per-session counters — total, high confidence (>= 0.8), needs review."""
    return results.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.count_if(F.coalesce(F.col("confidence_score"), F.lit(0.0)) >= BAND_HIGH).alias("high_confidence_count"),
        F.count_if(F.coalesce(F.col("needs_review"), F.lit(False))).alias("needs_review_count"),
    )


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows by ``order`` (a top-k report: ``orderBy`` +
    ``limit`` plans as a bounded top-k per partition, not a full sort).  The
    order makes the selection deterministic."""
    return df.orderBy(*order).limit(n)


def sources_of(df: DataFrame, key: str = "target_field", column: str = "source_column", table: str = "source_table",
               sep: str = ", ") -> DataFrame:
    """Distinct sorted source columns and source tables per key, joined
    by ``', '`` (set aggregates combine map-side)."""
    return df.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(column)), sep).alias("source_columns"),
        F.array_join(F.sort_array(F.collect_set(table)), sep).alias("source_tables"),
    )


def join_text(df: DataFrame, keys, text: str, order: str, sep: str = "; ", out: str = "rules") -> DataFrame:
    """Texts of each key joined by ``sep`` in ``order``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias(out))


def attach_rules(mappings: DataFrame, rules: DataFrame, on_mapping: str = "target_column", on_rules: str = "column",
                 keys=(), rules_col: str = "rules", out: str = "dq_rules") -> DataFrame:
    """Attach the rules of each target column (``rules_by_column`` output)
    to the mappings; a column without rules gets ''."""
    keys = list(keys)
    r = rules.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(on_rules).alias("__col"),
                     F.col(rules_col).alias("__rules"))
    cond = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(on_mapping) == F.col("__col")]
    j = mappings.join(r, cond, "left")
    return j.withColumn(out, F.coalesce(F.col("__rules"), F.lit(""))).drop("__col", "__rules", *[f"__k_{k}" for k in keys])


def resolve_tables(mappings: DataFrame, bindings: DataFrame, var_col: str = "source_df", keys=(),
                   out: str = "source_table") -> DataFrame:
    """Dataframe variable -> table name via the resolved bindings
    (``var``, ``table_name``), falling back to the variable itself."""
    keys = list(keys)
    b = bindings.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("var").alias("__var"),
                        F.col("table_name").alias("__table"))
    cond = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(var_col) == F.col("__var")]
    j = mappings.join(b, cond, "left")
    return j.withColumn(out, F.coalesce(F.col("__table"), F.col(var_col))).drop("__var", "__table", *[f"__k_{k}" for k in keys])
