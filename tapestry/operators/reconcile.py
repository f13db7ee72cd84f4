"""Reconciliation of two mapping sets.

Rows follow the standard mapping layout: ``source_table, source_column,
transformation_rule, target_field, array_field, confidence_score,
needs_review, ...``.  Sets are matched on the composite key (source_table,
source_column) — both columns, never a concatenated text key.  Similarity is
only ever computed on key-matched pairs (a full-outer equi-join), never on a
cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.functions.keys import clamp
from tapestry.functions.text import similarity_native, similarity_ratio

KEY = ("source_table", "source_column")

# --- fixed values -----------------------------------------------------------
RULE_WEIGHT, TARGET_WEIGHT = 0.7, 0.3
EXACT_ABOVE, PARTIAL_ABOVE = 0.9, 0.5
SIDE_A, SIDE_B = "code_analysis", "legacy"
REASONS = {
    "exact": "Fallback: Exact match validation",
    "exact_boost": "Exact match between both agents",
    "partial": "Fallback: Partial match, preferred code analysis",
    "conflict": "Fallback: Conflict resolved by preferring code analysis",
    "code_only": "Fallback: Code analysis only",
    "legacy_only": "Fallback: Legacy only (lower accuracy expected)",
}
PARTIAL_PENALTY, PARTIAL_DEFAULT, PARTIAL_FLOOR = 0.2, 0.5, 0.1
CONFLICT_SCORE, LEGACY_ONLY_SCORE = 0.4, 0.3
EXACT_BOOST, EXACT_DEFAULT = 0.1, 0.8
SCORE_DEFAULT = 0.5
RULE_MIN_LEN = 10
RULE_MARKERS = ("when(", "col(")
REVIEW_BELOW = 0.6
# ---------------------------------------------------------------------------


def last_per_key(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Keep the row with the greatest ``order`` per key ("later overwrites
    earlier").  ``max_by`` combines before the shuffle (as a sort aggregate, its
    value being a struct), so a whole group never meets in one task.  ``order``
    must be unique within a key (a tie would make the kept row depend on task
    scheduling)."""
    others = [c for c in df.columns if c not in keys]
    o = F.col(order) if isinstance(order, str) else order
    picked = F.max_by(F.struct(*[F.col(c) for c in others]), o).alias("__r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*df.columns)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """H4: keep the first occurrence (smallest ``order``) per key."""
    others = [c for c in df.columns if c not in keys]
    o = F.col(order) if isinstance(order, str) else order
    picked = F.min_by(F.struct(*[F.col(c) for c in others]), o).alias("__r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*df.columns)


def union_methods(*frames: DataFrame) -> DataFrame:
    """H1: union mapping sets from different extraction methods by column name;
    columns missing on one side become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def known_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Text key columns with 'unknown' for NULL (other types stay as they are)."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit("unknown")) for k in keys if k in text})


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Full-outer match of two sets on the composite key; each side
    is kept whole as a struct ``a`` / ``b`` (NULL when absent).  A NULL key
    part is read as 'unknown' and matches as such."""
    keys = list(keys)
    a, b = known_keys(a, keys), known_keys(b, keys)
    sa = a.select(*keys, F.struct(*[F.col(c) for c in a.columns]).alias("a"))
    sb = b.select(*keys, F.struct(*[F.col(c) for c in b.columns]).alias("b"))
    return sa.join(sb, keys, "full_outer")


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b`` (left anti join), NULL
    key parts read as 'unknown'."""
    a, b = known_keys(a, keys), known_keys(b, keys)
    return a.join(b.select(*keys), list(keys), "left_anti")


def classify_matches(r: DataFrame, method: str = "levenshtein") -> DataFrame:
    """Add ``similarity`` and ``match_class`` to a reconciled frame.

    Both sides present: similarity = 0.7 * sim(rules) + 0.3 * sim(targets);
    > 0.9 exact, > 0.5 partial, else conflict.  One side only: code_only /
    legacy_only, similarity NULL.  ``'levenshtein'`` is the native normalised
    edit similarity (stays in codegen); ``method='ratio'`` is the exact
    sequence-matcher ratio (Arrow-batched pandas UDF, outside the registered
    queries).
    """
    sim = similarity_ratio if method == "ratio" else similarity_native
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    s = RULE_WEIGHT * sim(F.col("a.transformation_rule"), F.col("b.transformation_rule")) + TARGET_WEIGHT * sim(
        F.col("a.target_field"), F.col("b.target_field")
    )
    r = r.withColumn("similarity", F.when(both, s))
    cls = (
        F.when(both & (F.col("similarity") > EXACT_ABOVE), "exact")
        .when(both & (F.col("similarity") > PARTIAL_ABOVE), "partial")
        .when(both, "conflict")
        .when(F.col("a").isNotNull(), "code_only")
        .otherwise("legacy_only")
    )
    return r.withColumn("match_class", cls)


def resolve(c: DataFrame, fields: Sequence[str], boost_exact: bool = False) -> DataFrame:
    """One resolved mapping per key without a model.

    exact -> side a, review false (with ``boost_exact``: score min(s+0.1, 1),
    default s 0.8); partial -> a, review, score max(s-0.2, 0.1) (default s
    0.5); conflict -> a, review, 0.4; code_only -> a, review false;
    legacy_only -> b, review, 0.3.  Adds ``validation_reasoning``,
    ``sources_used`` and ``extraction_source``.
    """
    m = F.col("match_class")
    take_b = m == "legacy_only"
    out = [F.when(take_b, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields
           if f not in ("confidence_score", "needs_review")]
    s_a = F.col("a.confidence_score")
    if boost_exact:
        exact_score = F.least(F.coalesce(s_a, F.lit(EXACT_DEFAULT)) + EXACT_BOOST, F.lit(1.0))
    else:
        exact_score = s_a
    score = (
        F.when(m == "exact", exact_score)
        .when(m == "partial", F.greatest(F.coalesce(s_a, F.lit(PARTIAL_DEFAULT)) - PARTIAL_PENALTY, F.lit(PARTIAL_FLOOR)))
        .when(m == "conflict", F.lit(CONFLICT_SCORE))
        .when(m == "code_only", s_a)
        .otherwise(F.lit(LEGACY_ONLY_SCORE))
    )
    review = F.when(m.isin("exact", "code_only"), F.lit(False)).otherwise(F.lit(True))
    reason = (
        F.when(m == "exact", F.lit(REASONS["exact_boost"] if boost_exact else REASONS["exact"]))
        .when(m == "partial", F.lit(REASONS["partial"]))
        .when(m == "conflict", F.lit(REASONS["conflict"]))
        .when(m == "code_only", F.lit(REASONS["code_only"]))
        .otherwise(F.lit(REASONS["legacy_only"]))
    )
    sources = (
        F.when(m.isin("exact", "partial", "conflict"), F.array(F.lit(SIDE_A), F.lit(SIDE_B)))
        .when(m == "code_only", F.array(F.lit(SIDE_A)))
        .otherwise(F.array(F.lit(SIDE_B)))
    )
    return c.select(
        *out,
        score.cast("double").alias("confidence_score"),
        review.alias("needs_review"),
        m.alias("match_class"),
        reason.alias("validation_reasoning"),
        sources.alias("sources_used"),
        F.when(take_b, F.lit(SIDE_B)).otherwise(F.lit(SIDE_A)).alias("extraction_source"),
    )


def score(df: DataFrame) -> DataFrame:
    """Final confidence.  +0.1 when the rule is longer than 10 characters and
    contains ``when(`` or ``col(`` (case-insensitive); +0.1 when both source
    names are known; -0.1 when flagged; clamp to [0.1, 1.0]; below 0.6 flags
    the row for review.  Missing score counts as 0.5, missing names as
    'unknown', missing flag as false."""
    rule = F.coalesce(F.col("transformation_rule"), F.lit(""))
    lrule = F.lower(rule)
    complete_rule = (F.length(rule) > RULE_MIN_LEN) & (lrule.contains(RULE_MARKERS[0]) | lrule.contains(RULE_MARKERS[1]))
    known = (F.coalesce(F.col("source_table"), F.lit("unknown")) != "unknown") & (
        F.coalesce(F.col("source_column"), F.lit("unknown")) != "unknown"
    )
    flagged = F.coalesce(F.col("needs_review"), F.lit(False))
    adj = (
        F.lit(0.0)
        + F.when(complete_rule, F.lit(0.1)).otherwise(F.lit(0.0))
        + F.when(known, F.lit(0.1)).otherwise(F.lit(0.0))
        - F.when(flagged, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    final = clamp(F.coalesce(F.col("confidence_score"), F.lit(SCORE_DEFAULT)) + adj, 0.1, 1.0)
    return df.withColumn("confidence_score", final).withColumn(
        "needs_review", F.when(F.col("confidence_score") < REVIEW_BELOW, F.lit(True)).otherwise(flagged)
    )


def reconcile_summary(a: DataFrame, b: DataFrame, classified: DataFrame) -> DataFrame:
    """Input counts, resolved count, conflicts and new (code-only) mappings
    and, of inputs that were not yet reduced to one row a key, the rows that a
    later one overwrote (``duplicates``), as one row — one aggregate over the tagged union of the three inputs (all
    counts are partial aggregates; nothing is joined)."""
    none = F.lit(None).cast("string")
    of_side = lambda df, side: (known_keys(df).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
                                .select(F.lit(side).alias("__src"), none.alias("match_class"), "n"))
    tagged = (
        of_side(a, "a").unionByName(of_side(b, "b"))
        .unionByName(classified.select(F.lit("r").alias("__src"), F.col("match_class"), F.lit(1).cast("long").alias("n")))
    )
    src, m = F.col("__src"), F.col("match_class")
    return tagged.agg(
        F.coalesce(F.sum(F.when(src == "a", F.col("n"))), F.lit(0)).alias("code_mappings"),
        F.coalesce(F.sum(F.when(src == "b", F.col("n"))), F.lit(0)).alias("legacy_mappings"),
        F.coalesce(F.sum(F.when(src != "r", F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(src == "r").alias("final_mappings"),
        F.count_if(m == "conflict").alias("conflicts"),
        F.count_if(m == "code_only").alias("new_mappings"),
        F.count_if(m == "exact").alias("exact_matches"),
        F.count_if(m == "partial").alias("partial_matches"),
        F.count_if(m == "legacy_only").alias("legacy_only"),
    )
