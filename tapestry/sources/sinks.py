"""Sinks: strict schema conformance, positional overwrite, document exports and
the date-partitioned run store (A4-A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JOIN_DETAIL_COLUMNS = ["Primary Table", "Secondary Table", "Join Type", "Join Condition", "Remarks"]
MAPPING_DOC_COLUMNS = ["Source Table", "Source Column(s)", "Target Column(s)", "Array Field", "Transformation", "DQ Rules"]


class SchemaMismatch(ValueError):
    pass


def conform(df: DataFrame, schema: StructType, strict: bool = True) -> DataFrame:
    """A4: select the target columns in target order with target types.

    ``strict``: a missing or an extra column is an error (names compared
    case-insensitively).  Not strict: missing columns become typed NULLs and
    extra columns are dropped.  Casts follow the session's ANSI mode (a value
    that cannot be cast is an error, not a silent NULL).
    """
    have = {c.lower(): c for c in df.columns}
    want = [f.name.lower() for f in schema.fields]
    missing = [f.name for f in schema.fields if f.name.lower() not in have]
    extra = [c for c in df.columns if c.lower() not in set(want)]
    if strict and (missing or extra):
        raise SchemaMismatch(f"missing={missing} extra={extra}")
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        if src is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f"`{src}`").cast(f.dataType).alias(f.name))
    return df.select(*cols)


def overwrite_into(df: DataFrame, table: str) -> None:
    """A5: overwrite an existing table, matching columns BY POSITION (conform
    first so the positions are right)."""
    df.write.mode("overwrite").insertInto(table)


def save_partitioned(df: DataFrame, path: str, ts_col: str = "created_at", cluster_by: str | None = None,
                     fmt: str = "parquet") -> None:
    """A10: add rows to a run table partitioned by the date of ``ts_col``;
    optional clustering key (the file-layout equivalent of a clustered table).
    Earlier runs stay.

    Rows are range-partitioned on (date, cluster key): each task writes a
    contiguous slice, so a date lands in few files (no task x date file
    explosion), and a hot date is split across tasks by the clustering key
    instead of landing in one task.  Files are sorted by the clustering key."""
    out = df.withColumn("created_date", F.to_date(F.col(ts_col)))
    if cluster_by:
        out = out.repartitionByRange("created_date", cluster_by).sortWithinPartitions("created_date", cluster_by)
    else:
        # without a key, a hash of the row splits a hot date
        row = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
        out = out.repartitionByRange(F.col("created_date"), row)
    out.write.mode("append").partitionBy("created_date").format(fmt).save(path)


def document_rows(mappings: DataFrame, order: str | list = "mapping_no") -> DataFrame:
    """A6/J13/D13 layout: one row per mapping (array field '') followed by one
    continuation row per array field ``(alias, transformation)``; the other
    columns of a continuation row are ''.  ``mappings`` needs ``order``,
    ``source_table``, ``source_columns``, ``target_column``, ``transformation``,
    ``dq_rules`` and ``array_fields array<struct<alias, transformation>>``."""
    order = [order] if isinstance(order, str) else list(order)
    main = mappings.select(
        *order,
        F.lit(-1).alias("row_no"),
        F.col("source_table").alias("Source Table"),
        F.col("source_columns").alias("Source Column(s)"),
        F.col("target_column").alias("Target Column(s)"),
        F.lit("").alias("Array Field"),
        F.col("transformation").alias("Transformation"),
        F.coalesce(F.col("dq_rules"), F.lit("")).alias("DQ Rules"),
    )
    cont = mappings.select(*order, F.posexplode("array_fields").alias("row_no", "f")).select(
        *order,
        F.col("row_no"),
        F.lit("").alias("Source Table"),
        F.lit("").alias("Source Column(s)"),
        F.lit("").alias("Target Column(s)"),
        F.col("f.alias").alias("Array Field"),
        F.coalesce(F.col("f.transformation"), F.lit("")).alias("Transformation"),
        F.lit("").alias("DQ Rules"),
    )
    return main.unionByName(cont)


def export_mappings(mappings: DataFrame, path: str, fmt: str = "csv", order: str | list = "mapping_no") -> None:
    """Write the six-column mapping document, rows in document order (a
    range-partitioned sort, so it scales)."""
    order = [order] if isinstance(order, str) else list(order)
    rows = document_rows(mappings, order).orderBy(*order, "row_no").drop(*order, "row_no")
    w = rows.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def export_joins(joins: DataFrame, path: str, fmt: str = "csv") -> None:
    """Join details as a second dataset in its own folder."""
    rows = joins.select(
        F.col("left_df").alias("Primary Table"),
        F.col("right_df").alias("Secondary Table"),
        F.col("join_type").alias("Join Type"),
        F.col("condition").alias("Join Condition"),
        F.coalesce(F.col("remarks"), F.lit("")).alias("Remarks"),
    )
    w = rows.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)
