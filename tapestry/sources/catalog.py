"""Catalog loads and the script corpus scan (A1-A3)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tables(
    spark: SparkSession,
    root: str,
    names: Iterable[str],
    fmt: str = "parquet",
    filters: Mapping[str, Column] | None = None,
) -> dict[str, DataFrame]:
    """A1/A2: bind every named table to a lazy DataFrame.

    ``root`` is either a folder (``{root}/{name}.{fmt}``) or, with
    ``fmt='table'``, a catalog schema (``{root}.{name}``).  ``filters`` are row
    filters applied at load; Catalyst pushes them into the scan (C1).  Nothing
    is read until an action runs.
    """
    filters = filters or {}
    out = {}
    for name in names:
        if fmt == "table":
            df = spark.table(f"{root}.{name}" if root else name)
        else:
            df = spark.read.format(fmt).load(f"{root.rstrip('/')}/{name}.{fmt}")
        if name in filters:
            df = df.filter(filters[name])
        out[name] = df
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per bound table as one DataFrame (``unionByName`` of one
    partial aggregate per table; each is a footer-only scan for parquet)."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_scripts(spark: SparkSession, path: str, ext: str = ".py", recursive: bool = True) -> DataFrame:
    """A3: every file with extension ``ext`` under ``path`` as one row
    ``(path, text)`` — the whole text, one file per row; directories and other
    extensions are skipped by the file-source glob filter."""
    reader = spark.read.option("pathGlobFilter", f"*{ext}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def isin_trimmed(c: str | Column, values: Sequence) -> Column:
    """Membership after trim (blocks parquet statistics pushdown, which is
    the documented cost of trimming at read)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).isin(list(values))
