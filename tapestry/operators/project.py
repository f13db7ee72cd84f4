"""Projection and normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def lower_columns(df: DataFrame) -> DataFrame:
    """B1: lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def prefix_columns(df: DataFrame, alias: str, sep: str = "__") -> DataFrame:
    """B2: rename every column to ``alias__column`` (a flat, join-safe namespace)."""
    return df.toDF(*[f"{alias}{sep}{c}" for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column (type-driven); other columns untouched."""
    return df.select(
        *[
            (F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`"))
            for f in df.schema.fields
        ]
    )


def bronze(df: DataFrame, alias: str) -> DataFrame:
    """Lower-case, prefix and trim in one projection (B1+B2+B3)."""
    return prefix_columns(trim_strings(lower_columns(df)), alias)


def derive(df: DataFrame, *blocks: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns from ordered blocks; a later block may read
    columns produced by an earlier one (one ``withColumns`` per block)."""
    for block in blocks:
        df = df.withColumns(dict(block))
    return df


def null_as(dtype: DataType | str) -> Column:
    """Typed NULL placeholder (never a void column)."""
    return F.lit(None).cast(dtype)


def const(value) -> Column:
    """Constant."""
    return F.lit(value)


def project(df: DataFrame, spec: Sequence[tuple[Column | str, str]]) -> DataFrame:
    """Spec-driven target projection — ordered ``(expression, alias)`` pairs."""
    return df.select(*[(F.col(e) if isinstance(e, str) else e).alias(name) for e, name in spec])
