"""Lookup and satellite joins.

Code tables are pruned to the columns used and joined; whether one is broadcast
is the planner's choice by bytes (``spark.sql.autoBroadcastJoinThreshold``, and
again by AQE on what was really read), so building a plan runs no job.  A
caller who knows better sets ``hint``.  Satellite aggregates are keyed by the
spine key, so joining them onto the spine reuses the hash partitioning produced
by their ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Lookup:
    """One join to a code table: ``left_on`` (fact column or Column) equals
    ``right_on`` (code column).  ``select`` prunes the code table; ``distinct``
    de-duplicates it first (D7); ``trim`` compares trimmed keys (D4);
    ``where`` filters the joined rows (C2); ``hint`` is a join hint such as
    'broadcast' or 'shuffle_hash'."""

    table: DataFrame
    left_on: str | Column
    right_on: str
    how: str = "left"
    select: Sequence[str] | None = None
    distinct: bool = False
    trim: bool = False
    where: Column | None = None
    hint: str | None = None


def lookup(df: DataFrame, spec: Lookup) -> DataFrame:
    """Join ``df`` to a (projected, optionally de-duplicated) code
    table; inner drops uncoded rows, left keeps them."""
    right = spec.table
    if spec.select is not None:
        cols = list(dict.fromkeys([spec.right_on, *spec.select]))
        right = right.select(*cols)
    if spec.distinct:
        right = right.distinct()
    if spec.hint:
        right = right.hint(spec.hint)
    lcol = F.col(spec.left_on) if isinstance(spec.left_on, str) else spec.left_on
    rcol = right[spec.right_on]
    cond = (F.trim(lcol) == F.trim(rcol)) if spec.trim else (lcol == rcol)
    out = df.join(right, cond, spec.how)
    if spec.where is not None:
        out = out.filter(spec.where)
    return out


def lookup_chain(df: DataFrame, specs: Sequence[Lookup]) -> DataFrame:
    """Chain of lookups from one fact table (star join).  Fan-out from a
    non-unique code key is preserved, and two inner lookups on the same code
    both have to match."""
    for spec in specs:
        df = lookup(df, spec)
    return df


def attach(spine: DataFrame, agg: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join an aggregated satellite onto the spine by key (USING join, key
    kept once); inner for a mandatory satellite, left for an optional one."""
    keys = [key] if isinstance(key, str) else list(key)
    return spine.join(agg, keys, how)


def join_back(df: DataFrame, key: str | Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate ``df`` by ``key`` and join the aggregate back onto its own
    ungrouped rows (USING join).  The input is read once for each side; the
    aggregate side is combined before its shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "inner")
