"""Flat text forms of nested values, used where a registered query is compared
with a SQL oracle (nested values hash differently across engines).  A NULL
field is written ``~``; fields are joined by ``|`` and elements by ``;``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "~"


def field_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL_MARK))


def struct_text(x: Column, fields: Sequence[str]) -> Column:
    return F.concat_ws("|", *[field_text(x[f]) for f in fields])


def arr_text(arr: Column | str, fields: Sequence[str] | None = None) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    if fields is None:
        return F.array_join(F.transform(a, field_text), ";")
    return F.array_join(F.transform(a, lambda x: struct_text(x, fields)), ";")


def map_text(m: Column | str, fields: Sequence[str] | None = None) -> Column:
    """Map entries sorted by key: ``key=value`` joined by ``;``."""
    c = F.col(m) if isinstance(m, str) else m
    entries = F.array_sort(F.map_entries(c))
    if fields is None:
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), field_text(e["value"]))), ";")
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), struct_text(e["value"], fields))), ";"
    )
