"""Struct, array and map helpers.

All of them are native higher-order functions: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.functions._util import as_col


def shape(fields: Mapping[str, object] | list[tuple[str, object]]) -> Column:
    """A struct built from an ordered ``name -> Column`` spec.  Field order
    is part of the shape (it decides how ``sort_array`` orders structs)."""
    items = fields.items() if isinstance(fields, Mapping) else fields
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in items])


def merge_arrays(*cols, sort: str | None = None) -> Column:
    """NULL-safe concatenation of arrays (a NULL array counts as empty),
    optionally sorted ``'asc'`` (NULL first) or ``'desc'`` (NULL last)."""
    out = F.concat(*[F.coalesce(as_col(c), F.array()) for c in cols])
    if sort is None:
        return out
    return F.sort_array(out, asc=(sort == "asc"))


def merge_maps(*cols) -> Column:
    """NULL-safe ``map_concat`` (a NULL map counts as empty).  Duplicate
    keys raise under the default ``spark.sql.mapKeyDedupPolicy``."""
    return F.map_concat(*[F.coalesce(as_col(c), F.create_map()) for c in cols])


def keyed_map(arr, key: str) -> Column:
    """Array of structs -> map keyed by the struct field ``key``.  One element:
    key is the field value; several: ``value_1 .. value_n`` in array order; empty
    array: empty map.  A NULL key value is written ``None``."""
    a = as_col(arr)
    n = F.size(a)

    def entry(x, i):
        k = F.coalesce(x[key].cast("string"), F.lit("None"))
        k = F.when(n == 1, k).otherwise(F.concat(k, F.lit("_"), (i + 1).cast("string")))
        return F.struct(k.alias("key"), x.alias("value"))

    return F.map_from_entries(F.transform(a, entry))


def cross_apply(outer, inner, assign: Mapping[str, object], *, keep_when_empty: bool = True,
                distinct_groups_: bool = True) -> Column:
    """For every element ``t`` of ``outer`` and ``q`` of ``inner`` emit ``q``
    with fields overwritten by ``assign`` (values are callables ``(t, q) -> Column``).

    The nested result is de-duplicated by *group* (J9) and flattened.  With
    ``keep_when_empty`` an empty/NULL ``outer`` leaves ``inner`` unchanged (J7);
    without it the result follows ``outer`` (empty outer -> empty, NULL -> NULL),
    which is the J8 behaviour.
    """
    o, q_arr = as_col(outer), as_col(inner)

    def per_t(t):
        def per_q(q):
            out = q
            for field, fn in assign.items():
                out = out.withField(field, fn(t, q))
            return out

        return F.transform(q_arr, per_q)

    nested = F.transform(o, per_t)
    result = F.flatten(F.array_distinct(nested) if distinct_groups_ else nested)
    if keep_when_empty:
        return F.when(F.coalesce(F.size(o), F.lit(0)) > 0, result).otherwise(q_arr)
    return result


def distinct_groups(arr2d) -> Column:
    """Drop duplicate *groups* (inner arrays) before flattening; elements
    repeated across different groups survive."""
    return F.flatten(F.array_distinct(as_col(arr2d)))


def pick(arr, pred, field: str | None = None) -> Column:
    """First element satisfying ``pred`` (a ``Column -> Column`` lambda), or
    one of its fields; NULL when nothing matches (ANSI-safe ``get``)."""
    hit = F.get(F.filter(as_col(arr), pred), F.lit(0))
    return hit if field is None else hit[field]


def first_of(arr) -> Column:
    """First element or NULL when empty/NULL (ANSI-safe)."""
    return F.get(as_col(arr), F.lit(0))


def first_field(arr, field: str) -> Column:
    """A field of the first element."""
    return first_of(arr)[field]


def non_empty(arr) -> Column:
    """True when the array has at least one element (NULL counts as empty)."""
    return F.coalesce(F.size(as_col(arr)), F.lit(0)) > 0
