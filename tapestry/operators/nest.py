"""Nested aggregation of satellites.

A ``Nest`` describes one nested output column: structs (or scalars) collected
per key into an array, optionally distinct, sorted ascending (NULL first) or
descending (NULL last).  ``nest_many`` evaluates any number of them in ONE
aggregate over ONE shuffle.

Skew: ``collect_list`` already combines map-side, but the final merge of a
hot key runs in one task.  With ``salt_buckets`` the aggregate runs in two
phases — partial arrays per (key, salt) where the salt is a deterministic hash
of the collected values (stable under task retries), then a concatenation per
key — so building, de-duplicating and shipping the values of a hot key is
spread over ``salt_buckets`` tasks.  The result is identical to one phase.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.functions.keys import first_non_empty


@dataclass
class Nest:
    """Collect ``value`` per group.  ``order``: 'asc', 'desc' or None (unsorted);
    ``distinct`` uses set semantics (E2/E3); NULL values are dropped by Spark's
    collectors, but a struct whose fields are all NULL is kept."""

    value: Column
    order: str | None = "desc"
    distinct: bool = False

    def _sort(self, arr: Column) -> Column:
        return arr if self.order is None else F.sort_array(arr, asc=(self.order == "asc"))

    def one_phase(self) -> Column:
        coll = F.collect_set(self.value) if self.distinct else F.collect_list(self.value)
        return self._sort(coll)

    def partial(self) -> list[Column]:
        return [F.collect_set(self.value) if self.distinct else F.collect_list(self.value)]

    def final(self, parts: list[Column]) -> Column:
        merged = F.flatten(F.collect_list(parts[0]))
        if self.distinct:
            merged = F.array_distinct(merged)
        return self._sort(merged)

    def inputs(self) -> list[Column]:
        return [self.value]


@dataclass
class NestConcat:
    """Several collected lists concatenated inside the aggregate, then
    sorted — ``sort_array(concat(collect_list(a), collect_list(b), ...))``."""

    values: Sequence[Column]
    order: str | None = "asc"

    def _sort(self, arr: Column) -> Column:
        return arr if self.order is None else F.sort_array(arr, asc=(self.order == "asc"))

    def one_phase(self) -> Column:
        return self._sort(F.concat(*[F.collect_list(v) for v in self.values]))

    def partial(self) -> list[Column]:
        return [F.collect_list(v) for v in self.values]

    def final(self, parts: list[Column]) -> Column:
        return self._sort(F.concat(*[F.flatten(F.collect_list(p)) for p in parts]))

    def inputs(self) -> list[Column]:
        return list(self.values)


@dataclass
class NestUnion:
    """Union of arrays collected per group — ``value`` is already an array
    (for instance a set pre-aggregated at a finer grain before the shuffle);
    the result is their concatenation, de-duplicated with ``distinct`` and
    sorted.  Pre-aggregating at the finer grain keeps the shuffle small."""

    value: Column
    order: str | None = "asc"
    distinct: bool = True

    def _finish(self, arr: Column) -> Column:
        if self.distinct:
            arr = F.array_distinct(arr)
        return arr if self.order is None else F.sort_array(arr, asc=(self.order == "asc"))

    def one_phase(self) -> Column:
        return self._finish(F.flatten(F.collect_list(self.value)))

    def partial(self) -> list[Column]:
        return [F.flatten(F.collect_list(self.value))]

    def final(self, parts: list[Column]) -> Column:
        return self._finish(F.flatten(F.collect_list(parts[0])))

    def inputs(self) -> list[Column]:
        return [self.value]


def nest(value: Column, order: str | None = "desc", distinct: bool = False) -> Column:
    """E1/E2/E3/G1/G2 as a single aggregate Column (one phase)."""
    return Nest(value, order, distinct).one_phase()


def nest_concat(*values: Column, order: str | None = "asc") -> Column:
    """E6 as a single aggregate Column."""
    return NestConcat(values, order).one_phase()


def nest_many(
    df: DataFrame,
    keys: str | Sequence[str],
    nests: Mapping[str, Nest | NestConcat | NestUnion | Column],
    salt_buckets: int = 0,
) -> DataFrame:
    """Group by ``keys`` and build every nested column in one pass.

    Plain aggregate Columns (``count``, ``max`` ...) may be mixed in when
    ``salt_buckets`` is 0.  With ``salt_buckets > 1`` every entry must be a
    ``Nest``/``NestConcat`` and the two-phase plan described above is used.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if salt_buckets <= 1:
        aggs = [(n.one_phase() if isinstance(n, (Nest, NestConcat, NestUnion)) else n).alias(name) for name, n in nests.items()]
        return df.groupBy(*keys).agg(*aggs)

    specs = dict(nests)
    bad = [k for k, v in specs.items() if not isinstance(v, (Nest, NestConcat, NestUnion))]
    if bad:
        raise ValueError(f"salted nesting needs Nest specs, got plain columns for {bad}")
    inputs = [c for n in specs.values() for c in n.inputs()]
    salt = F.pmod(F.xxhash64(*inputs), F.lit(salt_buckets)).alias("__salt")
    partial_cols, names = [], {}
    for name, n in specs.items():
        parts = n.partial()
        names[name] = [f"__{name}__p{i}" for i in range(len(parts))]
        partial_cols += [p.alias(a) for p, a in zip(parts, names[name])]
    stage1 = df.groupBy(*keys, salt).agg(*partial_cols)
    finals = [n.final([F.col(a) for a in names[name]]).alias(name) for name, n in specs.items()]
    return stage1.groupBy(*keys).agg(*finals)


def primary_of(arr: Column, field: str | None = None) -> Column:
    """First element of an (ascending) collected list as the primary."""
    hit = F.get(arr, F.lit(0))
    return hit if field is None else hit[field]


def schedule_entries(
    days: Mapping[str, tuple[str, str, str, str]],
    extra: Sequence[tuple[str, Column]] = (),
    day_field: str = "day",
    start_field: str = "start_time",
    end_field: str = "end_time",
) -> Column:
    """J4 per row: ``array<struct>`` with one entry per day — ``extra`` fields,
    the day label, and the first non-empty start / end shift (start1 unless it
    is NULL or '', else start2; same for the end)."""
    return F.array(
        *[
            F.struct(
                *[c.alias(n) for n, c in extra],
                F.lit(label).alias(day_field),
                first_non_empty(s1, s2).alias(start_field),
                first_non_empty(e1, e2).alias(end_field),
            )
            for label, (s1, s2, e1, e2) in days.items()
        ]
    )


def nest_schedules(
    df: DataFrame,
    key: str,
    days: Mapping[str, tuple[str, str, str, str]],
    extra: Sequence[tuple[str, Column]] = (),
    day_field: str = "day",
    start_field: str = "start_time",
    end_field: str = "end_time",
) -> DataFrame:
    """J4 per key: ``schedule``, the sorted entries of all rows of a key.  One
    struct a row (the ``extra`` fields once, a shift for each day) goes through
    the shuffle and is expanded to one entry a day after it."""
    shifts = [F.struct(first_non_empty(s1, s2).alias("s"), first_non_empty(e1, e2).alias("e")).alias(f"d{k}")
              for k, (s1, s2, e1, e2) in enumerate(days.values())]
    packed = df.select(key, F.struct(*[c.alias(n) for n, c in extra], *shifts).alias("line")).groupBy(key).agg(F.collect_list("line").alias("lines"))

    def entries(x: Column) -> Column:
        return F.array(*[
            F.struct(*[x[n].alias(n) for n, _ in extra], F.lit(label).alias(day_field), x[f"d{k}"]["s"].alias(start_field), x[f"d{k}"]["e"].alias(end_field))
            for k, label in enumerate(days)
        ])

    return packed.select(key, F.sort_array(F.flatten(F.transform("lines", entries))).alias("schedule"))


def unpivot_schedule(
    df: DataFrame,
    days: Mapping[str, tuple[str, str, str, str]],
    keep: Sequence[str],
    day_field: str = "day",
    start_field: str = "start_time",
    end_field: str = "end_time",
) -> DataFrame:
    """J4 as rows: one row per (input row, day).  To nest the schedule per key,
    prefer ``NestUnion(schedule_entries(...), order='asc', distinct=False)``:
    the same sorted array, with one shuffled row per input row instead of one
    per day."""
    entries = schedule_entries(days, day_field=day_field, start_field=start_field, end_field=end_field)
    return df.select(*keep, F.explode(entries).alias("__d")).select(*keep, "__d.*")
