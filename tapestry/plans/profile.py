"""Entity profile: consolidate a hub table, its code-table lookups and any
number of satellites into one wide row per entity with nested arrays.

Plan shape (what Catalyst receives as ONE logical plan):

    hub ─⟕ code tables (bounded broadcast) ──────────────┐
    satellite_1 ─ (link / code joins) ─ groupBy(key) ─────⟕ by key
    satellite_2 ─ ... ─ groupBy(key) ─────────────────────⟕ by key
                                        └─ derive (merge arrays/maps, pick,
                                           roles) ─ projection spec ─ DQ

Every satellite is aggregated to one row per key *before* it meets the spine
(no fan-out), and every aggregate is hash-partitioned on the same key, so the
spine joins reuse that partitioning instead of re-shuffling.  Hot keys can be
split with ``salt_buckets`` (two-phase nesting, see ``operators.nest``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tapestry.operators.lookup import Lookup, attach, lookup_chain
from tapestry.operators.nest import Nest, NestConcat, nest_many
from tapestry.operators.project import derive, project
from tapestry.operators.quality import apply_rules, flatten_results


@dataclass
class Satellite:
    """A satellite table aggregated to one row per entity key.

    ``prepare`` turns the raw satellite into rows carrying the entity key in
    column ``key`` (for instance through a link table); ``nests`` are the
    nested columns; ``how`` is 'inner' for a mandatory satellite, 'left' for an
    optional one."""

    name: str
    frame: DataFrame
    key: str
    nests: Mapping[str, Nest | NestConcat | Column]
    how: str = "left"
    prepare: Callable[[DataFrame], DataFrame] | None = None
    salt_buckets: int = 0

    def aggregate(self) -> DataFrame:
        df = self.prepare(self.frame) if self.prepare else self.frame
        return nest_many(df, self.key, self.nests, self.salt_buckets)


@dataclass
class ProfileSpec:
    key: str
    lookups: Sequence[Lookup] = ()
    satellites: Sequence[Satellite] = ()
    derive: Sequence[Mapping[str, Column]] = ()
    projection: Sequence[tuple[Column | str, str]] = ()
    dq_rules: str | None = None
    dq_now: Column | None = None


def build_profile(hub: DataFrame, spec: ProfileSpec) -> DataFrame:
    spine = lookup_chain(hub, spec.lookups)
    for sat in spec.satellites:
        spine = attach(spine, sat.aggregate(), spec.key, sat.how)
    spine = derive(spine, *spec.derive)
    out = project(spine, spec.projection) if spec.projection else spine
    if spec.dq_rules:
        out = flatten_results(apply_rules(out, spec.dq_rules, spec.dq_now))
    return out
