"""Shards of nearly equal bytes by a minimax contiguous partition.

Documents of equal text form an atomic group.  Groups stand in the order of a
128-bit digest of their text, and shards are runs of that order, so where a
document goes follows from its digest and the cuts alone.

1. Equal rows are counted first (no key is hot from here on), then dealt to
   ranges of (digest, id); running sums of bytes and rows within the ranges and
   totals of the ranges give every group its place.
2. A group larger than the average of what is left has a shard to itself
   (at most one for each shard); the law would leave shards empty otherwise.
3. The smallest capacity at which a greedy fill of the ordered sizes needs no
   more than the remaining shards is found by binary search.  The driver does
   not hold the sizes: it knows some running totals, runs each greedy check
   with the lowest and the highest totals that agree with them, and asks one
   job for ``BINS`` more totals in each stretch where a cut may still lie.  A
   stretch shrinks by more than a hundred times a round, so a handful of rounds
   give the exact capacity and cuts at any size of input.
4. Cuts are taken greedily at that capacity.

What reaches the driver: 2 * BINS totals for each of fewer than ``shards``
stretches a round, and the ``shards`` largest groups.

Edge cases: a NULL text counts as empty (its size is 1) and is grouped with
empty texts; rows with a NULL id keep their place (first in their group);
equal rows each have a slot; with fewer groups than shards the last ones stay
empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestry.llm.common import stage

SHARDS = 16
BINS = 4096
#: Copies of one row that a slot list holds at a time.
CHUNK = 4096

#: probe(stretches, bins) -> smallest, largest and number of the totals in each
#: occupied bin of each stretch (a, b): a < total < b.
Probe = Callable[[list[tuple[int, int]], int], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Totals:
    """What is known of the ascending running totals: some of them, and between
    which neighbours there are no others."""

    def __init__(self, total: int):
        self.known = np.array([0, total], np.int64)
        self.whole = np.array([False, True])  # no unknown total up to the next known one

    def learn(self, stretches: list[tuple[int, int]], low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        done = set(self.known[self.whole].tolist())
        self.known = np.unique(np.concatenate([self.known, low, high]))
        self.whole = np.isin(self.known, np.fromiter(done, np.int64, len(done)))
        for a, b in stretches:
            i, j = np.searchsorted(self.known, [a, b])
            self.whole[i:j] = True
        first, last = np.searchsorted(self.known, low), np.searchsorted(self.known, high)
        for i, j, n in zip(first.tolist(), last.tolist(), count.tolist(), strict=True):
            if n > j - i + 1:
                self.whole[i:j] = False

    def fill(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        """Ends of greedily filled shards: each at least (or, if optimistic, at
        most) the largest total within the capacity."""
        ends, at = [], 0
        for _ in range(shards):
            reach = at + capacity
            i = int(np.searchsorted(self.known, reach, "right")) - 1
            at = int(self.known[i])
            if optimistic and not self.whole[i]:
                at = min(reach, int(self.known[i + 1]) - 1)
            ends.append(at)
        return ends

    def least(self, low: int, high: int, shards: int, optimistic: bool) -> int:
        """The smallest capacity of low..high whose fill reaches the last total."""
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, optimistic)[-1] >= self.known[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(total: int, largest: int, shards: int, probe: Probe, bins: int = BINS) -> tuple[int, list[int]]:
    """(capacity, ends of the shards) of the contiguous partition whose largest
    shard is smallest; ``probe`` looks at the running totals of the sizes."""
    if total == 0:
        return 0, [0] * shards
    low = max(largest, -(-total // shards))
    high = low + largest  # a greedy fill wastes less than one group a shard
    seen = Totals(total)
    while True:
        sure = seen.least(low, high, shards, optimistic=False) if seen.fill(high, shards, False)[-1] >= total else high
        low, high = seen.least(low, sure, shards, optimistic=True), sure
        ranges = zip(seen.fill(low, shards, False), seen.fill(high, shards, True), strict=True)
        stretches: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            i, j = (int(x) for x in np.searchsorted(seen.known, [a, b], "right") - 1)
            open_ = np.flatnonzero(~seen.whole[i : j + 1]) + i
            if len(open_):
                start, end = int(seen.known[open_[0]]), int(seen.known[open_[-1] + 1])
                if stretches and start <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], max(end, stretches[-1][1]))
                else:
                    stretches.append((start, end))
        if not stretches:
            return low, seen.fill(low, shards, False)
        seen.learn(stretches, *probe(stretches, bins))


@dataclass(frozen=True)
class Lone:
    """A group with a shard to itself, and where it ends in the whole order."""

    key: bytes
    size: int
    rows: int
    end: int


def lone_groups(top: list[Lone], total: int, shards: int) -> list[Lone]:
    """Of the largest groups (descending), those above the average of the rest."""
    alone: list[Lone] = []
    for g in top:
        left = shards - len(alone)
        if left == 1 or g.size * left <= total:
            break
        alone.append(g)
        total -= g.size
    return alone


@dataclass(frozen=True)
class ShardPlan:
    """Where shards end: digests of their last groups, then the lone groups."""

    shards: int
    capacity: int
    last_keys: list[bytes]
    lone: list[Lone]

    def shard(self, key: Column) -> Column:
        """The shard of a digest."""
        among = sum((F.when(key > F.lit(k), 1).otherwise(0) for k in self.last_keys), F.lit(0))
        first = self.shards - len(self.lone)
        for i, g in enumerate(self.lone):
            among = F.when(key == F.lit(g.key), first + i).otherwise(among)
        return among.cast("int")


def digest(text: Column) -> Column:
    """128 bits of a text; NULL as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def place_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (key, doc_id) with size, crc, copies, and the bytes and rows
    that stand before them in the order of (key, doc_id)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        digest(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"),
    )
    rows = rows.groupBy("key", "doc_id", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, bytes_, count = context.partitionId() if context else 0, 0, 0
        for batch in batches:
            n = batch.column("copies").to_numpy()
            size = n * batch.column("size").to_numpy()
            b, c = bytes_ + np.cumsum(size), count + np.cumsum(n)
            columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(b - size), pa.array(c - n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "bytes_in", "rows_in"])
            if len(n):
                bytes_, count = int(b[-1]), int(c[-1])

    ordered = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    kind = "key binary, doc_id long, size long, crc long, copies long, part int, bytes_in long, rows_in long"
    numbered = stage(ordered.mapInArrow(run, kind), "shard-rows")
    # one row a range from here: their totals give each range its start
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = numbered.groupBy("part").agg(F.max(F.expr("bytes_in + size * copies")).alias("b"), F.max(F.expr("rows_in + copies")).alias("c"))
    starts = ends.select("part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    placed = numbered.join(starts, "part")
    return placed.select("key", "doc_id", "size", "crc", "copies", (F.col("b") + F.col("bytes_in")).alias("bytes_at"), (F.col("c") + F.col("rows_in")).alias("rows_at"))


def without(lone: list[Lone], place: Column, what: str) -> Column:
    """A byte place with the lone groups before it taken out of the order."""
    return place - sum((F.when(F.col("bytes_at") >= g.end, getattr(g, what)).otherwise(0) for g in lone), F.lit(0))


def plan_shards(placed: DataFrame, shards: int = SHARDS, bins: int = BINS) -> ShardPlan:
    """The minimax plan of placed rows; groups stay distributed."""
    groups = placed.groupBy("key").agg(
        F.max(F.expr("bytes_at + size * copies")).alias("bytes_at"),
        F.sum(F.expr("size * copies")).alias("bytes"), F.sum("copies").alias("rows"),
    )
    groups = stage(groups, "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    lone = lone_groups([Lone(bytes(r["key"]), r["bytes"], r["rows"], r["bytes_at"]) for r in top], total, shards)
    kept = groups.where(~F.col("key").isin([F.lit(g.key) for g in lone])) if lone else groups
    ends = kept.select("key", without(lone, F.col("bytes_at"), "size").alias("at"))

    def probe(stretches: list[tuple[int, int]], bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = F.lit(None).cast("struct<i:int,bin:bigint>")
        for i, (a, b) in enumerate(stretches):
            width = -(-(b - a) // bins)
            bin_ = F.struct(F.lit(i).alias("i"), F.expr(f"(at - {a}) div {width}").alias("bin"))
            of = F.when((F.col("at") > a) & (F.col("at") < b), bin_).otherwise(of)
        seen = ends.withColumn("of", of).where("of IS NOT NULL").groupBy("of").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n"))
        got = seen.select("a", "b", "n").toPandas().astype(np.int64)
        return got["a"].to_numpy(), got["b"].to_numpy(), got["n"].to_numpy()

    rest = total - sum(g.size for g in lone)
    largest = max((r["bytes"] for r in top if bytes(r["key"]) not in {g.key for g in lone}), default=0)
    if len(lone) == shards:  # no more groups than shards
        return ShardPlan(shards, 0, [], lone)
    capacity, cuts = minimax_cuts(rest, largest, shards - len(lone), probe, bins)
    inner = sorted({c for c in cuts if 0 < c < rest})
    keys = [bytes(r["key"]) for r in ends.where(F.col("at").isin(inner)).collect()] if inner else []
    return ShardPlan(shards, capacity, sorted(keys), lone)


def shard_table(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = place_rows(docs, id_col, text_col)
    plan = plan_shards(placed, shards)
    alone = F.col("key").isin([F.lit(g.key) for g in plan.lone]) if plan.lone else F.lit(False)
    at = F.when(alone, F.col("rows_at")).otherwise(without(plan.lone, F.col("rows_at"), "rows"))
    rows = placed.select("doc_id", "size", "crc", "copies", plan.shard(F.col("key")).alias("shard"), at.alias("at"))
    first = rows.groupBy("shard").agg(F.min("at").alias("first"))  # a row a shard
    rows = rows.join(F.broadcast(first), "shard").withColumn("run", F.explode(F.expr(f"sequence(0L, copies - 1, {CHUNK}L)")))
    rows = rows.withColumn("k", F.explode(F.expr(f"sequence(run, least(run + {CHUNK}, copies) - 1)")))
    return rows.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.expr("at - first + k").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> ShardPlan:
    """Write the rows, with all their columns, to one folder a shard, in the
    order of slots; returns the plan.  ``shard_col`` must not be a column of
    the table."""
    if shard_col in docs.columns:
        raise ValueError(f"the table has a column {shard_col!r}: name another shard_col")
    plan = plan_shards(place_rows(docs, id_col, text_col), shards)
    key = digest(F.col(text_col))
    dealt = docs.withColumn(shard_col, plan.shard(key))
    dealt.repartitionByRange(F.col(shard_col), key, F.col(id_col)).sortWithinPartitions(F.col(shard_col), key, F.col(id_col)).write.partitionBy(shard_col).parquet(path)
    return plan
