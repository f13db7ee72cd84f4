"""The prefix trie of conversations, as double arrays over prefix shards.

1. Conversations become paths of 128-bit turn digests; equal paths are merged
   with partial aggregates, so copies of any number are one path.  The ids that
   end at a path are hashed in order from chunks that many tasks join.
2. Paths are range-partitioned in lexicographic order, and consecutive paths
   form a prefix shard of bounded size: a shard holds whole subtrees, and only
   the nodes on its first and last path can continue in other shards, whatever
   first turn a third of all conversations may share.
3. A shard packs BASE and CHECK arrays over dense turn ids: the child of state
   s by turn t is BASE[s] + t, and CHECK of that slot is s.  Walking every path
   through the arrays gives each node its members; sums go from children to
   parents along CHECK, from the deepest level up.
4. Nodes on a shard's first and last path stay open and go into its summary.
   Consecutive summaries are merged along one stack: shared upper nodes add up,
   nodes that no later path can reach are closed.  A task merges its shards,
   then ``FAN`` tasks' summaries are merged at a time until one is left.
5. Children of nodes that were open when they were written get their parent's
   conversation by a join on the open nodes alone.

A task holds one shard (``SHARD_TURNS`` turns and the last conversation) or the
boundary paths of ``FAN`` summaries.  One conversation's turns (about 30 bytes
each) are one row.

Edge cases: a NULL role or text is empty; NULL turns come first; equal turn
numbers are ordered by their digest; equal rows are turns of their own; rows
with a NULL conv_id belong to no conversation and take no part; conversations
without turns are members of the root; an empty table has no members and so
gives no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import release, stage

SHARD_TURNS = 1 << 17
FAN = 64
CHUNK_IDS = 1 << 16
NO_CONV = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT_ID = hashlib.md5(b"").digest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary, parent_id binary"
ROWS = f"{NODES}, part int, summary binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[c.split()[1]] for c in ROWS.split(", ")]
#: Numbers of an open node in a summary, in this order.
N_CONVS, CONV, CHILDREN, LEAVES, SAVED, BYTES = range(6)


# --- double array ------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK over ids 0..ids-1; slot 0 is the root."""

    FREE, ROOT = -1, -2

    def __init__(self, ids: int, room: int):
        self.base = np.zeros(room + ids + 1, np.int64)
        self.check = np.full(room + ids + 1, self.FREE, np.int64)
        self.check[0] = self.ROOT
        self.low = 1  # no free slot below

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, self.FREE, np.int64)])

    def _first_fit(self, ids: np.ndarray, window: int = 1024) -> int:
        """The smallest base from ``low`` on that finds every child's slot free."""
        at = self.low
        while True:
            self._grow(at + window + int(ids[-1]) + 1)
            slots = np.flatnonzero(self.check[at : at + window] == self.FREE) + at
            for step in (ids[1:] - ids[0]).tolist():
                slots = slots[self.check[slots + step] == self.FREE]
                if not len(slots):
                    break
            if len(slots):
                return int(slots[0] - ids[0])
            at += window

    def add_level(self, states: np.ndarray, ids: np.ndarray) -> None:
        """Children of one level: distinct (state, id), those of a state side by
        side and in ascending order of ids."""
        starts = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
        fan = np.diff(np.append(starts, len(states)))
        for a, n in zip(starts[fan > 1].tolist(), fan[fan > 1].tolist(), strict=True):
            base = self._first_fit(ids[a : a + n])
            self.base[states[a]] = base
            self.check[base + ids[a : a + n]] = states[a]
        alone = starts[fan == 1]  # any free slot will do
        free = np.flatnonzero(self.check[self.low :] == self.FREE)[: len(alone)] + self.low
        if len(free) < len(alone):
            self._grow(len(self.check) + len(alone))
            free = np.flatnonzero(self.check[self.low :] == self.FREE)[: len(alone)] + self.low
        self.base[states[alone]] = free - ids[alone]
        self.check[free] = states[alone]
        used = np.flatnonzero(self.check[self.low :] == self.FREE)
        self.low += int(used[0]) if len(used) else len(self.check) - self.low

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of states by ids, which must exist."""
        to = self.base[states] + ids
        if not (self.check[to] == states).all():
            raise ValueError("no such path in the trie")
        return to


# --- summaries ---------------------------------------------------------------


@dataclass
class Open:
    """A node whose subtree may go on in a neighbouring shard."""

    turn: bytes  # digest of its last turn
    numbers: list[int]
    ends: bytes  # sha-256 of the members that end here, or nothing
    id: bytes = b""
    digest: object = None  # md5 of the path so far
    first: bool = False  # lies on the first path of all


@dataclass
class Summary:
    """Open nodes of a run of paths: those of its first path, then those of its
    last path (numbers of shared nodes stand in the first only)."""

    paths: list[list[Open]] = field(default_factory=list)

    def dump(self) -> bytes:
        out = []
        for path in self.paths:
            numbers = np.array([n.numbers for n in path], "<i8").reshape(-1, 6)
            ends = b"".join(n.ends.ljust(32, b"\0") for n in path)
            held = bytes(len(n.ends) > 0 for n in path)
            out += [np.array([len(path)], "<i8").tobytes(), b"".join(n.turn.ljust(16, b"\0") for n in path), numbers.tobytes(), held, ends]
        return b"".join(out)

    @staticmethod
    def load(raw: bytes) -> Summary:
        paths, at = [], 0

        def take(n: int) -> bytes:
            nonlocal at
            at += n
            return raw[at - n : at]

        while at < len(raw):
            n = int(np.frombuffer(take(8), "<i8")[0])
            turns, numbers, held, ends = take(16 * n), np.frombuffer(take(48 * n), "<i8").reshape(-1, 6).tolist(), take(n), take(32 * n)
            paths.append([Open(turns[16 * k : 16 * k + 16] if k else b"", numbers[k], ends[32 * k : 32 * k + 32] if held[k] else b"") for k in range(n)])
        return Summary(paths)


def nothing() -> list[int]:
    return [0, NO_CONV, 0, 0, 0, 0]


class Spine:
    """Merges the summaries of consecutive runs of paths along one stack.

    ``whole`` says that no other paths exist, so every node closes here.
    """

    def __init__(self, whole: bool = False):
        self.whole = whole
        self.stack: list[Open] = []
        self.kept: list[Open] = []  # open nodes of the first path that the stack has left
        self.closed: list[tuple] = []
        self.length = 0

    def add(self, summary: Summary) -> None:
        for path in summary.paths:
            self._push(path)

    def _push(self, path: list[Open]) -> None:
        first = not self.stack
        same = 0
        while same < min(len(path), len(self.stack)) and path[same].turn == self.stack[same].turn:
            same += 1
        while len(self.stack) > same:
            self._pop()
        for mine, new in zip(self.stack, path, strict=False):
            for k in (N_CONVS, CHILDREN, LEAVES, SAVED):
                mine.numbers[k] += new.numbers[k]
            mine.numbers[CONV] = min(mine.numbers[CONV], new.numbers[CONV])
            mine.numbers[BYTES] = max(mine.numbers[BYTES], new.numbers[BYTES])
            mine.ends = mine.ends or new.ends
        for new in path[same:]:
            new.digest = self.stack[-1].digest.copy() if self.stack else hashlib.md5()
            new.digest.update(new.turn)
            new.id, new.first = new.digest.digest(), first and not self.whole
            self.stack.append(new)
        if first:
            self.length = len(path)

    def _pop(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.first:
            self.kept.append(node)
            return
        n = node.numbers
        leaves, saved = n[LEAVES] if n[CHILDREN] else 1, n[SAVED] + (n[N_CONVS] - 1) * n[BYTES]
        ends = node.ends.hex() if node.ends else NO_ENDS
        self.closed.append((n[CONV], depth, None, n[N_CONVS], n[CHILDREN], leaves, saved, ends, node.id, self.stack[-1].id if self.stack else None, None, None))
        if self.stack:
            up = self.stack[-1].numbers
            up[CHILDREN] += 1
            up[LEAVES] += leaves
            up[SAVED] += saved

    def finish(self) -> Summary | None:
        """What stays open (nothing if the spine is whole)."""
        if self.whole:
            while self.stack:
                self._pop()
            return None
        last = [Open(n.turn, nothing() if n.first else n.numbers, b"" if n.first else n.ends) for n in self.stack]
        first = [n for n in self.stack if n.first] + self.kept[::-1]
        return Summary([first, last])


def rows_of(closed: list[tuple], part: int | None = None, summary: bytes | None = None) -> pa.RecordBatch:
    """Node rows of a spine, and its summary if it has one."""
    rows = closed + ([(None,) * 10 + (part, summary)] if summary is not None else [])
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


# --- one shard ---------------------------------------------------------------


def shard_nodes(path: list[bytes], sizes: np.ndarray, members: np.ndarray, least: np.ndarray, ends: list[bytes]) -> tuple[pa.RecordBatch, Summary]:
    """The closed nodes and the summary of a run of distinct, sorted paths.

    ``path`` are concatenated 16-byte digests, ``sizes`` the bytes of all texts
    one after the other, ``members`` and ``least`` the number and smallest of
    the conversations that end at each path, ``ends`` their hash.
    """
    length = np.fromiter((len(p) // 16 for p in path), np.int64, len(path))
    offset = np.cumsum(length) - length
    turns = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(length.sum()), [None, pa.py_buffer(b"".join(path))]).dictionary_encode()
    turn = turns.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    trie = DoubleArray(len(turns.dictionary), int(length.sum()) + 1)
    state = np.zeros(len(path), np.int64)
    deepest = int(length.max(initial=0))
    for d in range(deepest):  # pack, level by level
        on = np.flatnonzero(length > d)
        edges = np.unique(np.stack([state[on], turn[offset[on] + d]], axis=1), axis=0)
        trie.add_level(edges[:, 0], edges[:, 1])
        state[on] = trie.step(state[on], turn[offset[on] + d])

    slots = len(trie.check)
    numbers = np.zeros((slots, 6), np.int64)
    numbers[:, CONV] = NO_CONV
    depth = np.zeros(slots, np.int64)
    state = np.zeros(len(path), np.int64)
    for d in range(deepest + 1):  # traverse for the nodes' members
        on = np.flatnonzero(length >= d)
        if d:
            at = offset[on] + d - 1
            state[on] = trie.step(state[on], turn[at])
            depth[state[on]] = d
            numbers[state[on], BYTES] = sizes[at]
        np.add.at(numbers[:, N_CONVS], state[on], members[on])
        np.minimum.at(numbers[:, CONV], state[on], least[on])
    ending = dict(zip(state.tolist(), ends, strict=True))

    open_ = np.zeros(slots, bool)
    spines: list[list[int]] = []
    for k in (0, len(path) - 1):
        at = [0]
        for t in turn[offset[k] : offset[k] + length[k]].tolist():
            at.append(int(trie.base[at[-1]]) + t)
        open_[at] = True
        spines.append(at)

    nodes = np.flatnonzero((trie.check >= 0) & ~open_)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    levels = np.searchsorted(depth[nodes], np.arange(deepest + 2))
    for d in range(deepest, 0, -1):  # sums from children to parents
        here = nodes[levels[d] : levels[d + 1]]
        numbers[here, LEAVES] += numbers[here, CHILDREN] == 0
        numbers[here, SAVED] += (numbers[here, N_CONVS] - 1) * numbers[here, BYTES]
        up = trie.check[here]
        np.add.at(numbers[:, CHILDREN], up, 1)
        np.add.at(numbers[:, LEAVES], up, numbers[here, LEAVES])
        np.add.at(numbers[:, SAVED], up, numbers[here, SAVED])

    ids: dict[int, bytes] = {}
    for k, at in zip((0, len(path) - 1), spines, strict=True):
        digest = hashlib.md5()
        for d, slot in enumerate(at):
            digest.update(path[k][16 * (d - 1) : 16 * d] if d else b"")
            ids[slot] = digest.digest()
    up = trie.check[nodes]
    loose = open_[up]
    hashes = [ending[s].hex() if s in ending else NO_ENDS for s in nodes.tolist()]
    none = pa.nulls(len(nodes))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(numbers[nodes, CONV]), pa.array(depth[nodes]), pa.array(numbers[up, CONV], mask=loose), pa.array(numbers[nodes, N_CONVS]),
            pa.array(numbers[nodes, CHILDREN]), pa.array(numbers[nodes, LEAVES]), pa.array(numbers[nodes, SAVED]), pa.array(hashes, pa.string()),
            none.cast(pa.binary()), pa.array([ids[s] if o else None for s, o in zip(up.tolist(), loose.tolist(), strict=True)], pa.binary()),
            none.cast(pa.int32()), none.cast(pa.binary()),
        ],
        names=NAMES,
    )
    shared, summary = set(), Summary()
    for k, at in zip((0, len(path) - 1), spines, strict=True):
        summary.paths.append(
            [
                Open(
                    path[k][16 * (d - 1) : 16 * d] if d else b"",
                    nothing() if slot in shared else [int(x) for x in numbers[slot]],
                    b"" if slot in shared else ending.get(slot, b""),
                )
                for d, slot in enumerate(at)
            ]
        )
        shared.update(at)
    return batch, summary


def build_shards(shard_turns: int):
    """Partition function: sorted paths to closed nodes and one summary."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, spine = context.partitionId() if context else 0, Spine()
        held: list[pa.RecordBatch] = []
        turns = 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            path, ends = table.column("path").to_pylist(), table.column("ends").to_pylist()
            sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            batch, summary = shard_nodes(path, sizes, table.column("members").to_numpy(), table.column("least").to_numpy(), ends)
            spine.add(summary)
            yield batch
            if spine.closed:
                yield rows_of(spine.closed)
                spine.closed.clear()

        for batch in batches:
            length = np.fromiter((len(p) // 16 for p in batch.column("path").to_pylist()), np.int64, batch.num_rows)
            at = 0
            while at < batch.num_rows:
                run = np.cumsum(length[at:])
                n = min(int(np.searchsorted(run, shard_turns - turns)) + 1, batch.num_rows - at)
                held.append(batch.slice(at, n))
                turns += int(run[n - 1])
                at += n
                if turns >= shard_turns:
                    yield from close()
                    held.clear()
                    turns = 0
        if held:
            yield from close()
        summary = spine.finish() if spine.stack else None
        if summary:
            yield rows_of(spine.closed, part, summary.dump())
        release()

    return build


# --- plan --------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of
    (turn, digest in hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(member, turns): the first h turns of conversation c - c % ``group``,
    then c's own turns after its first h; h = crc32(c) % ``heads``."""
    of = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    base = convs.where(F.pmod(F.col("conv_id"), F.lit(group)) == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, heads - 1).alias("head"))
    own = convs.select(F.col("conv_id").alias("member"), of.alias("of"), h.alias("h"), "turns")
    none = F.expr("filter(turns, t -> false)")
    after = F.expr("slice(turns, h + 1, size(turns))")
    return own.join(base, "of", "left").select("member", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), after).alias("turns"))


def ends_of(members: DataFrame) -> DataFrame:
    """(path_id, ends): SHA-256 of each path's members, ascending and joined by
    commas.  Ranges of members are joined by many tasks; one task a path then
    streams over the chunks."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, member = batch.column("path_id").to_pylist(), batch.column("member").to_pylist()
            cuts = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1] or k % CHUNK_IDS == 0), len(path)]
            runs = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            ids = pa.array([",".join(map(str, member[a:b])).encode() for a, b in runs], pa.binary())
            first = [a for a, _ in runs]
            yield pa.RecordBatch.from_arrays([pa.array([path[a] for a in first], pa.binary()), pa.array([member[a] for a in first], pa.int64()), ids], names=["path_id", "least", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for path, ids in zip(batch.column("path_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if path == now:
                    digest.update(b"," + ids)
                    continue
                if now is not None:
                    done.append((now, digest.digest()))
                now, digest = path, hashlib.sha256(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done, strict=True)], names=["path_id", "ends"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.digest()], pa.binary())], names=["path_id", "ends"])

    ordered = members.repartitionByRange("path_id", "member").sortWithinPartitions("path_id", "member")
    joined = ordered.mapInArrow(chunks, "path_id binary, least long, ids binary")
    return joined.repartition("path_id").sortWithinPartitions("path_id", "least").mapInArrow(hashes, "path_id binary, ends binary")


def merger(whole: bool):
    """Group function: consecutive summaries to closed nodes and one summary."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        spine = Spine(whole)
        for raw in table.sort_by("part").column("summary").to_pylist():
            spine.add(Summary.load(raw))
        rest = spine.finish()
        return pa.Table.from_batches([rows_of(spine.closed, key[0].as_py(), rest.dump() if rest else None)])

    return merge


def merge_summaries(nodes: DataFrame) -> DataFrame:
    """All node rows, after merging the summaries among them level by level."""
    out = nodes.where("summary IS NULL")
    left = nodes.where("summary IS NOT NULL").select("part", "summary")
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        whole = parts < FAN

        level = left.groupBy(F.expr(f"part div {FAN}").cast("int").alias("over")).applyInArrow(merger(whole), ROWS)
        level = stage(level, "trie-merge")
        out = out.unionByName(level.where("summary IS NULL"))
        left = level.where("summary IS NOT NULL").select("part", "summary")
        parts = None if whole else parts // FAN
    return out.drop("part", "summary")


def prefix_trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of (member, turns), turns being structs with the
    fields ``digest`` (hex) and ``bytes``; one row a node."""
    hexed = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    sizes = F.transform("turns", lambda t: t["bytes"])
    paths = members.select("member", F.unhex(hexed).alias("path"), sizes.alias("sizes"))
    paths = stage(paths.withColumn("path_id", F.unhex(F.md5("path"))), "paths")
    distinct = paths.groupBy("path_id").agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("members"), F.min("member").alias("least")
    )
    distinct = distinct.join(ends_of(paths.select("path_id", "member")), "path_id").drop("path_id")
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    nodes = merge_summaries(stage(ordered.mapInArrow(build_shards(shard_turns), ROWS), "trie"))
    known = nodes.where("parent_conv_id IS NOT NULL OR depth = 0").drop("id", "parent_id")
    parents = nodes.where("id IS NOT NULL").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("up"))
    loose = nodes.where("parent_conv_id IS NULL AND depth > 0").join(parents, "parent_id", "left")
    columns = [c.split()[0] for c in NODES.split(", ")[:8]]
    return known.select(columns).unionByName(loose.withColumn("parent_conv_id", F.col("up")).select(columns))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_trie(rebuilt(stage(turn_rows(conversations), "conversations")), shard_turns)
