"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point: the lengths of their common prefix and common suffix then reach the
longer word's length minus one, and no other pair of distinct words does.

1. Words are counted natively, with map-side partial counts (a frequent word is
   one row a task).
2. Let m be the length of a pair's shorter word.  The edit leaves either the
   first m // 2 code points or the last m - m // 2 as they are, so each word is
   dealt to four blocks: its own length and one less, by prefix and by suffix.
   A pair found by prefix is not counted again by suffix.
3. A block of more than ``TILE`` words is cut into tiles by a hash of the word,
   and each two tiles meet in one task, so no block gathers in one task.
4. A tile pair is compared densely: code points as padded matrices, left-aligned
   for prefixes and right-aligned for suffixes, position by position.  It gives
   one row a word (number of near words, the most frequent one), not a row a
   pair.

A word's form is its near word of the largest count (ties: the smallest in
code-point order) if that count is at least ``ratio`` times its own; counts
grow by that ratio along a chain of forms, so chains are short and roots are
found by a few doubling joins.

Edge cases: a NULL text has no words; a NULL id counts as an empty one in the
planted deletions; a word of any length is compared whole (tiles hold fewer
long words); an empty table gives no rows; other columns are ignored; the same
rows twice count twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import lower_ascii, release, stage

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a tile, code points of a tile's matrix, and pairs compared at once.
TILE, CELLS, PAIRS = 1024, 1 << 21, 1 << 18
#: Rows of blocks that one task compares (about four for each word).
TASK_ROWS = 1 << 16


def with_slips(word: Column, doc_id: Column, every: int = 31) -> Column:
    """The word, less one code point where ``every`` divides the crc32 h of
    ``<doc_id>:<word>``: the one at h modulo the word's length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every != 0, word).otherwise(F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word))))


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least ``least_length`` code points and
    ``least_count`` occurrences."""
    # a shorter run cannot give a long enough word
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    words = found.select(with_slips(F.col("run"), F.col("id")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def tile_pairs(codes: np.ndarray, ends: np.ndarray, group: np.ndarray, tile: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (i, j) of rows of one group, with the lengths of their common
    prefix and suffix (up to m).

    ``codes`` holds the first m code points of each word, ``ends`` the last m
    (words have m or m + 1), ``group`` ascending group numbers, ``tile`` 0 for a
    block met with itself, else 1 or 2 for the two sides of a tile pair.
    """
    rows = np.arange(len(group))
    last = np.searchsorted(group, group, "right")
    partners = last - rows - 1
    before = np.cumsum(partners) - partners
    total = int(partners.sum())
    for at in range(0, total, PAIRS):
        k = np.arange(at, min(at + PAIRS, total))
        i = np.searchsorted(before, k, "right") - 1
        j = i + 1 + k - before[i]
        meet = (tile[i] == 0) | (tile[i] != tile[j])
        i, j = i[meet], j[meet]
        prefix, suffix = (np.zeros(len(i), np.int32) for _ in range(2))
        for matrix, length, order in ((codes, prefix, range(m)), (ends, suffix, range(m - 1, -1, -1))):
            alive = np.arange(len(i))
            for p in order:
                alive = alive[matrix[i[alive], p] == matrix[j[alive], p]]
                if not len(alive):
                    break
                length[alive] += 1
        yield i, j, prefix, suffix


def compare_rows(table: pa.Table, m: int, by_suffix: bool) -> pa.RecordBatch:
    """Of rows sorted by group, all of lengths m and m + 1: (word, near, best_n,
    best) for each word with a near one."""
    words = np.array(table.column("word").to_pylist(), object)
    n, tile = table.column("n").to_numpy(), table.column("tile").to_numpy()
    group = table.column("group").to_numpy()
    longer = np.fromiter((len(w) > m for w in words), bool, len(words))
    flat = lambda parts: np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").reshape(-1, m)
    codes, ends = flat(w[:m] for w in words), flat(w[-m:] for w in words)
    left, right = [], []
    for i, j, prefix, suffix in tile_pairs(codes, ends, group, tile, m):
        near = prefix + suffix >= m - 1 + (longer[i] | longer[j])
        near &= ~(longer[i] & longer[j])  # met again in the block of m + 1
        if by_suffix:
            near &= prefix < m // 2  # else met in the block of the prefix
        left.append(i[near])
        right.append(j[near])
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    of, first, count = np.unique(one[order], return_index=True, return_counts=True)
    best = other[order][first]
    return pa.RecordBatch.from_arrays(
        [pa.array(words[of], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array(words[best], pa.string())],
        names=["word", "near", "best_n", "best"],
    )


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile pairs of a sorted partition: (m, by_suffix, block, low, high) runs.
    Holds about two tiles at a time."""
    held: list[pa.Table] = []
    rows = 0

    def tiles(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Compares all complete runs; gives back the rest."""
        keys = [table.column(c).combine_chunks() for c in ("m", "by_suffix", "block", "low", "high")]
        change = np.zeros(len(table), bool)
        kind = np.zeros(len(table), bool)
        for k, key in enumerate(keys):
            differs = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            change[1:] |= differs
            if k < 2:
                kind[1:] |= differs
        group = np.cumsum(change)
        done = len(table) if last else int(np.searchsorted(group, group[-1]))
        out = []
        table = table.append_column("group", pa.array(group))
        cuts = [0, *np.flatnonzero(kind[:done]).tolist(), done]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                out.append(compare_rows(table.slice(a, b - a), int(keys[0][a].as_py()), bool(keys[1][a].as_py())))
        return out, table.slice(done).drop_columns(["group"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= 4 * TILE:
            out, rest = tiles(pa.concat_tables(held).combine_chunks(), last=False)
            yield from out
            held, rows = [rest], 0
    if held:
        out, _ = tiles(pa.concat_tables(held).combine_chunks(), last=True)
        yield from out
    release()


def near_words(counts: DataFrame, least_length: int = LEAST_LENGTH, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one."""
    size = F.char_length("word")

    blocks = F.array(
        F.struct(F.lit(False).alias("by_suffix"), F.expr("left(word, m div 2)").alias("block")),
        F.struct(F.lit(True).alias("by_suffix"), F.expr("right(word, m - m div 2)").alias("block")),
    )
    lengths = F.array(size, size - 1)
    dealt = counts.select("word", "n", F.explode(lengths).alias("m")).where(F.col("m") >= least_length)
    dealt = dealt.select("word", "n", "m", F.explode(blocks).alias("b")).select("word", "n", "m", "b.*")
    keys = ["m", "by_suffix", "block"]
    # long words have smaller tiles: a tile's matrices are bounded in code points
    room = F.greatest(F.lit(2), F.least(F.lit(tile), (F.lit(CELLS) / F.col("m")).cast("int")))
    crowded = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).withColumn("tiles", F.ceil(F.col("words") / room).cast("int"))
    dealt = dealt.join(crowded.where("words > 1").select(*keys, "tiles"), keys)
    mine = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select(
        *keys, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "word", "n",
        F.expr("CASE WHEN mine = other THEN 0 WHEN mine < other THEN 1 ELSE 2 END").alias("tile"),
    )
    runs = [*keys, "low", "high"]
    tasks = 4 * counts.count() // TASK_ROWS + 1  # comparing costs far more than its few bytes tell
    found = dealt.repartition(tasks, *runs).sortWithinPartitions(*runs).mapInArrow(compare, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", (-F.col("top.rank")).alias("best_n"), F.col("top.best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last form of each chain.  A chain must
    not return to itself."""
    reached = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return reached


def spelling_variants(docs: DataFrame, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could run in circles")
    counts = stage(count_words(docs, id_col, text_col), "words")
    near = near_words(counts)
    is_form = F.col("best_n") >= ratio * F.col("n")
    named = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    named = stage(named, "forms")
    roots = roots_of(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
