"""Near-duplicate classes by a signature-coordinate inverted join.

A document is the set of its distinct 5-word shingles (its whole word sequence
if it has fewer words).  Documents are linked if 100 * intersection >=
``percent`` * union of their sets; classes are the connected components.

1. Documents with equal sets form one class at once, so a group of copies of
   any size is one row from here on.
2. A class's MinHash signature has ``COORDS`` coordinates; it is posted under
   each coordinate-value pair.  Values that only one class has cannot collide.
   A pair of classes is a candidate if enough coordinates collide:
   ``least_matches`` sets the number so that a pair at the very threshold falls
   short of it with a chance below 1e-6 (28 of 48 at 0.85).
3. Prefix merging: with at least m common postings, two classes share one of
   the first ``postings - m + 1`` of each, rarest first.  Only those lists are
   used, so the long lists (common passages) are mostly skipped.  Classes that
   such lists connect form a family; candidates lie within one family.
4. Rounds of stars come first: each list names one member its pivot, and each
   class is compared with one of its lists' pivots, so a round compares at most
   one pair a class, whatever the sizes of families.
5. Completion: within each family, the classes outside its largest component
   are compared with all classes of other components, in cells of CELL by CELL
   classes.  A cell counts the signatures' collisions, confirms candidates on
   the full sets and returns links only, of its components' links a spanning
   forest.  After that every candidate pair has been compared or lies within one
   component, so no link between components is missed.

No pair of documents becomes a row unless one of the two is a pivot or the
pair is a link; a class's set is sent to the cells of its family only.

Edge cases: NULL or empty texts, or texts without words, have an empty set and
are linked with nothing; rows with a NULL id take no part (component_id NULL,
kept true); rows that share an id are one document: all their texts' classes
are linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapestry.llm.common import mix64, release, stage, words_of
from tapestry.llm.components import components
from tapestry.llm.substring import BASES, rolling

SHINGLE = 5
COORDS = 48
PERCENT = 85
ROUNDS = 3
CELL = 256
SLICE = 256
COLUMNS = 8192


def least_matches(percent: int, miss: float = 1e-6) -> int:
    """The most collisions to ask for, so that a pair of similarity percent/100
    has fewer with a chance of at most ``miss``."""
    p, below, m = percent / 100, 0.0, 0
    while True:
        below += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if below > miss:
            return m
        m += 1


def permutations(n: int = COORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of the MinHash functions."""
    seed = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seed[:n] | np.uint64(1), seed[n:]


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    of = [words_of(t, lower=True) for t in texts]
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    number = np.fromiter(map(seen.__getitem__, chain.from_iterable(of)), np.int64, sum(map(len, of)))
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[number]
    windows, out, at = rolling(keys, shingle, BASES[0]), [], 0
    for w in of:
        n, end = len(w), at + len(w)
        if n >= shingle:
            out.append(np.unique(windows[at : end - shingle + 1]))
        elif n:
            out.append(mix64(rolling(keys[at:end], n, BASES[1]) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinate-value pairs of non-empty sets, one row a set: the coordinate
    above 32 bits of its smallest hash."""
    mul, add = permutations()
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(int)
    out = np.empty((len(sets), COORDS), np.int64)
    for k in range(COORDS):
        low = np.minimum.reduceat((flat * mul[k] + add[k]) >> np.uint64(32), starts)
        out[:, k] = low.astype(np.int64) | (k << 32)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, what: str) -> DataFrame:
    """Per row: doc_id, n_shingles, class_key (a 128-bit digest of the set, NULL
    if empty) and, as ``what`` says, the signature or the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                sets = shingle_sets(part.column("text").to_pylist())
                some = [s for s in sets if len(s)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if what == "signature":
                    rows = iter(signatures(some).tolist() if some else ())
                    extra = pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64()))
                else:
                    extra = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), extra],
                    names=["doc_id", "n_shingles", "class_key", what],
                )
        release()

    kind = {"signature": "array<bigint>", "shingles": "binary"}[what]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_shingles long, class_key binary, {what} {kind}")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class numbers whose signatures collide often enough
    and whose full sets are similar enough."""
    least = least_matches(percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sig_a, sig_b, set_a, set_b = (batch.column(c) for c in ("a", "b", "sig_a", "sig_b", "set_a", "set_b"))
            same = (sig_a.flatten().to_numpy() == sig_b.flatten().to_numpy()).reshape(-1, COORDS).sum(axis=1)
            ok = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(same >= least):
                x, y = (np.frombuffer(s[int(i)].as_buffer(), "<u8") for s in (set_a, set_b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
        release()

    left = sets.select(F.col("cid").alias("a"), F.col("signature").alias("sig_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("signature").alias("sig_b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b")
    return both.mapInArrow(check, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as matrix products over
    slices of the shingles that at least two sets hold."""
    sizes = [len(s) for s in (*left, *right)]
    _, column, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(held > 1) - 1
    row, keep = np.repeat(np.arange(len(sizes)), sizes), held[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sizes), COLUMNS), np.float32)
        grid[row[i:j], column[i:j] - at] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Which of the sorted pairs of components join two that the pairs before do
    not: a spanning forest, of fewer pairs than components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    keep = np.zeros(len(pairs), bool)
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = find(x), find(y)
        if x != y:
            keep[k], root[max(x, y)] = True, min(x, y)
    return keep


def compare_cell(left: pa.Table, right: pa.Table, percent: int, least: int) -> pa.Table:
    """Links between the left and right classes of different components that
    connect all components which any pair of them joins, without a link between
    two that others connect already: fewer links than components."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return none
    sig_a, sig_b = (t.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDS) for t in (left, right))
    comp_a, comp_b, id_a, id_b = (t.column(c).to_numpy() for c in ("comp", "cid") for t in (left, right))
    collide = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for k in range(COORDS):
        collide += sig_a[:, k][:, None] == sig_b[:, k][None, :]
    candidate = (collide >= least) & (comp_a[:, None] != comp_b[None, :])
    if not candidate.any():
        return none
    rows, cols = np.flatnonzero(candidate.any(axis=1)), np.flatnonzero(candidate.any(axis=0))
    sets_a, sets_b = ([np.frombuffer(t.column("shingles")[int(i)].as_buffer(), "<u8") for i in at] for t, at in ((left, rows), (right, cols)))
    common = common_counts(sets_a, sets_b)
    union = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & candidate[np.ix_(rows, cols)])
    i, j = rows[i], cols[j]
    ends = np.sort(np.stack([comp_a[i], comp_b[j]], axis=1), axis=1)
    pairs, first = np.unique(ends, axis=0, return_index=True)
    first = first[spanning(pairs)]
    return pa.table({"a": id_a[i[first]], "b": id_b[j[first]]})


def postings_of(classes: DataFrame, least: int) -> DataFrame:
    """(cid, n_shingles, pair): the prefix postings of each class that shares
    enough coordinate values with others."""
    posts = classes.select("cid", "n_shingles", F.explode("signature").alias("pair"))
    shared = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = posts.join(shared, "pair").groupBy("cid", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("posts"))
    prefix = F.slice("posts", 1, F.size("posts") - least + 1)
    return listed.where(F.size("posts") >= least).select("cid", "n_shingles", F.explode(prefix).alias("p")).select("cid", "n_shingles", F.col("p.pair").alias("pair"))


def family_links(posts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes of each list and of lists that share
    a class: each class with the smallest of its lists' least members, and that
    member with the other lists' least ones, about one link a class."""
    lists = posts.groupBy("pair").agg(F.min("cid").alias("low"))
    seen = posts.join(lists, "pair").groupBy("cid").agg(F.min("low").alias("b"), F.collect_set("low").alias("lows"))
    ends = F.explode(F.concat(F.array("cid"), "lows"))
    return seen.select(ends.alias("a"), "b").where("a <> b").distinct()


def star_pairs(now: DataFrame, percent: int, round_: int) -> DataFrame:
    """(a, b), a < b: each class with the lowest-ranked pivot of its lists that
    lies in another component and is of a size that allows a link."""
    rank = F.xxhash64("cid", F.lit(round_))
    pivot = F.min(F.struct(rank.alias("rank"), F.col("cid").alias("b"), F.col("comp").alias("comp_b"), F.col("n_shingles").alias("n_b"))).alias("p")
    pivots = now.groupBy("pair").agg(pivot, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("pair", "p.*")
    star = now.join(pivots, "pair").where(F.expr("comp <> comp_b") & alike("n_shingles", "n_b", percent))
    one = star.groupBy("cid").agg(F.min(F.struct("rank", "b")).alias("p"))
    return one.select(F.least("cid", "p.b").alias("a"), F.greatest("cid", "p.b").alias("b")).distinct()


def id_links(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id but not a text."""
    rows = sketched.where("class_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "class_key")
    several = rows.groupBy("doc_id").agg(F.min("class_key").alias("x"), F.max("class_key").alias("y")).where("x <> y").select("doc_id", "x")
    pairs = rows.join(several, "doc_id").where("class_key <> x").select("class_key", "x").distinct()
    number = lambda key, name: classes.select(F.col("class_key").alias(key), F.col("cid").alias(name))
    return pairs.join(number("class_key", "a"), "class_key").join(number("x", "b"), "x").select("a", "b")


def alike(a: str, b: str, percent: int):
    """Set sizes that allow the similarity at all."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def complete(sizes: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a family, cell by cell."""
    least = least_matches(percent)
    now = sizes.join(comps, "cid")
    parts = now.groupBy("family", "size", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("family", "size")
    parts = parts.agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    main = parts.select(
        "family", F.col("m.comp").alias("main"),
        F.ceil((F.col("size") - F.col("m.n")) / CELL).cast("int").alias("rows"), F.ceil(F.col("size") / CELL).cast("int").alias("columns"),
    )
    told = now.select("cid", "family", "comp").join(main, "family").join(sets, "cid")
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ("family", "row", "column", "cid", "comp", "signature", "shingles")
    left = told.where("comp <> main").withColumn("row", deal("rows")).withColumn("column", every("columns")).select(*fields)
    right = told.withColumn("column", deal("columns")).withColumn("row", every("rows")).select(*fields).toDF(*[f"{c}_" for c in fields])
    keys = ("family", "row", "column")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        links = compare_cell(a, b.rename_columns(list(fields)), percent, least)
        release()
        return links

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_" for k in keys])).applyInArrow(compare, "a long, b long")


def merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (cid, comp) after adding the links (a, b) of classes."""
    comp = lambda c: comps.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = links.join(comp("a"), "a").join(comp("b"), "b").where("comp_a <> comp_b")
    labels = components(between.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    joined = comps.join(labels.select(F.col("id").alias("comp"), "label"), "comp", "left")
    return stage(joined.select("cid", F.coalesce("label", "comp").alias("comp")), "comps")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable) and kept (doc_id = component_id)."""
    sketched = stage(sketch(docs, id_col, text_col, "signature"), "sketch")
    # copies become one class; its number is fixed by writing it
    classes = (
        sketched.where("class_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("class_key")
        .agg(F.min("doc_id").alias("first_doc"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    )
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    posts = stage(postings_of(classes, least_matches(percent)), "postings")
    members = posts.select("cid").distinct()
    reps = classes.join(members, "cid").select("cid", "signature", "class_key", F.col("first_doc").alias("doc_id"))
    source = docs.join(reps.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")
    full = sketch(source, id_col, text_col, "shingles").select("doc_id", "class_key", "shingles")
    sets = stage(reps.join(full, ["doc_id", "class_key"]).select("cid", "signature", "shingles").dropDuplicates(["cid"]), "sets")

    comps = stage(members.select("cid", F.col("cid").alias("comp")), "comps")
    families = components(family_links(posts))
    families = families.select(F.col("id").alias("cid"), F.col("label").alias("family"))
    sizes = stage(families.join(families.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "family"), "families")
    listed = stage(posts.join(sizes.select("cid"), "cid"), "listed")
    for r in range(rounds):
        now = stage(listed.join(comps, "cid"), "now")  # read twice
        comps = merge(comps, stage(confirm(star_pairs(now, percent, r), sets, percent), "links"))
    comps = merge(comps, stage(complete(sizes, comps, sets, percent), "links"))

    same_id = stage(id_links(sketched, classes), "id-links")
    if same_id.limit(1).count():
        ends = same_id.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        comps = comps.unionByName(ends.join(comps, "cid", "left_anti").select("cid", F.col("cid").alias("comp")))
        comps = merge(comps, same_id)

    named = classes.select("cid", "class_key", "first_doc").join(comps, "cid", "left")
    # the smallest document of a component, from the few classes that were compared
    first = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first_doc").alias("lowest"))
    named = named.join(first, "comp", "left").select("class_key", F.coalesce("lowest", "first_doc").alias("of_class"))
    out = sketched.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
