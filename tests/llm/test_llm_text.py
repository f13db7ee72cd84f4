"""LM scores, substring dedup, near-duplicates and decontamination against
brute force, on odd rows and on the small given tables."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapestry.llm import backoff, exchange, neardup
from tapestry.llm.components import components
from tapestry.llm.decontam import block_masks, contaminated
from tapestry.llm.neardup import common_counts, least_matches, near_duplicates
from tapestry.llm.substring import COVER, PERIOD, remove_repeats

SF = "/root/testdata/sf0.001"


def words(t, lower=False):
    raw = (t or "").encode()
    return (raw.lower() if lower else raw).split()


@pytest.fixture(scope="session")
def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- exchange -------------------------------------------------------------


def test_packets_round_trip():
    rng = np.random.default_rng(0)
    for keys in (rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2), np.array([5, 5, 6, 2**64 - 1], np.uint64), np.array([7], np.uint64)):
        keys = np.sort(keys)
        assert (exchange.unpack_keys(exchange.pack_keys(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12], np.uint64)
    assert (exchange.unpack_counts(exchange.pack_counts(counts), 6) == counts).all()


# --- LM scores ------------------------------------------------------------


def lm_model(rows, train, order, prior):
    """Plain recursion over n-gram counts."""
    counts, n = collections.Counter(), 0
    for i, t in rows:
        w = [*words(t, True), None]
        if train(i):
            n += len(w)
            for p in range(len(w)):
                for k in range(1, order + 1):
                    if p >= k - 2:
                        counts[tuple(([None, *w[: p + 1]] if p == k - 2 else w[: p + 1])[-k:])] += 1
    size = n + sum(len(g) == 1 for g in counts) + 1

    def prob(history, w):
        if not history:
            return (counts[w,] + 1) / size
        c = counts[history]
        return (counts[(*history, w)] + prior * prob(history[1:], w)) / (c + prior)

    out = []
    for i, t in rows:
        w = [*words(t, True), None]
        base = sum(math.log10((counts[x,] + 1) / size) for x in w)
        score = sum(math.log10(prob(tuple([None, *w[:p]])[-(order - 1) :], w[p])) for p in range(len(w)))
        out.append((i, not train(i), len(w), sum(counts[x,] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_against_recursion(spark, given_docs, odd_docs, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for docs, size in ((odd_docs, 200), (given_docs, 60_000)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = lm_model(rows, lambda i: not held(i), order, 50.0)
        got = backoff.lm_scores(docs, order=order, prior=50.0, block_bytes=size).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
        assert len(got) == len(want)
        for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(((i, None if i is None else h, *rest) for i, h, *rest in want), key=key)):
            assert g[0] == w[0] and g[2:5] == w[2:5] and bool(g[1]) == bool(w[1])
            assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_lm_empty(no_docs):
    assert backoff.lm_scores(no_docs).collect() == []


# --- substring dedup ------------------------------------------------------


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def repeats(rows, n=20):
    first = {}
    for i, w in rows:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, w in rows:
        keep = [True] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (i, p):
                keep[p : p + n] = [False] * n
        out.append((i, len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return out


def test_repeats_against_brute_force(spark, given_docs, odd_docs):
    rng = random.Random(5)
    low = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    tables = [(odd_docs, 300), (given_docs, 50_000), (spark.createDataFrame(low, "doc_id long, text string"), 500)]
    for docs, size in tables:
        rows = [(-1 if r["doc_id"] is None else r["doc_id"], words(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = remove_repeats(docs, block_bytes=size).collect()
        assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[4]) for r in got) == sorted(repeats(rows))
        assert all(sum(e - s for s, e in r[3]) == r[2] for r in got)


def test_repeats_empty(no_docs):
    assert remove_repeats(no_docs).collect() == []


# --- near-duplicates ------------------------------------------------------


def shingles(w):
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def classes(rows, percent):
    sets = [(i, shingles(words(t, True))) for i, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(x), find(i) if x else i, not x or find(i) == i) for i, x in sets)


def family(n, size=60, seed=1):
    """Near copies of one text, each with its own number of changed words, and
    unrelated texts that share a long passage."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    passage = [f"p{k}" for k in range(40)]
    return out + [(n + i, " ".join([*passage, *(f"u{i}_{k}" for k in range(40))])) for i in range(n // 2)]


@pytest.mark.parametrize("percent", [85, 80])
def test_classes_against_all_pairs(spark, given_docs, percent):
    rows = [(r["doc_id"], r["text"]) for r in given_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(given_docs, percent=percent).collect())) == classes(rows, percent)


def test_family_in_cells_and_stars(spark, monkeypatch):
    import tapestry.llm.neardup as n

    monkeypatch.setattr(n, "CELL", 8)
    rows = family(60)
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == classes(rows, 85)


def test_texts_of_one_id_are_linked(spark):
    x, y, z = ("x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6", "z1 z2 z3 z4 z5 z6")
    rows = [(5, x), (5, y), (3, x), (9, y), (9, y), (7, z), (7, None), (7, ""), (None, x)]
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 3, False), (9, 3, False)]


def test_links_grow_with_the_classes(spark):
    """About one family link and at most one star pair a class, in one family of
    400 classes as in 100 families of four."""
    rng = random.Random(9)
    near = lambda base, k: " ".join(w if rng.random() > 0.02 else f"n{k}" for w in base)
    big = [f"b{k}" for k in range(80)]
    small = [[f"s{j} {k}" for k in range(80)] for j in range(100)]
    tables = [[(k, near(big, k)) for k in range(400)], [(k, near(small[k % 100], k)) for k in range(400)]]
    for rows in tables:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sketched = neardup.sketch(docs, "doc_id", "text", "signature").groupBy("class_key").agg(
            F.min("doc_id").alias("cid"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
        classes_ = sketched.count()
        posts = neardup.postings_of(sketched.cache(), least_matches(85)).cache()
        assert neardup.family_links(posts).count() < 1.5 * classes_
        pairs = neardup.star_pairs(posts.withColumn("comp", F.col("cid")), 85, 0)
        assert 0 < pairs.count() <= classes_


def test_a_cell_returns_fewer_links_than_components():
    """Mutually similar components are connected by a forest, not by all their pairs."""
    rng = np.random.default_rng(4)
    groups = [np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(3)]
    sets = [np.sort(np.append(groups[k % 3], rng.integers(0, 1 << 62, 4).astype(np.uint64))) for k in range(90)]
    rows = {"cid": np.arange(90), "comp": np.arange(90), "signature": neardup.signatures(sets).tolist(), "shingles": [s.tobytes() for s in sets]}
    table = pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "signature" else pa.binary() if k == "shingles" else pa.int64()) for k, v in rows.items()})
    links = neardup.compare_cell(table.slice(0, 45), table, 85, least_matches(85))
    assert len(links) == 87  # 90 components in three groups
    root = list(range(90))
    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        assert a % 3 == b % 3
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert root == [k % 3 for k in range(90)]
    same = table.set_column(1, "comp", pa.array([0] * 90, pa.int64()))
    assert len(neardup.compare_cell(same, same, 85, least_matches(85))) == 0


def test_odd_rows_near_duplicates(odd_docs, no_docs):
    got = collections.Counter(tuple(r) for r in near_duplicates(odd_docs).collect())
    by_id = {r[0]: r for r in got if r[0] not in (None, 5)}
    assert by_id[1][2:] == (0, False) and by_id[7][2:] == (6, False) and by_id[9][2:] == (5, False)
    assert by_id[2] == (2, 0, 2, True) and by_id[3] == (3, 0, 3, True) and by_id[4] == (4, 0, 4, True)
    assert sum(got.values()) == odd_docs.count() and all(r[2] is None and r[3] for r in got if r[0] is None)
    assert near_duplicates(no_docs).collect() == []


def test_common_counts_and_matches():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(1, 9_000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert common_counts(sets[:4], sets[4:]).tolist() == want
    assert 24 <= least_matches(80) <= least_matches(85) <= 30


def test_components_of_a_chain_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200, 300: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- decontamination ------------------------------------------------------


def leaks(docs, items):
    out = {}
    for d, t in docs:
        w = words(t, True)
        for i, x in items:
            q = words(x, True)
            n = len(q)
            k = min(5, n)
            if not n or d is None or i is None:
                continue
            c = collections.Counter(tuple(q[j : j + k]) for j in range(n - k + 1))
            for p in range(len(w) - n + 1):
                v = collections.Counter(tuple(w[p + j : p + j + k]) for j in range(n - k + 1))
                low = sum((c & v).values())
                like = low / (2 * (n - k + 1) - low)
                if like >= 0.8 and like > out.get((d, i), (0, 0, 0.0))[2]:
                    out[d, i] = (p, n, like)
    return out


def test_leaks_against_all_windows(spark, given_docs, odd_docs, no_docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = (items[0][1] + " tail").split()
    near[3] = "changed"
    more = [(900 + k, f"front {' '.join(near)} {x}") for k, x in enumerate(("a", "b"))] + [(902, " ".join(items[1][1].split()[:-1]))]
    short = [(500, "quick brown"), (501, ""), (502, None), (503, "one two"), (None, "one two")]
    docs = given_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).union(odd_docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items + short, "item_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    want = leaks([r for r in rows if r[1] is None or len(r[1]) < 20_000], items + short)
    for size in (8 << 20, 2_000):
        got = {(r[0], r[1]): (r[2], r[3], pytest.approx(r[4])) for r in contaminated(docs, bench, pass_bytes=size).collect()}
        assert want == got
    assert contaminated(no_docs, bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_block_masks_cover_all_bits():
    assert sum(int(m) for m in block_masks()) == 2**64 - 1
