"""Spelling variants, sharding and the prefix trie against brute force, on odd
rows and on the small given tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tapestry.llm import sharding, trie, variants

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


# --- spelling variants ---------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(rows, ratio=10):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if one_edit(w, x)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * c else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n.get(form[w], -1)) for w, c in n.items())


def found_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def spelled_docs(spark):
    """A chain of forms (1000 : 100 : 10), ties, accents, insertions at both
    ends, repeated letters, and a very long word."""
    rng = random.Random(3)
    words = ["abcdefgh"] * 1200 + ["abcdefgx"] * 100 + ["abcdefyx"] * 9 + ["aaaaaaaa"] * 60 + ["aaaaaaa"] * 5 + ["aaaaaaaab"] * 4
    words += ["Zabcdefgh"] * 3 + ["éabcdefg"] * 40 + ["èabcdefg"] * 40 + ["êabcdefg"] * 4 + ["x" * 5000] * 30 + ["x" * 4999] * 2 + ["shorter"] * 3 + ["short"] * 50
    words += [w for k in range(40) for w in ["conform" + chr(97 + k % 26) + "ation" + "s" * (k % 3)] * (2 + k % 4)]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(len(words) // 20 + 1)]
    rows += [(None, "abcdefgh abcdefgh-abcdefgx"), (7, None), (7, ""), (8, "shorter"), (8, "shorter")]
    return rows, spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")


def test_variants_brute_force(spark):
    rows, docs = spelled_docs(spark)
    assert found_variants(variants.spelling_variants(docs)) == brute_variants(rows)


def test_variants_of_tiles(spark):
    rows, docs = spelled_docs(spark)
    counts = variants.count_words(docs, "doc_id", "text")
    whole = sorted(map(tuple, variants.near_words(counts).collect()))
    assert whole and whole == sorted(map(tuple, variants.near_words(counts, tile=3).collect()))


def test_variants_given(given):
    docs = given("documents")
    want = brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert found_variants(variants.spelling_variants(docs)) == want


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found_variants(variants.spelling_variants(odd_docs)) == brute_variants(rows)
    assert variants.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        variants.spelling_variants(no_docs, ratio=1)


# --- sharding ------------------------------------------------------------------


def probe_of(sizes):
    ends = np.cumsum(sizes)

    def probe(stretches, bins):
        out = []
        for a, b in stretches:
            inside = ends[(ends > a) & (ends < b)]
            which = (inside - a) // -(-(b - a) // bins)
            out += [(g.min(), g.max(), len(g)) for g in (inside[which == w] for w in np.unique(which))]
        return tuple(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))

    return probe


def least_capacity(sizes, shards):
    def parts(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if parts(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_minimax_search(bins):
    rng = np.random.default_rng(bins)
    for trial in range(60):
        n = int(rng.integers(1, 400))
        sizes = rng.integers(1, [3, 50, 10_000][trial % 3], n)
        if trial % 4 == 0:
            sizes[rng.integers(0, n)] *= 300
        shards = int(rng.integers(1, 20))
        capacity, cuts = sharding.minimax_cuts(int(sizes.sum()), int(sizes.max()), shards, probe_of(sizes), bins)
        assert capacity == least_capacity(sizes.tolist(), shards)
        assert set(cuts) <= {0, *np.cumsum(sizes).tolist()} and cuts[-1] == sizes.sum()
        assert max(np.diff([0, *cuts])) <= capacity


def check_shards(rows, shards=16):
    """Sizes, crc, gapless slots, atomic groups; returns bytes by shard."""
    by_text, by_shard, total = {}, collections.defaultdict(list), collections.Counter()
    for r, text in rows:
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert by_text.setdefault(text or "", r.shard) == r.shard
        by_shard[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    return total


def test_shards_given(given):
    docs = given("documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    total = check_shards([(r, text[r.doc_id]) for r in sharding.shard_table(docs).collect()])
    groups = collections.Counter()
    for t in text.values():
        groups[t] += len((t or "").encode()) + 1
    # the smallest possible maximum, within one group
    assert max(total.values()) <= max(max(groups.values()), sum(groups.values()) / 16 + max(groups.values()))


def test_shards_are_minimax(spark):
    rng = random.Random(5)
    texts = [f"{k} " + "w" * rng.randrange(400) for k in range(500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    total = check_shards([(r, texts[r.doc_id]) for r in sharding.shard_table(docs).collect()])
    order = sorted(texts, key=lambda t: hashlib.md5(t.encode()).digest())
    assert max(total.values()) == least_capacity([len(t) + 1 for t in order], 16)


def test_shards_with_a_hot_group(spark):
    rng = random.Random(4)
    texts = ["hot " * 50] * 3000 + [f"text {k} " + "x" * rng.randrange(300) for k in range(4000)]
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, shard int, key string")
    total = check_shards([(r, texts[r.doc_id]) for r in sharding.shard_table(docs).collect()])
    hot = max(total.values())
    rest = [b for b in total.values() if b != hot]
    assert hot == 3000 * 201 and len(rest) == 15 and max(rest) < 1.05 * min(rest)


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sharding.shard_table(odd_docs).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(no_docs).count() == 0


def test_equal_rows_beyond_a_chunk(spark):
    docs = spark.range(10_000).selectExpr("1L AS doc_id", "'same' AS text").unionAll(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    got = sharding.shard_table(docs).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sorted((r["max(slot)"], r["count(1)"]) for r in got) == [(0, 1), (9999, 10_000)]


def test_written_shards(spark, given, tmp_path):
    docs = given("documents")
    plan = sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert plan.shards == 16 and back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    table = sharding.shard_table(docs).select("doc_id", "shard")
    assert back.select("doc_id", "shard").exceptAll(table).count() == 0
    with pytest.raises(ValueError, match="shard_col"):
        sharding.write_shards(docs, str(tmp_path / "no"), shard_col="text")


# --- prefix trie ---------------------------------------------------------------


def turn_digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.md5(str(len(role)).encode() + b":" + role + text).hexdigest()


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    ends = collections.defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def found_trie(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed=1, n=400):
    """Conversations that share openings, whole copies, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 8, 12])):
            hot = t < 3 and rng.random() < 0.7
            rows.append((c, t, rng.choice(["user", None]) if not hot else "user", "hello" if hot else rng.choice(["a", "bb", "été", "", None])))
    rows += [(5, None, "system", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 0, "user", "lost"), (10**12 + 5, 0, None, None)]
    return rows


def test_trie_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int")
    got = trie.conversation_trie(df)
    assert got.columns == COLUMNS
    assert found_trie(got) == brute_trie(rows)


@pytest.mark.parametrize("turns", [1, 7, 50])
def test_trie_of_small_shards(spark, turns, monkeypatch):
    rows = talks(turns, 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(trie, "FAN", 2)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # several ranges, so several levels of summaries
    try:
        got = found_trie(trie.conversation_trie(df, shard_turns=turns))
    finally:
        spark.conf.set(setting, "true")
    assert got == brute_trie(rows)


def test_trie_given(given):
    df = given("conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert found_trie(trie.conversation_trie(df)) == brute_trie(rows)


def test_trie_of_nothing_and_of_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, t, "user", "same" if t < 700 else f"{c} {t}") for c in (1, 2, 3) for t in range(900)]
    assert found_trie(trie.conversation_trie(spark.createDataFrame(rows, schema))) == brute_trie(rows)


def test_double_array_children():
    rng = np.random.default_rng(2)
    paths = sorted({bytes(rng.integers(0, 9, 16 * int(rng.integers(1, 5)), np.uint8) // 8 * 16) for _ in range(300)})
    length = np.array([len(p) // 16 for p in paths])
    batch, summary = trie.shard_nodes(paths, np.ones(int(length.sum()), np.int64), np.ones(len(paths), np.int64), np.arange(len(paths)), [b"e" * 32] * len(paths))
    prefixes = {p[: 16 * d] for p in paths for d in range(len(p) // 16 + 1)}
    open_ = {p[: 16 * d] for p in (paths[0], paths[-1]) for d in range(len(p) // 16 + 1)}
    assert batch.num_rows == len(prefixes) - len(open_)
    again = trie.Summary.load(summary.dump())
    assert [[(n.turn, n.numbers, n.ends) for n in p] for p in again.paths] == [[(n.turn, n.numbers, n.ends) for n in p] for p in summary.paths]
    with pytest.raises(ValueError, match="no such path"):
        d = trie.DoubleArray(2, 4)
        d.add_level(np.array([0]), np.array([1]))
        d.step(np.array([0]), np.array([0]))
