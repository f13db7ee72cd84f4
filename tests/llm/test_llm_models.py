"""Toxicity, mixing, top-k search and chat formatting."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestry.llm import chat, mixing, topk, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "embeddings", "conversations")}


# --- toxicity -------------------------------------------------------------


def toy(n, seed):
    """Texts of common words; a third are toxic and hold marked words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        bad = i % 3 == 0
        if bad:
            for k in rng.integers(0, 60, 5):
                words[k] = f"nasty{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = toy(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == 900 and 150 < len(right) < 300 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs, tables):
    none = tables["labels"].limit(0)
    rows = toxicity.toxicity(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert toxicity.toxicity(no_docs, none).collect() == []
    some = spark.createDataFrame([(0, 1, 1, "x"), (1, None, 0, "y"), (None, 1, 1, "z"), (6, 1, 0, "u"), (9, 1, 0, "u")], "doc_id long, toxic int, quality int, text string")
    assert len(toxicity.toxicity(odd_docs, some).collect()) == odd_docs.count()


def test_cut_prefers_no_text_when_nothing_parts():
    same = np.zeros(10)
    assert toxicity.cut_of(same, same, 0.1) > 0
    assert -1 < toxicity.cut_of(np.ones(5), np.array([-1.0] * 45 + [1.0] * 5), 0.1) <= 1


# --- mixing ---------------------------------------------------------------


def test_targets_are_met(spark, tables):
    labelled = tables["labels"].select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("junk").alias("domain"))
    for floor, targets in ((0.0, {"good": 0.95, "junk": 0.05}), (1.0, {"good": 0.5, "junk": 0.5})):
        rows = mixing.mix(tables["documents"], labelled, targets, floor=floor).collect()
        total = sum(r["n_tokens"] for r in rows)
        got = [sum(r["n_tokens"] * r["p"][k] * r["rate"] for r in rows) for k in range(2)]
        assert got == pytest.approx([targets["good"] * sum(got), targets["junk"] * sum(got)], rel=1e-4)
        assert min(r["rate"] for r in rows) >= floor and all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
        assert sum(got) == pytest.approx(total, rel=1e-4) if floor == 0 else sum(got) >= total


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((1, 1, 1), 40)
    n = rng.integers(1, 500, 40)
    want = np.array([0.2, 0.3, 0.5])
    groups = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n)], "p array<double>, tokens long")
    steps = mixing.fit_rates(groups, want.tolist())
    r = np.ones(40)
    for s in steps:
        r = np.maximum(0, r - p @ np.array(s))
    assert (n[:, None] * p * r[:, None]).sum(axis=0) / n.sum() == pytest.approx(want, abs=1e-6)
    rated = groups.select(mixing.rate_of(F.col("p"), steps, 0.0).alias("r")).collect()
    assert [x[0] for x in rated] == pytest.approx(r.tolist())


def test_odd_rows_mix(spark, odd_docs, no_docs, tables):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mix(odd_docs, none, {"a": 0.5, "b": 0.5}).collect()
    assert len(rows) == odd_docs.count() and all(r["p"] == [0.5, 0.5] and r["rate"] == pytest.approx(1) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    labelled = spark.createDataFrame([(5, "a"), (None, "b"), (6, None), (7, "c"), (9, "b")], "doc_id long, domain string")
    assert len(mixing.mix(odd_docs, labelled, {"a": 0.5, "b": 0.5}).collect()) == odd_docs.count()
    assert mixing.mix(no_docs, none, {"a": 0.5, "b": 0.5}).collect() == []


def test_copies(spark):
    docs = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0)], "doc_id long, text string, n int")
    rates = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 1.5)], "doc_id long, rate double")
    n = [r["doc_id"] for r in mixing.copies(docs, rates).collect()]
    assert n.count(1) == 2 and n.count(2) == 0 and n.count(3) in (1, 2)


# --- top-k ----------------------------------------------------------------


def brute(rows, k=5):
    v = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        e = [math.floor(256 * float(c)) for c in x]
        v[i] = min(v.get(i, e), e)
    out = set()
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)
        out |= {(q, r, i, -t) for r, (t, i) in enumerate(s[:k], 1)}
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    near = [(i, (rng.normal(size=8) * 0.05 + np.eye(8)[i % 8]).astype(np.float32).tolist()) for i in range(700)]
    flat = [(1000 + i, np.round(rng.normal(size=8), 1).astype(np.float32).tolist()) for i in range(300)]
    same = [(5000 + i, [0.5] * 8) for i in range(120)]
    odd = [(50, None), (9100, [1.0, None]), (9150, [float("nan")] * 8), (9200, [float("inf")] * 8), (9250, []), (9300, [0.1, -0.2]), (None, [1.0] * 8), (0, [2.0] * 8)]
    huge = [(9350, [3.0e6] * 8), (9400, [-2.5e5] * 8)]
    for rows in (near + flat + same, near + odd, near[:40] + huge, odd, odd[:1], []):
        df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, block int, score int")
        rows = [(r[0], r[1]) for r in df.collect()]
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=256, block_queries=7).collect()
        assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_bounds_stop_early():
    rng = np.random.default_rng(8)
    x = np.vstack([np.eye(16, dtype=np.int64)[rng.integers(0, 16, 4000)] * 200 + rng.integers(-3, 4, (4000, 16))])
    ids = np.arange(len(x))
    got = topk.search_block(ids, x, ids[:3], x[:3], 5)
    for j, (i, s) in enumerate(got):
        score = x @ x[j]
        score[j] = -(10**9)
        assert s.tolist() == sorted(score.tolist(), reverse=True)[:5] and (score[i] == s).all()


# --- chat -----------------------------------------------------------------


def test_pieces_give_the_viterbi_path(spark):
    rng = np.random.default_rng(9)
    model = chat.Model(rng.random(3) * 5, rng.random((3, 3)) * 9, rng.random((3, chat.FEATURES)) * 9)
    texts = [rng.choice(["User: hi", "long " * int(rng.integers(1, 200)), "Why?", "### Assistant: ok", ""]) for _ in range(7)]
    emit = model.emit(texts)
    best = max(itertools.product(range(3), repeat=7), key=lambda r: model.start[r[0]] + emit[0, r[0]] + sum(model.step[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(r, r[1:]))))
    df = spark.createDataFrame([(1, t, None, str(x)) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    for piece in (1, 2, 3, 512):
        got = sorted(chat.format_chats(df, model, piece=piece).collect(), key=lambda r: r["turn"])
        assert [r["role"] for r in got] == [chat.ROLES[k] for k in best]


def test_markers_and_rendering(spark, tables):
    assert chat.signs_of("  ### Human: hello?") == ("user", 1) and chat.signs_of("<|system|> > x")[0] == "system"
    assert chat.signs_of("A user: x")[0] is None and chat.signs_of(None) == (None, 0)
    assert chat.render("user", "User:  hi \n") == "<|user|>\nhi\n<|end|>" and chat.render("system", None) == "<|system|>\n\n<|end|>"
    got = chat.format_chats(tables["conversations"]).collect()
    assert len(got) == tables["conversations"].count() and np.mean([r["role"] == r["given_role"] for r in got]) > 0.95


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "?"), (None, 3, "system", "x"), (None, 1, "odd", "Bot: y"), (2, 900, "assistant", "z " * 20000), (2, -5, "user", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece int, at int")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows) and all(r["role"] in chat.ROLES for r in got)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_transcript_in_one_text(spark):
    whole = "\nUser: hi\n- one\nAssistant: hello\n\nAsk on.\n\n  ### Human: why?\r\n> quoted\n[Bot] > so"
    rows = [(1, 0, None, whole), (1, 1, None, "User: thanks"), (2, 0, "user", "a\nb\n\nSystematic: c\n"), (3, 0, None, "User: x\nUser: y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [
        ("user", "hi\n- one"), ("assistant", "hello\n\nAsk on."), ("user", "why?\r\n> quoted"), ("assistant", "so"), ("user", "thanks"),
        ("user", "a\nb\n\nSystematic: c"), ("user", "x"), ("user", "y"),
    ]
    for piece in (1, 2, 512):
        got = sorted(chat.format_chats(df, piece=piece).collect(), key=lambda r: (r["conv_id"], r["at"]))
        assert [(r["role"], r["rendered"]) for r in got] == [(r, f"<|{r}|>\n{t}\n<|end|>") for r, t in want]
        assert [r["at"] for r in got] == [0, 1, 2, 3, 4, 0, 0, 1] and [r["turn"] for r in got] == [0, 0, 0, 0, 1, 0, 0, 0]


def test_steps_inside_a_text_are_counted_apart(spark):
    rows = [(c, t, r, x) for c in range(9) for t, r, x in ((0, "system", "rules\nUser: q\nBot: a"), (1, "user", "more"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.learn(chat.run_rows(df.withColumn("conv", F.col("conv_id"))).cache())
    assert model.line.argmax(axis=1)[:2].tolist() == [1, 2] and model.step.argmax(axis=1)[2] == 1 and model.start.argmax() == 0


def test_text_without_markers_is_one_turn(spark, tables):
    given = tables["conversations"]
    got = chat.format_chats(given).select("conv_id", "turn", "rendered")
    assert given.where("text LIKE '%\n%'").count() > 0
    bare = F.regexp_extract("rendered", r"(?s)^<\|\w+\|>\n(.*)\n<\|end\|>$", 1)
    want = given.select("conv_id", "turn", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    assert want.exceptAll(got.select("conv_id", "turn", bare)).count() == 0 and got.count() == given.count()


def test_sample_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")] * 50 + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    rows, prior = toxicity.sample_rows(docs, labels, F.lit(True), 10, 10)
    got = sorted((r.positive, r.text or "") for r in rows.collect())
    assert [p for p, _ in got] == [False] * 3 + [True] and prior == pytest.approx(2 / 3)
    assert {t for p, t in got if not p} - {"", "c"} == {t for p, t in got if p}
