"""Chunked nesting of skewed keys and the run store."""

import collections

import pytest
from pyspark.sql import functions as F

from tapestry.operators import chunks as C
from tapestry.operators.nest import Nest, nest_many
from tapestry.sources.run_store import RunStore


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 1 holds half the rows, NULL a fifth; key 7 has NULL values only."""
    n = F.col("id")
    key = F.when(n % 10 < 5, 1).when(n % 10 < 7, F.lit(None)).otherwise(n % 97 + 10).cast("long")
    rows = spark.range(0, 6000).select(key.alias("k"), (n * 7919 % 1000).alias("v"), F.when(n % 3 > 0, n % 11).alias("chunk"))
    odd = spark.createDataFrame([(7, None, None)] * 3 + [(8, 5, None)] * 400, "k long, v long, chunk long")
    return rows.unionByName(odd)


def test_chunks_are_the_lists(spark, skewed):
    nests = {"all": Nest(F.col("v"), "desc"), "some": Nest(F.struct("v", "chunk"), "asc", distinct=True), "few": Nest(F.col("chunk"), "asc", distinct=True)}
    whole = {r.k: r for r in nest_many(skewed, "k", nests).collect()}
    for share in (1e-3, 0.3, 0.9):
        got = collections.defaultdict(list)
        for r in C.nest_chunks(skewed, "k", nests, size=150, share=share).collect():
            got[r.k].append(r)
        assert got.keys() == whole.keys()
        for k, rows in got.items():
            rows.sort(key=lambda r: r.chunk)
            assert [r.chunk for r in rows] == list(range(len(rows)))
            for name in nests:
                assert [x for r in rows for x in r[name]] == whole[k][name]
                assert all(len(r[name]) <= 150 for r in rows)


def test_hot_keys_are_exact(spark, skewed):
    assert {r.k for r in C.hot_keys(skewed, ["k"], 390, share=0.05).collect()} == {1, None, 8}
    assert C.hot_keys(skewed, ["k"], 10_000).count() == 0
    assert C.hot_keys(skewed.where("false"), ["k"], 1).count() == 0


def test_ranks_spread_a_hot_key(spark, skewed):
    ranks = C.ranked(skewed, ["k"], [F.desc("v")])
    got = ranks.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d")).collect()
    assert all((r.a, r.b, r.d) == (0, r.n - 1, r.n) for r in got)
    part = F.floor(F.col("rank") * 4 / 3000)
    assert ranks.where("k = 1").groupBy(part.alias("q")).agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a > b").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # the ranges that a rank task works on hold about as many rows each, though one key has half of them
        dealt = skewed.repartitionByRange(8, F.asc("k"), F.desc("v")).withColumn("p", F.spark_partition_id()).groupBy("p").count()
        sizes = sorted(r["count"] for r in dealt.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_chunks_of_nothing_and_errors(spark, skewed):
    assert C.nest_chunks(skewed.where("false"), "k", {"all": Nest(F.col("v"), "asc")}).count() == 0
    with pytest.raises(ValueError, match="order"):
        C.nest_chunks(skewed, "k", {"all": Nest(F.col("v"), None)})


def test_texts_in_chunks(spark):
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(7)] + [("b", 1, None), (None, 1, "x")], "g string, i int, t string")
    got = sorted((r.g or "", r.chunk, r.rules) for r in C.join_text_chunks(df, "g", "t", "i", size=3, share=0.5).collect())
    assert got == [("", 0, "x"), ("a", 0, "t0; t1; t2"), ("a", 1, "t3; t4; t5"), ("a", 2, "t6"), ("b", 0, "")]


# --- run store -------------------------------------------------------------

SCHEMA = "id long, session_id string, created_at timestamp, transformation_rule string, needs_review boolean, user_notes string"


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def runs(spark, session, day, rules):
    rows = [(100 * day + k, session, f"2024-01-{day:02d} 10:00:00", r, False, None) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def content(df):
    return sorted((r.id, r.session_id or "", r.transformation_rule, r.needs_review, r.user_notes) for r in df.collect())


def test_a_save_twice_is_one_run(spark, store):
    one, two = runs(spark, "007", 1, ["a", "b"]), runs(spark, "x/y=1", 2, ["c"])
    for rows in (one, two, one, one.where("false")):
        store.save(rows)
    assert content(store.read()) == content(one.unionByName(two))
    assert content(store.read("007")) == content(one) and store.read("7").count() == 0
    store.save(runs(spark, "007", 1, ["z"]))  # the run again, with other rows: they take its place
    assert [r[2] for r in content(store.read("007"))] == ["z"]
    store.save(runs(spark, None, 3, ["n"]))
    assert store.read().where("session_id IS NULL").count() == 1


def test_sessions_in_buckets(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "b"), buckets=2)
    rows = [runs(spark, s, 1, [s or "n"]) for s in ("a", "b", "c", "d", None)] + [runs(spark, "a", 2, ["a2"])]
    for r in rows:
        store.save(r)
    store.save(rows[1])
    assert [r[1:3] for r in content(store.read())] == [("", "n"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "a2")]
    assert [r[2] for r in content(store.read("a"))] == ["a", "a2"]
    assert len(list((tmp_path / "b").glob("run_date=*/run_session=*"))) <= 6
    store.patch(spark.createDataFrame([(200, "A2")], "id long, transformation_rule string"))
    assert [r[2] for r in content(store.read())][-1] == "A2"


def files(path):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_patch_rewrites_what_it_touches(spark, store, tmp_path):
    store.save(runs(spark, "a", 1, ["a", "b"]).unionByName(runs(spark, "b", 2, ["c"])))
    before = files(tmp_path / "store")
    updates = spark.createDataFrame([(101, "B", None, "seen"), (999, "none", True, None)], "id long, transformation_rule string, needs_review boolean, user_notes string")
    for _ in range(2):  # a patch again changes nothing
        store.patch(updates)
        assert content(store.read()) == [(100, "a", "a", False, None), (101, "a", "B", False, "seen"), (200, "b", "c", False, None)]
    kept = set(before) & set(files(tmp_path / "store"))
    assert len(kept) == 1  # the file of session b
    with pytest.raises(ValueError, match="twice"):
        store.patch(updates.unionByName(updates))


def test_close(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), ts_col="started_at", cluster_by="session_id")
    rows = spark.createDataFrame([("a", "processing"), ("b", "processing"), ("c", "pending")], "session_id string, status string")
    store.save(rows.withColumns({"started_at": F.lit("2024-01-01").cast("timestamp"), "completed_at": F.lit(None).cast("timestamp")}))
    store.close(spark.createDataFrame([("a", True), ("b", False)], "session_id string, ok boolean"), now=F.lit("2024-01-02").cast("timestamp"))
    got = sorted((r.session_id, r.status, r.completed_at is None) for r in store.read().collect())
    assert got == [("a", "completed", False), ("b", "failed", False), ("c", "pending", True)]
