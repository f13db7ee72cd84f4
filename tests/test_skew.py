"""A key holding a third of all rows: results stay whole and identical
whether or not the hot group is split."""

from pyspark.sql import functions as F

from tapestry.operators.lookup import join_back
from tapestry.operators.nest import Nest, nest_many
from tapestry.operators.reconcile import dedupe_first, last_per_key

N = 30000


def skewed(spark):
    # key 0 holds a third of the rows; the rest are spread over 1000 keys
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        F.col("id"), (F.col("id") % 17).alias("v"))


def test_hot_key_nesting_is_whole(spark):
    df = skewed(spark)
    nests = {"ids": Nest(F.col("id"), "asc"), "vs": Nest(F.col("v"), "asc", distinct=True)}
    plain = {r.k: (r.ids, r.vs) for r in nest_many(df, "k", nests).collect()}
    salted = {r.k: (r.ids, r.vs) for r in nest_many(df, "k", nests, salt_buckets=16).collect()}
    assert plain == salted
    assert len(plain[0][0]) == N // 3 and plain[0][0] == sorted(plain[0][0])
    assert sum(len(ids) for ids, _ in plain.values()) == N  # nothing dropped


def test_hot_key_last_first_and_join_back(spark):
    df = skewed(spark)
    last = {r.k: r.id for r in last_per_key(df, ["k"], "id").collect()}
    first = {r.k: r.id for r in dedupe_first(df, ["k"], "id").collect()}
    assert last[0] == N - 3 and first[0] == 0 and len(last) == 1001
    jb = join_back(df, "k", [F.count(F.lit(1)).alias("n")])
    assert jb.count() == N
    assert jb.filter("k = 0").select(F.min("n"), F.max("n")).first() == (N // 3, N // 3)
