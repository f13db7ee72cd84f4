"""Exact top-k search by no-random-access aggregation of sorted lists.

A block of vectors has one list for each component, sorted by value.  A query
reads all lists at once, from the largest value down where its own component
is positive and from the smallest up where it is negative; it never looks a
vector up.  After ``t`` entries of each list, a vector's score is at least the
sum over the lists it was met in plus the far ends of the others, and at most
the same sum plus the entries just read (nothing further down adds more).  The
k-th best lower bound ends the search for a query once few vectors have an
upper bound that reaches it; those vectors' final scores are then resolved.
If the lists do not separate the vectors, they are read to their ends, where
both bounds are the score: the result is exact either way.

The bounds of all queries of a block are two matrix products a round: a vector
was met in a list if its value is not below the list's last read entry, so the
upper bound is the product with values raised to that entry, and the lower
bound the product with unmet values replaced by the far end.

Queries and vectors are dealt to blocks and each pair of blocks is one task;
a block yields k rows for each query, which are merged by query.

Edge cases: NULL vectors and vectors that hold a NULL, NaN or infinite
component take no part, neither do rows with a NULL id; of rows that share an
id the smallest vector counts; missing components of shorter vectors count as
0; ties go to the smaller id; a query without other vectors has no rows; an
empty table gives no rows; other columns are ignored.  Scores are exact while
they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Parts of the lists' length that are read before each look at the bounds.
DEPTHS = (1 / 16, 1 / 4)


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """Integer vectors as rows, filled with 0 up to ``width``."""
    col = table.column("vec").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = col.flatten().to_numpy()
    return out


def widest(*tables: pa.Table) -> int:
    return max(max((len(v) for v in t.column("vec")), default=0) for t in tables)


def number_type(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which every bound is an exact integer."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best vectors, best first."""
    kind, n = number_type(x, q), len(x)
    x, q = x.astype(kind), q.astype(kind)
    lists = np.sort(x, axis=0)
    own = ids[:, None] == query_ids[None, :]
    lowest = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    out: list = [None] * len(q)

    def resolve(j: int, rows: np.ndarray) -> None:
        score = (x[rows] @ q[j]).astype(np.int64)
        best = np.lexsort((ids[rows], -score))[:k]
        out[j] = (ids[rows][best], score[best])

    open_queries = np.arange(len(q))
    for part in DEPTHS:
        t = int(n * part)
        if t <= k or not len(open_queries):
            continue
        high, low = lists[n - t], lists[t - 1]  # the last entries read from either end
        met_high, met_low = x >= high, x <= low
        most = np.hstack([np.where(met_high, x, high), np.where(met_low, x, low)]) @ signed[open_queries].T
        least = np.hstack([np.where(met_high, x, lists[0]), np.where(met_low, x, lists[-1])]) @ signed[open_queries].T
        mine = own[:, open_queries]
        least[mine] = lowest
        kth = np.partition(least, n - k, axis=0)[n - k]
        reach = (most >= kth) & ~mine
        few = reach.sum(axis=0) <= max(8 * k, n // 64)
        for i in np.flatnonzero(few):
            resolve(open_queries[i], np.flatnonzero(reach[:, i]))
        open_queries = open_queries[~few]
    if len(open_queries):  # the lists' ends: the bounds meet
        score = x @ q[open_queries].T
        mine = own[:, open_queries]
        if kind is np.int64:
            score = np.where(mine, lowest, score)
        else:
            score[mine] = lowest
        at = max(0, n - k - 1)
        kth = np.partition(score, at, axis=0)[at]
        for i, j in enumerate(open_queries):
            resolve(j, np.flatnonzero((score[:, i] >= kth[i]) & ~mine[:, i]))
    return out


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, vec): one row for each id, components floor(scale * x)."""
    bad = F.exists(F.col(vector_col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(F.col(vector_col), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    good = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner
    products among all other rows.  ``is_query`` is a condition on vec_id."""
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    n, m = vectors.agg(F.count(F.lit(1)), F.sum(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-(m or 0) // block_queries))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    there = rows.withColumn("block", deal(blocks)).withColumn("query_block", every(query_blocks))
    asked = rows.where(is_query).withColumn("query_block", deal(query_blocks)).withColumn("block", every(blocks))

    def search(queries: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(queries) and len(others):
            width = widest(queries, others)
            ids, query_ids = (t.column("vec_id").to_numpy() for t in (others, queries))
            best = search_block(ids, matrix(others, width), query_ids, matrix(queries, width), k)
            found = [(np.full(len(i), j), i, s) for j, (i, s) in zip(query_ids, best, strict=True)]
        parts = zip(*found, strict=True) if found else ([np.empty(0, np.int64)],) * 3
        return pa.table({c: np.concatenate(p).astype(np.int64) for c, p in zip(("query_id", "vec_id", "score"), parts, strict=True)})

    keys = ("block", "query_block")
    found = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
