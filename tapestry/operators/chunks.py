"""Nested lists and joined texts in numbered chunks, whatever a key's size (E1-E7,
E14, E15, P3).

A list of all values of a hot key is one row and one task by definition, so
here a key's ordered list comes out as rows ``(keys..., chunk, list)`` of at
most ``size`` values: chunk after chunk, they are the list.

1. A frequent-items sketch (``1 / share`` counters, one pass) names every key
   that may hold more than ``share`` of the rows; exact counts of those few
   keys drop the false ones.
2. Keys that the sketch did not name have at most ``share`` of the rows: they
   are nested in one phase and cut into chunks after it.
3. Hot keys are ranked without gathering them: rows are dealt to ranges of
   (key, value), ranked inside a range, and a running total of the ranges'
   counts (one row a range of a key) gives the rank in the whole key.  Rank
   divided by ``size`` is the chunk, and chunks are collected each by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestry.operators.nest import Nest
from tapestry.session import written

SIZE = 10_000
SHARE = 1e-3


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equality of columns, NULL being equal to NULL."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def hot_keys(df: DataFrame, keys: Sequence[str], more_than: int, share: float = SHARE) -> DataFrame:
    """The keys that hold more than ``share`` of the rows and more than
    ``more_than`` rows; at most ``1 / share`` rows."""
    keys = list(keys)
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_h"))
    named = hashed.stat.freqItems(["_h"], share).first()[0] or []
    if not named:
        return df.select(*keys).where("false")
    counted = hashed.where(F.col("_h").isin(list(named))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return written(counted.where(F.col("_n") > more_than).select(*keys), "hot-keys")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row within its key; no task holds a
    key, equal rows are told apart by their place in a written table."""
    keys = list(keys)
    rows = written(df.withColumn("_tie", F.monotonically_increasing_id()), "rank-rows")
    dealt = rows.repartitionByRange(*[F.col(k).asc() for k in keys], *order, F.col("_tie").asc())
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "rank-ranges")
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_tie")
    local = dealt.withColumn("_n", F.row_number().over(inside) - 1)
    counts = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    before = before.toDF("_part", *[f"_k{i}" for i in range(len(keys))], "_before")
    same = reduce(lambda x, y: x & y, [local[k].eqNullSafe(before[f"_k{i}"]) for i, k in enumerate(keys)], local["_part"] == before["_part"])
    return local.join(before, same).select(*df.columns, (F.col("_before") + F.col("_n")).alias(name))


def nest_chunks(df: DataFrame, keys: str | Sequence[str], nests: Mapping[str, Nest], size: int = SIZE, share: float = SHARE) -> DataFrame:
    """E1-E5 in chunks: ``(keys..., chunk, nested columns...)``; the k-th row of a
    key holds the k-th ``size`` values of each list (an empty list where a list
    has ended).  Lists are those of ``nest_many``; each needs an order.  A NULL
    key is a key; a key whose values are all NULL has one chunk of empty lists;
    an empty table gives no rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if any(n.order is None for n in nests.values()):
        raise ValueError("chunks are cut from ordered lists: give every Nest an order")
    values = {f"_v{i}": n for i, n in enumerate(nests.values())}
    rows = df.select(*keys, *[n.value.alias(v) for v, n in values.items()])
    hot = hot_keys(rows, keys, size, share)

    cold = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left_anti")  # at most 1 / share rows
    lists = [Nest(F.col(v), n.order, n.distinct).one_phase().alias(v) for v, n in values.items()]
    cold = cold.groupBy(*keys).agg(*lists)
    longest = F.greatest(F.lit(1), *[F.size(v) for v in values])
    cold = cold.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(longest / size).cast("int") - 1)))
    cut = [F.slice(F.col(v), F.col("chunk") * size + 1, F.lit(size)).alias(name) for v, name in zip(values, nests, strict=True)]
    out = cold.select(*keys, "chunk", *cut)

    hot_rows = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left_semi")
    parts = [hot.select(*keys, F.lit(0).alias("chunk"))]
    for (v, n), name in zip(values.items(), nests, strict=True):
        mine = hot_rows.select(*keys, v).where(F.col(v).isNotNull())
        mine = mine.distinct() if n.distinct else mine
        order = F.col(v).asc() if n.order == "asc" else F.col(v).desc()
        chunk = F.floor(F.col("rank") / size).cast("int")
        cut_rows = ranked(mine, keys, [order]).groupBy(*keys, chunk.alias("chunk"))
        parts.append(cut_rows.agg(F.sort_array(F.collect_list(v), asc=n.order == "asc").alias(name)))
    chunks = parts[0]
    at = [*keys, "chunk"]
    for k, (p, name) in enumerate(zip(parts[1:], nests, strict=True)):
        p = p.toDF(*[f"_{c}" for c in at], name)
        same = reduce(lambda x, y: x & y, [chunks[c].eqNullSafe(p[f"_{c}"]) for c in at])
        chunks = chunks.join(p, same, "full_outer")
        key = lambda c: F.when(F.col("_chunk").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        chunks = chunks.select(*[key(c) for c in at], *list(nests)[: k + 1])
    empty = [F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in nests]
    return out.unionByName(chunks.select(*keys, "chunk", *empty))


def join_text_chunks(df: DataFrame, keys: str | Sequence[str], text: str, order: str, sep: str = "; ", out: str = "rules",
                     size: int = SIZE, share: float = SHARE) -> DataFrame:
    """E14 in chunks: texts of each key joined by ``sep`` in ``order``, at most
    ``size`` of them a row; a NULL text is left out of its chunk."""
    pair = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    keys = [keys] if isinstance(keys, str) else list(keys)
    lists = nest_chunks(df, keys, {"_l": Nest(pair, "asc")}, size, share)
    return lists.select(*keys, "chunk", F.array_join(F.transform("_l", lambda x: x["t"]), sep).alias(out))


def sources_of_chunks(df: DataFrame, key: str = "target_field", column: str = "source_column", table: str = "source_table", sep: str = ", ",
                      size: int = SIZE, share: float = SHARE) -> DataFrame:
    """E15/G3 in chunks: distinct sorted source columns and tables per key."""
    nests = {"source_columns": Nest(F.col(column), "asc", distinct=True), "source_tables": Nest(F.col(table), "asc", distinct=True)}
    lists = nest_chunks(df, key, nests, size, share)
    return lists.select(key, "chunk", *[F.array_join(n, sep).alias(n) for n in nests])


def session_view_chunks(sessions: DataFrame, results: DataFrame, result_fields: Sequence[str], order: str = "id", size: int = SIZE, share: float = SHARE) -> DataFrame:
    """P3 in chunks: each session header with its results ordered by ``order``,
    ``size`` a row; a session without results has one row with none."""
    entry = F.struct(F.col(order), *[F.col(f) for f in result_fields if f != order])
    nested = nest_chunks(results, "session_id", {"results": Nest(entry, "asc")}, size, share)
    view = sessions.join(nested, "session_id", "left")
    return view.withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "results": F.coalesce("results", F.array().cast(nested.schema["results"].dataType))})
