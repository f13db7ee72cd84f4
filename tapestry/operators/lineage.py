"""Lineage edges and their transitive closure.

Closures hold each (node, ancestor) pair once, with its shortest distance, and
double the distance they reach in every round, so a walk of any depth takes a
logarithmic number of joins.  Rounds are written to the shared checkpoint
folder; one count a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.operators.scripts import RAW_DICT_NAMES
from tapestry.session import written


def lineage_edges(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",),
                  raw_dicts: Sequence[str] = RAW_DICT_NAMES) -> DataFrame:
    """Edges ``(keys..., target, source)`` from top-level assignments.

    A statement runs from ``name = ...`` at column 0 to the next one.  Its
    sources are: the table of ``.table("t")`` (then nothing else); otherwise
    the base variable of the call chain, and the right side of every
    ``.join(...)`` in it; a subscript ``d[...]`` counts as source ``d[...]``.
    Self-edges and edges from the raw source dictionaries are dropped; edges
    are distinct."""
    stmts = df.select(*keys, F.explode(F.split(F.col(text_col), r"(?m)(?=^\w+[ \t]*=[^=])")).alias("s"))
    s = F.col("s")
    target = F.regexp_extract(s, r"^(\w+)[ \t]*=[^=]", 1)
    table = F.regexp_extract(s, r"^\w+[ \t]*=[ \t]*[\w.]*\.table\(\s*['\"]([^'\"]+)['\"]", 1)
    base = F.regexp_extract(s, r"^\w+[ \t]*=[ \t]*\(?\s*(\w+)\s*\.", 1)
    sub = F.regexp_extract(s, r"^\w+[ \t]*=[ \t]*(\w+)\s*\[", 1)
    rights = F.regexp_extract_all(s, F.lit(r"\.\s*join\(\s*\(?\s*(\w+)"), 1)
    sources = F.when(table != "", F.array(table)).otherwise(
        F.concat(
            F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")),
            F.when(sub != "", F.array(F.concat(sub, F.lit("[...]")))).otherwise(F.array().cast("array<string>")),
            rights,
        )
    )
    edges = stmts.select(*keys, target.alias("target"), F.explode(sources).alias("source")).filter(F.col("target") != "")
    keep = F.col("source") != F.col("target")
    for raw in raw_dicts:
        keep = keep & ~F.col("source").startswith(raw)
    return edges.filter(keep).distinct()


def _pairs(edges: DataFrame, child: str, parent: str, keys: Sequence[str]) -> DataFrame:
    e = edges.select(*keys, F.col(child).alias("node"), F.col(parent).alias("ancestor"))
    return e.where(F.col("node") != F.col("ancestor")).distinct()


def lineage_closure(spark: SparkSession, edges: DataFrame, child: str = "target", parent: str = "source",
                    keys: Sequence[str] = ()) -> DataFrame:
    """All (keys..., node, ancestor, depth) pairs reachable through
    ``edges``, each once, ``depth`` being the shortest distance.  A node is not
    its own ancestor (cycles); edges with a NULL end are dropped.

    A shortest path longer than 2^k splits after 2^k edges, so the pairs of
    distance in (2^k, 2^(k+1)] come from joining the pairs of distance 2^k with
    all pairs known so far."""
    keys = list(keys)
    known = written(_pairs(edges, child, parent, keys).withColumn("depth", F.lit(1)), "closure")
    reach = 1
    while True:
        half = known.where(F.col("depth") == reach).select(*keys, "node", F.col("ancestor").alias("via"))
        rest = known.select(*keys, F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        far = half.join(rest, [*keys, "via"]).where(F.col("node") != F.col("ancestor"))
        far = far.groupBy(*keys, "node", "ancestor").agg(F.min("depth").alias("depth"))
        new = written(far.join(known.select(*keys, "node", "ancestor"), [*keys, "node", "ancestor"], "left_anti"), "closure")
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)
        reach *= 2


def lineage_roots(spark: SparkSession, edges: DataFrame, child: str = "target", parent: str = "source",
                  keys: Sequence[str] = ()) -> DataFrame:
    """The roots (ancestors without a parent) of every node with their shortest
    distance, without the closure in between: walks of exactly 2^k edges are
    doubled by joining them with themselves, and each round joins them with the
    (node, root) pairs found so far."""
    keys = list(keys)
    walks = written(_pairs(edges, child, parent, keys), "walks")
    has_parent = walks.select(*keys, F.col("node").alias("ancestor")).distinct()
    first = walks.join(has_parent, [*keys, "ancestor"], "left_anti")
    known = written(first.select(*keys, "node", F.col("ancestor").alias("root"), F.lit(1).alias("depth")), "roots")
    reach = 1
    while True:
        step = walks.select(*keys, "node", F.col("ancestor").alias("via"))
        on = known.select(*keys, F.col("node").alias("via"), "root", (F.col("depth") + reach).alias("depth"))
        far = step.join(on, [*keys, "via"]).groupBy(*keys, "node", "root").agg(F.min("depth").alias("depth"))
        new = written(far.join(known.select(*keys, "node", "root"), [*keys, "node", "root"], "left_anti"), "roots")
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)
        walks = written(step.join(walks.select(*keys, F.col("node").alias("via"), "ancestor"), [*keys, "via"])
                        .select(*keys, "node", "ancestor").distinct(), "walks")
        reach *= 2
