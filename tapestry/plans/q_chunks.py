"""Registered queries for chunked nesting and the run store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapestry.operators.chunks import nest_chunks, ranked, session_view_chunks
from tapestry.operators.nest import Nest
from tapestry.plans.q_mapping import RESULTS_SQL, SESSIONS_SQL, results, sessions
from tapestry.plans.queries import T, register
from tapestry.session import ensure_checkpoint_dir
from tapestry.sources.run_store import RunStore

SIZE = 500

_CHUNK = "((row_number() OVER (PARTITION BY k ORDER BY {}) - 1) // " + str(SIZE) + ")::INTEGER AS chunk"


def half_hot(spark, d):
    """Lines by a key that holds half of them; every 10th has no key."""
    n = F.col("l_orderkey")
    key = F.when(n % 10 == 0, F.lit(None)).when(n % 2 == 0, F.lit(0)).otherwise(n).cast("long")
    return T(spark, d, "lineitem").select(
        key.alias("k"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("flag"))


@register("nest_chunks", f"""
WITH l AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_orderkey END AS k, l_partkey AS p,
  CASE WHEN l_linenumber > 1 THEN l_returnflag END AS f FROM lineitem),
a AS (SELECT k, chunk, string_agg(p::VARCHAR, ',' ORDER BY p DESC) AS parts, count(*) AS n_parts FROM (SELECT k, p, {_CHUNK.format("p DESC")} FROM l) GROUP BY ALL),
b AS (SELECT k, chunk, string_agg(p::VARCHAR, ',' ORDER BY p) AS distinct_parts FROM (SELECT k, p, {_CHUNK.format("p")} FROM (SELECT DISTINCT k, p FROM l)) GROUP BY ALL),
c AS (SELECT k, 0 AS chunk, array_to_string(list_sort(list(DISTINCT f)), ',') AS flags FROM l GROUP BY k)
SELECT a.k::VARCHAR AS k, a.chunk, md5(a.parts) AS parts, a.n_parts::INTEGER AS n_parts, md5(coalesce(b.distinct_parts, '')) AS distinct_parts, coalesce(c.flags, '') AS flags
FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.chunk = b.chunk LEFT JOIN c ON a.k IS NOT DISTINCT FROM c.k AND a.chunk = c.chunk
""")
def q_nest_chunks(spark, d):
    nests = {"parts": Nest(F.col("part"), "desc"), "distinct_parts": Nest(F.col("part"), "asc", distinct=True), "flags": Nest(F.col("flag"), "asc", distinct=True)}
    out = nest_chunks(half_hot(spark, d), "k", nests, size=SIZE)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(F.col("k").cast("string").alias("k"), "chunk", F.md5(text("parts")).alias("parts"), F.size("parts").alias("n_parts"), F.md5(text("distinct_parts")).alias("distinct_parts"), text("flags").alias("flags"))


@register("rank_in_key", """
SELECT k::VARCHAR AS k, l_orderkey, l_linenumber, part, row_number() OVER (PARTITION BY k ORDER BY part DESC, l_orderkey, l_linenumber) - 1 AS rank FROM (
  SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_orderkey END AS k, l_orderkey, l_linenumber, l_partkey AS part FROM lineitem)
""")
def q_rank_in_key(spark, d):
    lines = half_hot(spark, d).drop("flag")
    out = ranked(lines, ["k"], [F.desc("part"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return out.withColumn("k", F.col("k").cast("string"))


@register("session_view_chunks", "WITH " + SESSIONS_SQL + f"""
SELECT s.session_id, s.status, coalesce(chunk, 0) AS chunk, count(c.turn)::INTEGER AS n_results,
  coalesce(string_agg(c.turn::VARCHAR || '|' || c.role || '|' || md5(c.text), ';' ORDER BY c.turn), '') AS results
FROM ses s LEFT JOIN (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::INTEGER AS chunk FROM conversations) c
  ON c.conv_id = s.session_id GROUP BY ALL
""")
def q_session_view_chunks(spark, d):
    ses, _ = sessions(spark, d)
    res = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.md5("text").alias("text_md5"))
    v = session_view_chunks(ses, res, ["id", "role", "text_md5"], size=3)
    entry = F.array_join(F.transform("results", lambda x: F.concat_ws("|", x["id"].cast("string"), x["role"], x["text_md5"])), ";")
    return v.select("session_id", "status", "chunk", F.size("results").alias("n_results"), entry.alias("results"))


@register("run_store", "WITH " + RESULTS_SQL + """,
u AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'reviewed_' || doc_id::VARCHAR END AS transformation_rule, toxic = 1 AS needs_review FROM labels)
SELECT r.id, r.session_id, (TIMESTAMP '2024-01-01 09:00:00' + to_days((r.session_id % 3)::INTEGER))::VARCHAR AS created_at,
  coalesce(u.transformation_rule, r.transformation_rule) AS transformation_rule, coalesce(u.needs_review, r.needs_review) AS needs_review
FROM res r LEFT JOIN u USING (id)
""")
def q_run_store(spark, d):
    """Two runs, one of them saved twice, then patched, and read back."""
    store = RunStore(spark, ensure_checkpoint_dir(spark).rstrip("/") + f"/store-{uuid.uuid4().hex}")
    day = F.expr("timestamp'2024-01-01 09:00:00' + make_dt_interval(session_id % 3)")
    rows = results(spark, d).select("id", "session_id", day.alias("created_at"), "transformation_rule", "needs_review")
    for part in (rows.where("session_id < 30"), rows.where("session_id >= 30"), rows.where("session_id < 30")):
        store.save(part)
    lab = T(spark, d, "labels")
    reviewed = F.when(F.col("quality") == 1, F.concat(F.lit("reviewed_"), F.col("doc_id").cast("string")))
    store.patch(lab.select(F.col("doc_id").alias("id"), reviewed.alias("transformation_rule"), (F.col("toxic") == 1).alias("needs_review")))
    return store.read().withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@register("run_store_close", "WITH " + SESSIONS_SQL + """
SELECT s.session_id, CASE WHEN s.status = 'processing' AND o.ok THEN 'completed' WHEN s.status = 'processing' AND o.ok IS NOT NULL THEN 'failed' ELSE s.status END AS status,
  CASE WHEN s.status = 'processing' AND o.ok IS NOT NULL THEN '2024-06-01 00:00:00' END AS completed_at
FROM (SELECT *, session_id % 40 AS run FROM ses) s LEFT JOIN outc o USING (session_id)
""")
def q_run_store_close(spark, d):
    """Session headers, forty runs of them, closed by their outcomes."""
    ses, outcomes = sessions(spark, d)
    store = RunStore(spark, ensure_checkpoint_dir(spark).rstrip("/") + f"/store-{uuid.uuid4().hex}", ts_col="started_at", session_col="run", cluster_by="session_id")
    store.save(ses.withColumns({"run": F.col("session_id") % 40, "started_at": F.lit("2024-05-31 08:00:00").cast("timestamp")}))
    store.close(outcomes, now=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return store.read().select("session_id", "status", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))
