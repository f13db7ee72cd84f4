"""The run store (A10, P1, P2): runs saved once however often a save is retried.

A store is a table partitioned by date and session.  ``save`` replaces exactly
the partitions that its rows fall into, so the same save twice leaves one run,
and other runs stay.  ``patch`` and ``close`` read and rewrite only the
partitions that hold a row to change.

Rows are staged in the shared checkpoint folder first and published from there
with a dynamic partition overwrite: what is published does not change if a task
runs again, and a job that fails before its commit leaves the store as it was.

The date and the session come from the rows: a retried save has to carry the
first one's timestamps.  Without ``buckets`` a session is a folder; with them,
sessions share that many folders a date (for a store of very many sessions), and
a save keeps the other sessions of the folders it rewrites.  Rows of a folder are
spread over files by the clustering key.  A NULL session or timestamp is a run
of its own.  Saving no rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapestry.operators.review import apply_updates, close_session
from tapestry.session import written

DATE, SESSION = "run_date", "run_session"


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class RunStore:
    """Rows of runs below ``path``."""

    def __init__(self, spark: SparkSession, path: str, ts_col: str = "created_at", session_col: str = "session_id", cluster_by: str = "id", buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.ts_col, self.session_col, self.cluster_by = ts_col, session_col, cluster_by

    def _folder(self, session: Column) -> Column:
        session = session.cast("string")
        if self.buckets:
            return F.concat(F.lit("b_"), F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("string"))
        return F.concat(F.lit("s_"), session)  # stays a text in a folder name

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({DATE: F.to_date(self.ts_col), SESSION: self._folder(F.col(self.session_col))})

    def _publish(self, rows: DataFrame) -> None:
        """Put rows (with their place) in place of the folders they fall into."""
        staged = written(rows, "run-store")
        place = [DATE, SESSION, self.cluster_by]
        dealt = staged.repartitionByRange(*place).sortWithinPartitions(*place)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE, SESSION).parquet(self.path)

    @staticmethod
    def _in(rows: DataFrame, of: DataFrame, names: Sequence[str], how: str) -> DataFrame:
        """Rows whose ``names`` do or do not occur in ``of``; NULL equals NULL."""
        keys = of.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]).distinct()
        same = [rows[n].eqNullSafe(keys[f"_k{i}"]) for i, n in enumerate(names)]
        return rows.join(keys, same, how)

    def save(self, rows: DataFrame) -> None:
        """Put the rows' runs in place of what their (date, session) holds."""
        rows = self._placed(rows)
        stored = stored_table(self.spark, self.path) if self.buckets else None
        if stored is not None:
            rows = written(rows, "run-rows")
            others = self._in(self._in(stored, rows, [DATE, SESSION], "left_semi"), rows, [DATE, self.session_col], "left_anti")
            rows = rows.unionByName(others)
        self._publish(rows)

    def read(self, session_id=None) -> DataFrame:
        """All runs, or one session's (only its folders are read)."""
        rows = self.spark.read.parquet(self.path)
        if session_id is not None:
            one = F.lit(session_id)
            rows = rows.where((F.col(SESSION) == self._folder(one)) & (F.col(self.session_col) == one))
        return rows.drop(DATE, SESSION)

    def _rewrite(self, keys: DataFrame, change) -> None:
        """Rewrite the folders that hold one of ``keys`` by ``change``."""
        stored = self.spark.read.parquet(self.path)
        touched = written(stored.join(keys, keys.columns, "left_semi").select(DATE, SESSION).distinct(), "touched")
        self._publish(self._placed(change(self._in(stored, touched, [DATE, SESSION], "left_semi").drop(DATE, SESSION))))

    def patch(self, updates: DataFrame, fields: Sequence[str] = ("transformation_rule", "needs_review", "user_notes"), key: str = "id") -> None:
        """Patch fields by ``updates`` (one row a key; a NULL keeps the old
        value); rows without a match stay as they are."""
        if updates.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"updates hold a {key} twice")
        self._rewrite(updates.select(key), lambda rows: apply_updates(rows, updates, fields, key))

    def close(self, outcomes: DataFrame, now: Column | None = None) -> None:
        """Sessions with an outcome (session_id, ok) become completed or
        failed."""
        self._rewrite(outcomes.select("session_id").distinct(), lambda rows: close_session(rows, outcomes, now))
