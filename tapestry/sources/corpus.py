"""Incremental extraction from a script corpus (A3): only changed scripts are
extracted again.

A corpus state below one folder holds a manifest ``(path, digest)`` and one
folder of rows for each extractor, all partitioned by a hash bucket of the
path.  An update compares each script's content digest with the manifest
(an anti-join), extracts the new and changed scripts alone, and replaces their
rows and those of removed scripts: buckets without such a script are neither
read nor written.  Rows are staged in the shared checkpoint folder and published
with a dynamic partition overwrite; the manifest comes last, so an update that
fails half-way is done again by the next one.

Scripts with a NULL path take no part; a path that occurs twice is an error; a
NULL text is a script without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.session import written
from tapestry.sources.run_store import stored_table

BUCKET = "path_bucket"
#: As many touched paths may be sent to every task; more are met by a merge join,
#: whose memory does not grow with them.
SENT = 200_000
Extractor = Callable[[DataFrame], DataFrame]


def paths_of(touched: DataFrame) -> DataFrame:
    """The touched paths, as the smaller side of a join."""
    paths = touched.select("path")
    return paths if touched.count() <= SENT else paths.hint("merge")


class Corpus:
    """Extracted rows of a corpus, kept up to date.  ``extractors`` map a name to
    a function of scripts ``(path, text)`` whose rows carry their ``path``."""

    def __init__(self, spark: SparkSession, root: str, extractors: Mapping[str, Extractor], buckets: int = 256):
        self.spark, self.root, self.extractors, self.buckets = spark, root.rstrip("/"), dict(extractors), buckets

    def _bucket(self, path: str | Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _stored(self, name: str) -> DataFrame | None:
        return stored_table(self.spark, f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        """All rows of an extractor, or the ``manifest``."""
        rows = self._stored(name)
        if rows is None:
            raise ValueError(f"the corpus holds no {name!r}: update it first")
        return rows.drop(BUCKET).where("path IS NOT NULL")

    def _replace(self, name: str, touched: DataFrame, new: DataFrame) -> None:
        """Put ``new`` in place of the rows of the ``touched`` paths."""
        old = self._stored(name)
        rows = new
        if old is not None:
            buckets = touched.select(self._bucket("path").alias(BUCKET)).distinct()
            kept = old.join(buckets, BUCKET, "left_semi").drop(BUCKET).join(paths_of(touched), "path", "left_anti")
            rows = kept.unionByName(new)
            # a bucket whose last script has gone is emptied by one row without a path
            gone = buckets.join(rows.select(self._bucket("path").alias(BUCKET)).distinct(), BUCKET, "left_anti")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
            rows = rows.withColumn(BUCKET, self._bucket("path")).unionByName(gone.select(*blank, BUCKET))
        else:
            rows = rows.withColumn(BUCKET, self._bucket("path"))
        staged = written(rows, "corpus")
        staged.repartitionByRange(BUCKET, "path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/{name}")

    def update(self, scripts: DataFrame) -> DataFrame:
        """Bring the state up to ``scripts (path, text)``; returns one row a touched
        script: (path, change) with 'new', 'changed' or 'removed'."""
        now = scripts.where("path IS NOT NULL").select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        if now.groupBy("path").count().where("count > 1").limit(1).count():
            raise ValueError("a path occurs twice in the corpus")
        known = self._stored("manifest")
        if known is None:
            known = now.select("path", "digest").where("false")
        known = known.where("path IS NOT NULL").select("path", F.col("digest").alias("was"))
        diff = now.select("path", "digest").join(known, "path", "full_outer")
        change = F.when(F.col("was").isNull(), "new").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("was"), "changed")
        touched = written(diff.select("path", "digest", change.alias("change")).where("change IS NOT NULL"), "touched")
        if touched.limit(1).count():
            work = written(now.join(paths_of(touched.where("change <> 'removed'")), "path", "left_semi").select("path", "text"), "changed")
            for name, extract in self.extractors.items():
                self._replace(name, touched, extract(work))
            self._replace("manifest", touched, touched.where("digest IS NOT NULL").select("path", "digest"))
        return touched.select("path", "change")
