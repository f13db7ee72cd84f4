"""A training corpus from ``documents``: drop toxic documents, keep one of each
near-duplicate class, drop documents that hold benchmark items, mix to target
weights, and write token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``.  All but the last return the columns of documents.  A stage
sees every row its predecessor kept.  Rows that share a doc_id are one
document: they stay or go together.  Rows with a NULL doc_id have no label, no
class and no match, so they stay; mixing takes each once.  An empty table
passes through every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.llm.common import read, scratch_path
from tapestry.llm.decontam import contaminated
from tapestry.llm.mixing import copies, mix
from tapestry.llm.neardup import near_duplicates
from tapestry.llm.tokens import token_table
from tapestry.llm.toxicity import toxicity

#: Token shares of the mixed corpus by quality label.
TARGETS = {"good": 0.88, "junk": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    bad = toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class."""
    copies_of = near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies_of, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item."""
    leaks = contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of under-represented domains more
    often, by their fitted rates."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")
    labelled = read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    rates = mix(docs, labelled, TARGETS, floor=1.0).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    return copies(docs, rates).unionByName(docs.where("doc_id IS NULL"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files; their documents as read back."""
    return token_table(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_files", write_tokens),
]

#: The stages' classifiers and graph search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
