"""The text operators bound to the given tables: one query each, with DuckDB
SQL where SQL can express it (the others are held against brute force in
``tests/llm``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tapestry.llm.backoff import lm_scores
from tapestry.llm.chat import format_chats
from tapestry.llm.common import read
from tapestry.llm.decontam import contaminated
from tapestry.llm.licenses import license_scan
from tapestry.llm.mixing import mix
from tapestry.llm.neardup import near_duplicates
from tapestry.llm.sharding import shard_table
from tapestry.llm.substring import substring_digest
from tapestry.llm.tokens import token_table
from tapestry.llm.toxicity import toxicity
from tapestry.llm.topk import SQL as TOP_K_SQL
from tapestry.llm.topk import top_k
from tapestry.llm.trie import conversation_trie
from tapestry.llm.variants import spelling_variants


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, junk (quality 0) or good (quality 1)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"good": 0.92, "junk": 0.06, "toxic": 0.02}
    mixed = mix(read(spark, sf_dir, "documents"), label_domains(read(spark, sf_dir, "labels")), targets)
    return mixed.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(targets)], "rate")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mix": op2_mix,
        "op3_top_k": op3_top_k,
        "op4_chat_format": op4_chat_format,
        "op5_lm_scores": op5_lm_scores,
        "op6_license_scan": op6_license_scan,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_token_files": op8_token_files,
        "op9_decontaminate": op9_decontaminate,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_shards": op12_shards,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": TOP_K_SQL}
