"""Helpers shared by the text operators: words, scratch tables, text blocks."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestry.session import ensure_checkpoint_dir

#: Characters that part words.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other letters)."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; NULL has none.

    ``bytes.lower`` and ``bytes.split`` only know ASCII, which is what is wanted.
    """
    if text is None:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if lower else raw).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tapestry-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (cuts the lineage;
    survives lost executors, unlike a local checkpoint)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(docs: DataFrame, key: str, text: str, block_bytes: int, *extra: Column) -> tuple[DataFrame, int]:
    """(key, text, extra..., block): rows dealt evenly to blocks of about
    ``block_bytes`` of text.

    The block follows from key and text, so a retried task deals alike, and a
    key held by many rows is spread over many blocks.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, int(size // block_bytes) + 1)
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *extra, block.alias("block")), blocks


def texts_in(table: pa.Table, column: str = "text") -> list[str | None]:
    return table.column(column).to_pylist()


def longs_in(table: pa.Table, column: str, null: int = np.iinfo(np.int64).min) -> np.ndarray:
    """A long column as numpy; NULL becomes the smallest long (sorts first)."""
    return table.column(column).fill_null(null).to_numpy().astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Give memory that a task has freed back to the system: Python workers are
    reused, and what an idle one holds on to is missing to the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
