"""Session helpers.

Library code never hard-codes cluster sizing: shuffle partitions, executor
memory and the checkpoint folder come from the session the caller built.
``local_session`` is only for tests, benches and the smoke entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tapestry") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TAPESTRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets that folder (shared storage) and we only
    read it; a missing setting is an error there, never a silent fallback to
    a machine-local folder.  In local mode (tests, bench) a fresh scratch
    folder is made when the setting is absent.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        made = spark.sparkContext.getCheckpointDir()  # an earlier call's folder of this session
        if made:
            return made
        current = tempfile.mkdtemp(prefix="tapestry-ckpt-")
    spark.sparkContext.setCheckpointDir(current)
    return current


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has: a small file is
    read by one task, however much work its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a set number is not merged to fewer


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder below the shared checkpoint folder and read
    it back: iterative jobs cut their lineage with it, and a lost executor costs
    a reread, not a recomputation."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tapestry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
