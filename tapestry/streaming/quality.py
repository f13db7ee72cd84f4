from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapestry.operators.quality import apply_rules, flatten_results
from tapestry.session import ensure_checkpoint_dir


def quality_stream(spark: SparkSession, source: str, schema: StructType, rules: str, sink: str,
                   name: str = "quality", fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Apply a rule block to every new file under ``source`` and append the rows
    with their ``data_quality_result`` to ``sink``.  Restartable: progress is
    kept under ``spark.checkpoint.dir``/``name``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    checked = flatten_results(apply_rules(stream, rules))
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}"
    writer = checked.writeStream.format(fmt).option("checkpointLocation", ckpt).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink)
