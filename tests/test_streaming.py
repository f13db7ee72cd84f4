import os
import tempfile

from tapestry.plans.queries import T
from tapestry.streaming import quality_stream

RULES = """
Orders
    o_orderkey must not be null
    o_orderstatus should be in ['F','O']
"""


def test_quality_stream_available_now(spark):
    src = "/root/testdata/sf0.001"
    if not os.path.isdir(src):
        return
    orders = T(spark, src, "orders")
    inbox = tempfile.mkdtemp(prefix="tapestry-inbox-")
    orders.write.mode("overwrite").parquet(os.path.join(inbox, "batch1"))
    sink = tempfile.mkdtemp(prefix="tapestry-sink-")
    q = quality_stream(spark, os.path.join(inbox, "batch1"), orders.schema, RULES, sink, name=os.path.basename(sink))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == orders.count()
    failed = out.filter("size(data_quality_result) > 0").count()
    assert failed == orders.filter("o_orderstatus NOT IN ('F', 'O')").count()
