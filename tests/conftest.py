import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="session")
def spark():
    from tapestry.session import local_session

    s = local_session(cores="4", shuffle_partitions=4, app="tapestry-tests")
    yield s


@pytest.fixture(scope="session")
def scripts(spark):
    from pyspark.sql import functions as F

    from tapestry.sources.catalog import read_scripts

    df = read_scripts(spark, os.path.join(FIXTURES, "scripts"))
    return df.withColumn("path", F.regexp_extract("path", r"scripts/(.*)$", 1)).cache()
