"""Every registered query against its DuckDB SQL on the smallest tables
(the driver repeats this at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import rows_of  # noqa: E402

from tapestry.plans import queries as Q  # noqa: E402

SF = os.environ.get("TAPESTRY_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in Q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_oracle(spark, con, name):
    sp = Q.queries()[name](spark, SF).toPandas()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert len(sp.columns) > 0
        return
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(con.execute(sql).df())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
