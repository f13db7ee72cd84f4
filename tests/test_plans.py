"""Plan invariants of every registered query (checked on the smallest tables):
no cartesian or nested-loop joins, no row-at-a-time Python UDFs, and the only
Arrow-batched Python is the exact similarity ratio."""

import os

import pytest

from tapestry.plans import queries as Q

SF = os.environ.get("TAPESTRY_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
PYTHON_OK = set()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_plan_invariants(spark, name):
    plan = plan_of(Q.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan


def test_profile_plan_shape(spark):
    plan = plan_of(Q.queries()["profile"](spark, SF))
    # code tables are broadcast; satellites reach the spine as aggregates
    assert plan.count("BroadcastExchange") >= 2
    assert "ObjectHashAggregate" in plan


def test_pruning_and_pushdown(spark):
    # a two-column projection with a filter reads two columns and pushes the filter into the scan
    df = Q.queries()["filter_isin"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    lk = Q.queries()["lookup_left"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_regionkey), Not(EqualTo(n_regionkey,0))" in lk or "Not(EqualTo(n_regionkey,0))" in lk
