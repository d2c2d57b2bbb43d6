"""Every registered query against its SQL."""

import os

import pytest
from oracle import connect, duck_rows, spark_rows, type_clashes

from parley.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names, rows = spark_rows(df)
    if name not in ORACLES:
        assert rows
        return
    assert (names, rows) == duck_rows(duck, ORACLES[name])
    assert not type_clashes(df, duck, ORACLES[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
