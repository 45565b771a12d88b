"""Every query of the contest log on the smallest tables: plan shape, and values against DuckDB SQL."""

import pytest

from check_oracle import compare, connect
from foretally.catalog import queries
from oracle.statements import oracle_sql

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
FORBIDDEN = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")
SINGLE_TASK = {"iid_bootstrap"}  # offsets of at most 4,096 buckets


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert name in SINGLE_TASK or "SinglePartition" not in plan
    good, note = compare(df, connection, SQL.get(name))
    assert good, note
