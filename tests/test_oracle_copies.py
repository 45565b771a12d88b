"""The SQL of team histories on copies of the order tables: the same rows on any number of DuckDB threads."""

import duckdb
import pytest

from oracle.statements import oracle_sql

FOLDER = "/root/testdata/sf0.1"
SHIFTED = {
    "customer": {"c_custkey": 15000},
    "supplier": {"s_suppkey": 1000},
    "orders": {"o_orderkey": 150000, "o_custkey": 15000},
    "lineitem": {"l_orderkey": 150000, "l_suppkey": 1000},
}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Six copies of the order tables, each with keys of its own."""
    folder = tmp_path_factory.mktemp("copies")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW nation AS SELECT * FROM '{FOLDER}/nation.parquet'")
    for table, keys in SHIFTED.items():
        shifted = ", ".join(f"{key} + copy * {step} AS {key}" for key, step in keys.items())
        connection.sql(f"COPY (SELECT * EXCLUDE (copy) REPLACE ({shifted}) FROM '{FOLDER}/{table}.parquet', range(6) c(copy)) TO '{folder}/{table}.parquet'")
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["team_history", "resumed_team_history"])
def test_sql_gives_the_same_histories_on_any_number_of_threads(copies, name):
    found = []
    for threads in (1, 8):
        copies.sql(f"SET threads = {threads}")
        found.append(sorted(copies.sql(oracle_sql()[name]).fetchall()))
    assert len(found[0]) == 224179
    assert [pair for pair in zip(*found) if pair[0] != pair[1]] == []
