import pytest

from check_oracle import compare, connect
from foretally.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    good, note = compare(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
    assert good, note


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
