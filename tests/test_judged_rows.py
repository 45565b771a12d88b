"""Rows are parsed once: queries read the written judged rows, and their status agrees with the list of faults."""

import pytest
from pyspark.sql import functions as F

from foretally.catalog import queries
from foretally.operators.quality import judged

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["Div", "Date", "HomeTeam", "AwayTeam", "HC", "AC"]
CELLS = {
    "Div": ["E1", " ", None],
    "Date": ["1/2/2003", " 01/02/03\t", "31/02/2003", "2003-02-01", "1/2/0000", "1/2/3/2003", "", None],
    "HomeTeam": ["A", "b", "", None],
    "AwayTeam": ["B", " "],
    "HC": ["6", "6.0", "1e1", "-1", "2.5", "2147483647", "2147483648", "0000000006", "+6", "nan", " ", None],
    "AC": ["3", "x", "", None],
}


@pytest.mark.parametrize("name", ["goal_contests", "contests_canonical", "excluded_rows"])
def test_filters_parse_no_cell_again(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "date_format" not in plan


def test_status_agrees_with_the_faults(spark):
    rows = spark.createDataFrame([()] * 1, "").select(F.lit(0).alias("row"))
    for name in COLUMNS:
        rows = rows.select("*", F.explode(F.array(*[F.lit(cell).cast("string") for cell in CELLS[name]])).alias(name))
    found = judged(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("faults") > 0).alias("faulty"))
    by_status = {row.status: (row.n, row.faulty) for row in found.collect()}
    assert by_status["loaded"][1] == 0 and by_status["loaded"][0] > 0
    assert by_status["quarantined"][0] == by_status["quarantined"][1] > 0
