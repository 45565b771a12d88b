"""Contests with equal values are scored once: their number weighs the sums of a tally."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foretally.contracts import SIDE_LINES, TOTAL_LINES
from foretally.operators import pairing, scoring
from foretally.operators.ledger import build_ledger
from foretally.plans import sides, totals
from tests.conftest import seeded_log

START = dt.date(2015, 3, 5)


@pytest.fixture(scope="module")
def repeated(contests):
    """Each contest three times; the first ones end without a count, so that the next have no distribution."""
    zero = [(dt.date(2015, 3, day), f"side {day}", "side 0", 0, 0) for day in (3, 4, 5, 6)]
    rows = [*zero, *[row[:5] for row in seeded_log(3, 60, first=dt.date(2015, 3, 7))]]
    log = contests(rows * 3)
    return log, build_ledger(log), len({row for row in rows if row[0] >= START})


def agree(plain, counted):
    assert plain.dtypes == counted.dtypes
    key = lambda row: tuple(str(value) for value in row.asDict().values())
    for a, b in zip(*[sorted(rows, key=key) for rows in (plain.collect(), counted.collect())], strict=True):
        for name, value in a.asDict().items():
            assert b[name] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value), name


def test_totals(repeated):
    log, ledger, distinct = repeated
    counted = totals.counted_total_forecasts(log, ledger, START)
    assert counted.count() <= distinct
    plain = scoring.tally_counts(totals.total_forecasts(log, ledger, START), TOTAL_LINES, ["competition"])
    assert plain.first().n_unscored > 0
    agree(plain, scoring.tally_counts(counted, TOTAL_LINES, ["competition"], copies="copies"))


def test_sides(repeated):
    log, ledger, distinct = repeated
    counted = pairing.counted_contests(log, START)
    assert counted.count() == distinct and counted.agg(F.min("copies"), F.max("copies")).first()[:] == (3, 3)
    plain, few = (sides.long_forecasts(sides.side_panel(rows, ledger, START)) for rows in (log, counted))
    assert 3 * few.count() == plain.count()
    keys = ["competition", "model", "venue"]
    agree(scoring.tally_counts(plain, SIDE_LINES, keys), scoring.tally_counts(few, SIDE_LINES, keys, copies="copies"))
