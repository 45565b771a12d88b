import datetime as dt
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foretally.contracts import CONTESTS, GOAL_CONTESTS
from foretally.workspace import start_session


@pytest.fixture(scope="session")
def spark():
    session = start_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def contests(spark):
    """Contest log from (date, home, away, home count, away count, ...) tuples."""

    def build(rows, competition="E1"):
        data = [(i, row[0], competition, *row[1:5]) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, CONTESTS)

    return build


@pytest.fixture(scope="session")
def goal_log(spark):
    """Goal contest log from (date, home, away, home count, away count, home goals, away goals) tuples."""

    def build(rows, competition="E1"):
        data = [(i, row[0], competition, *row[1:7], "s") for i, row in enumerate(rows)]
        return spark.createDataFrame(data, GOAL_CONTESTS)

    return build


def seeded_log(seed, n, sides=6, first=dt.date(2015, 3, 2), most_gap=4):
    """``n`` contests of random sides on random days, several on some days, no fixture twice."""
    draw = random.Random(seed)
    names = [f"side {k}" for k in range(sides)]
    rows, seen, day = [], set(), first
    while len(rows) < n:
        home, away = draw.sample(names, 2)
        if (day, home, away) not in seen:
            seen.add((day, home, away))
            rows.append((day, home, away, draw.randint(0, 11), draw.randint(0, 9), draw.randint(0, 4), draw.randint(0, 3)))
        day += dt.timedelta(days=draw.choice([0, 0, 1, most_gap]))
    return rows
