import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.operators import rho

DAY = dt.date(2017, 1, 1)
SCHEMA = "competition string, model string, match_date date, home_rate double, away_rate double, c double"


def brute_force(history, day, top_home, top_away, half_life):
    """The rho of largest log-likelihood, by looking at ever finer grids inside the feasible interval."""
    past = [(d, c) for d, c in history if d < day]
    if len(past) < 50:
        return 0.0
    c = np.array([c for _, c in past])
    cells = np.append(c, [-top_home * top_away, top_home, top_away, -1.0])
    low = np.append(-0.95 / cells[cells > 0], -0.25).max()
    high = np.append(-0.95 / cells[cells < 0], 0.25).min()
    age = np.array([(day - d).days for d, _ in past])
    w = np.ones(len(c)) if half_life is None else 2.0 ** (-(age - age.min()) / half_life)
    left, right = low, high
    for _ in range(14):
        grid = np.linspace(left, right, 41)
        # likelihoods of neighbours differ by less than their rounding in the end: compare to the middle one
        base = 1 + np.outer(grid[20:21], c)
        value = (w * np.log1p((np.outer(grid, c) - base + 1) / base)).sum(axis=1)
        best = int(value.argmax())
        left, right = grid[max(best - 1, 0)], grid[min(best + 1, 40)]
    return (left + right) / 2 if low < left and right < high else (low if left == low else high)


def check(spark, rows, half_lives=None, tolerance=1e-6):
    half_lives = half_lives or {}
    df = spark.createDataFrame(rows, SCHEMA)
    found = rho.fit_rho(df, DAY, half_lives).collect()
    assert len(found) == len({(r[1], r[2]) for r in rows})
    for row in found:
        same = [r for r in rows if r[1] == row.model]
        today = [r for r in same if r[2] == row.match_date]
        history = [(r[2], r[5]) for r in same if r[5] is not None]
        expected = brute_force(
            history, row.match_date, max(r[3] for r in today), max(r[4] for r in today), half_lives.get(row.model)
        )
        assert row.rho == pytest.approx(expected, abs=tolerance), (row.model, row.match_date)
    return found


def generated(seed, scale, drift, days=120, per_day=3):
    rng = np.random.default_rng(seed)
    rows = []
    for model in ("team_arithmetic", "team_decay_180"):
        for i in range(days):
            for _ in range(per_day):
                h, a = rng.gamma(4, scale / 4, 2)
                cell = rng.choice(4, p=drift)
                c = (-h * a, h, a, -1.0)[cell] if rng.random() < 0.6 else None
                rows.append(("E1", model, DAY + dt.timedelta(days=i), float(h), float(a), None if c is None else float(c)))
    return rows


@pytest.mark.parametrize("drift", [(0.25, 0.25, 0.25, 0.25), (0.45, 0.1, 0.1, 0.35), (0.05, 0.45, 0.45, 0.05)])
def test_roots_have_the_largest_likelihood(spark, drift):
    check(spark, generated(1, 1.3, drift), {"team_decay_180": 180})


@pytest.mark.parametrize("drift", [(0.3, 0.2, 0.2, 0.3), (0.6, 0.0, 0.0, 0.4), (0.0, 0.5, 0.5, 0.0)])
def test_large_coefficients_take_the_fine_points(spark, drift, monkeypatch):
    calls = []
    refined = rho._refined
    monkeypatch.setattr(rho, "_refined", lambda *a: calls.append(1) or refined(*a))
    check(spark, generated(2, 3.5, drift, days=80), {"team_decay_180": 180})
    assert calls


def test_constant_coefficients_pin_the_lower_limit(spark):
    rows = [("E1", "team_arithmetic", DAY, 1.0, 1.0, -1.0)] * 60
    rows.append(("E1", "team_arithmetic", DAY + dt.timedelta(days=31), 2.0, 2.0, None))
    last = {r.match_date: r for r in check(spark, rows)}
    assert last[DAY].rho == 0.0  # nothing before the first date
    pinned = last[DAY + dt.timedelta(days=31)]
    assert pinned.rho == -0.25 and pinned.high == pytest.approx(0.95 / 4)


def test_short_history_gives_zero(spark):
    rows = [("E1", "team_arithmetic", DAY + dt.timedelta(days=i), 1.0, 1.0, -1.0) for i in range(49)]
    rows.append(("E1", "team_arithmetic", DAY + dt.timedelta(days=60), 1.0, 1.0, None))
    assert {r.rho for r in check(spark, rows)} == {0.0}


def test_history_of_the_same_date_is_not_used(spark):
    rows = [("E1", "team_arithmetic", DAY, 1.0, 1.0, -1.0)] * 200
    assert check(spark, rows)[0].rho == 0.0


@pytest.mark.parametrize("half_life", [40, 5, 1])
def test_short_half_lives_take_eras(spark, half_life):
    rows = [(r[0], r[1], DAY + 9 * (r[2] - DAY), *r[3:]) for r in generated(4, 1.2, (0.3, 0.2, 0.2, 0.3), days=130)]
    check(spark, rows, {"team_decay_180": half_life}, 1e-5)


def test_half_life_must_be_positive(spark):
    rows = spark.createDataFrame([("E1", "m", DAY, 1.0, 1.0, -1.0)], SCHEMA)
    with pytest.raises(ValueError):
        rho.fit_rho(rows, DAY, {"m": 0})
