"""Histories that stop at a snapshot and go on, against histories that never stopped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foretally.operators import rho, snapshots
from foretally.operators.ledger import build_ledger, league_state, team_state
from foretally.plans.goals import goal_rates
from foretally.plans.sides import decay_panel, side_panel
from tests.conftest import seeded_log

ENDS = (dt.date(2015, 6, 30), dt.date(2015, 9, 15))
START = dt.date(2015, 5, 1)
LEAGUE = ["n", "home_sum", "away_sum", "total_sum", "total_sq", "home_goals_sum", "over_n", "btts_n"]
TEAM = ["n", "count_for", "goals_allowed"]


@pytest.fixture(scope="module")
def log(goal_log):
    both = goal_log(seeded_log(5, 260)).unionByName(goal_log(seeded_log(6, 150, sides=5), "E2"))
    return both.cache()


def between(log, after, through):
    day = F.col("match_date")
    log = log if after is None else log.where(day > F.lit(after))
    return log if through is None else log.where(day <= F.lit(through))


def advanced(spark, log, path, half_lives=(180.0,)):
    before, eras = None, []
    for end in ENDS:
        eras.append((between(log, before, end), snapshots.advance(between(log, before, end), path, end, before, half_lives)))
        before = end
    last = between(log, before, None)
    return [*eras, (last, snapshots.resume(last, snapshots.load(spark, path, before), before))]


def plain(value):
    """Nested rows as tuples, doubles without their last digits."""
    if isinstance(value, (tuple, list)):
        return tuple(map(plain, value))
    return round(value, 7) + 0.0 if isinstance(value, float) else value


def rows_of(df):
    return sorted(map(plain, df.select(*sorted(df.columns)).collect()), key=str)


def together(parts):
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return rows_of(whole)


def test_resumed_state_is_the_state_of_a_full_run(spark, log, tmp_path):
    full = build_ledger(log).daily
    half_lives = (180.0, 7.0, 0.05)
    eras = [ledger.daily for _, ledger in advanced(spark, log, str(tmp_path / "history"), half_lives)]
    assert together([league_state(d, LEAGUE) for d in eras]) == rows_of(league_state(full, LEAGUE))
    for venue in ("home", "away"):
        assert together([team_state(d, venue, TEAM) for d in eras]) == rows_of(team_state(full, venue, TEAM))
    for half_life in half_lives:
        decayed = ["n", "home_goals_sum"]
        expected = rows_of(league_state(full, [], decayed, half_life))
        assert together([league_state(d, [], decayed, half_life) for d in eras]) == expected
        assert together([team_state(d, "home", [], TEAM, half_life) for d in eras]) == rows_of(team_state(full, "home", [], TEAM, half_life))


def test_plans_work_on_resumed_ledgers(spark, log, tmp_path):
    eras, full = advanced(spark, log, str(tmp_path / "history")), build_ledger(log)
    for plan in (
        lambda contests, ledger: side_panel(contests, ledger, START),
        lambda contests, ledger: decay_panel(contests, ledger, START, min_observations=20, min_venue_contests=3),
        lambda contests, ledger: goal_rates(contests, ledger, min_contests=30),
    ):
        expected = rows_of(plan(log, full))
        assert expected and together([plan(*era) for era in eras]) == expected


def test_running_extremes_resume(spark, log):
    rates = goal_rates(log, build_ledger(log), min_contests=30).cache()
    parts, carry, edges = [], None, (None, *ENDS, None)
    for after, end in zip(edges[:-1], edges[1:]):
        rows = rho.rate_rows(between(rates, after, end))
        parts.append(rho.rho_bounds(rows, carry))
        carry = snapshots.coefficient_carry(rho.coefficient_days(rows), end, carry) if end else None
    assert together(parts) == rows_of(rho.rho_bounds(rho.rate_rows(rates)))


def test_late_contests_fail_with_their_date(spark, log, tmp_path):
    path = str(tmp_path / "history")
    snapshots.advance(between(log, None, ENDS[0]), path, ENDS[0])
    late = log.where(F.col("match_date") >= F.lit(dt.date(2015, 6, 20)))
    with pytest.raises(Exception, match=r"E[12]: a contest on 2015-06-\d\d, but the history is closed through 2015-06-30"):
        snapshots.advance(late, path, ENDS[1], ENDS[0])


def test_contests_beyond_the_new_snapshot_fail(log, tmp_path):
    with pytest.raises(Exception, match="the ledger goes beyond 2015-06-30"):
        snapshots.advance(log, str(tmp_path / "history"), ENDS[0])


def test_snapshots_are_replaced_one_by_one(spark, log, tmp_path):
    path = str(tmp_path / "history")
    advanced(spark, log, path)
    first, second = (rows_of(snapshots.load(spark, path, end)) for end in ENDS)
    snapshots.advance(between(log, *ENDS), path, ENDS[1], ENDS[0])
    assert rows_of(snapshots.load(spark, path, ENDS[0])) == first and rows_of(snapshots.load(spark, path, ENDS[1])) == second


def test_unfinished_or_unordered_snapshots_are_refused(spark, log, tmp_path):
    path = tmp_path / "history"
    with pytest.raises(ValueError, match="no finished snapshot through 2015-06-30"):
        snapshots.load(spark, str(path), ENDS[0])
    snapshots.advance(between(log, None, ENDS[1]), str(path), ENDS[1])
    with pytest.raises(ValueError, match="can't follow"):
        snapshots.advance(between(log, None, ENDS[0]), str(path), ENDS[0], ENDS[1])


def test_empty_batches_carry_on(spark, log, tmp_path):
    path, nothing = str(tmp_path / "history"), log.where("false")
    ledger = snapshots.advance(nothing, path, ENDS[0])
    assert ledger.rows == 0 and snapshots.load(spark, path, ENDS[0]).count() == 0
    snapshots.advance(between(log, ENDS[0], ENDS[1]), path, ENDS[1], ENDS[0])
    held = snapshots.load(spark, path, ENDS[1])
    later = dt.date(2016, 12, 31)
    snapshots.advance(nothing, path, later, ENDS[1])
    old, new = (rows_of(df.select("competition", "venue", "team", "n", "count_for", "goals_for")) for df in (held, snapshots.load(spark, path, later)))
    assert old == new and old


def test_unknown_half_life_is_refused(spark, log, tmp_path):
    _, ledger = advanced(spark, log, str(tmp_path / "history"))[1]
    with pytest.raises(ValueError, match="half-life of 90"):
        league_state(ledger.daily, [], ["n"], 90.0)


def test_only_new_dates_are_read(spark, log, tmp_path):
    written = str(tmp_path / "log")
    log.write.parquet(written)
    batch = between(spark.read.schema(log.schema).parquet(written), ENDS[0], ENDS[1])
    plan = snapshots.after(batch, ENDS[0])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(match_date,2015-06-30)" in plan and "LessThanOrEqual(match_date,2015-09-15)" in plan
