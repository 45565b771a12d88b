"""Forecasts of seeded logs against recomputation from the definitions, and against changed futures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from foretally.contracts import DECAY_MODELS, GOAL_MODELS, SIDE_LINES, TOTAL_LINES
from foretally.operators import quality, scoring
from foretally.operators.ledger import build_ledger, daily_totals, decayed_past, league_daily, team_state
from foretally.plans import reports, sides, totals
from foretally.plans.goals import goal_forecasts, goal_panel, goal_rates, rho_table
from tests.conftest import seeded_log


def totals_of(log, start):
    return totals.total_forecasts(log, build_ledger(log), start)


def sides_of(log, start, priors=(5,)):
    return sides.long_forecasts(sides.side_panel(log, build_ledger(log), start, priors))


def decay_of(log, start, observations=40, venue=2):
    panel = sides.decay_panel(log, build_ledger(log), start, min_observations=observations, min_venue_contests=venue)
    return sides.long_forecasts(panel)


def goals_of(log, start, contests=60):
    ledger = build_ledger(log)
    rates = goal_rates(log, ledger, min_contests=contests)
    return goal_panel(rates, rho_table(rates, start), ledger.dates, start)


def spread_of(values):
    n, mean = len(values), sum(values) / len(values) if values else 0
    if n < 2 or mean == 0:
        return 0.0
    variance = sum((v - mean) ** 2 for v in values) / (n - 1)
    return max(0.0, (variance - mean) / mean**2)


def tail(mu, alpha, line):
    """1 minus the summed probabilities up to the line, each from log-gamma values."""

    def mass(k):
        if alpha < 1e-12:
            return math.exp(-mu + k * math.log(mu) - math.lgamma(k + 1))
        size = 1 / alpha
        return math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(size / (size + mu)) + k * math.log(mu / (size + mu)))

    return 1 - sum(mass(k) for k in range(int(line) + 1))


def smooth(total, n, league, prior=5):
    return (total + prior * league) / (n + prior)


def past_of(rows, row):
    return [r for r in rows if r[0] < row[0]]


def side_values(rows, row, venue):
    """(own counts, own history, opponent's history) for one side: histories are (for, against, age) in the same venue role."""
    own, other, mine, theirs = (1, 2, 3, 4) if venue == "home" else (2, 1, 4, 3)
    age = lambda r: (row[0] - r[0]).days
    past = past_of(rows, row)
    scored = [(r[mine], age(r)) for r in past if r[own] == row[own]]
    allowed = [(r[mine], age(r)) for r in past if r[other] == row[other]]
    return [r[mine] for r in past], [age(r) for r in past], scored, allowed, row[mine]


LOG = seeded_log(1, 90)
START = LOG[30][0]


def test_totals_from_the_definition(contests):
    found = {r.match_id: r for r in totals_of(contests(LOG), START).collect()}
    assert set(found) == {i for i, r in enumerate(LOG) if r[0] >= START}
    for i, r in found.items():
        past = [p[3] + p[4] for p in past_of(LOG, LOG[i])]
        assert r.expected == pytest.approx(sum(past) / len(past)) and r.dispersion == pytest.approx(spread_of(past))
        assert list(r.p_over) == pytest.approx([tail(r.expected, r.dispersion, line) for line in TOTAL_LINES])


def test_sides_from_the_definition(contests):
    found = sides_of(contests(LOG), START).collect()
    assert len(found) == 4 * sum(r[0] >= START for r in LOG)
    for r in found:
        past, _, scored, allowed, actual = side_values(LOG, LOG[r.match_id], r.venue)
        league = sum(past) / len(past)
        team = (smooth(sum(c for c, _ in scored), len(scored), league) + smooth(sum(c for c, _ in allowed), len(allowed), league)) / 2
        assert r.actual == actual and r.dispersion == pytest.approx(spread_of(past))
        assert r.expected == pytest.approx(league if r.model == "venue_average" else team)
        assert list(r.p_over) == pytest.approx([tail(r.expected, r.dispersion, line) for line in SIDE_LINES])


def test_decay_models_from_the_definition(contests):
    found = decay_of(contests(LOG), START).collect()
    cohorts = {m: {(r.match_id, r.venue) for r in found if r.model == m} for m in DECAY_MODELS}
    enough = set()
    for i, row in enumerate(LOG):
        past = past_of(LOG, row)
        roles = min(sum(p[1] == row[1] for p in past), sum(p[2] == row[2] for p in past))
        if row[0] >= START and 2 * len(past) >= 40 and roles >= 2:
            enough |= {(i, "home"), (i, "away")}
    assert enough and all(c == enough for c in cohorts.values())
    for r in found:
        past, ages, scored, allowed, _ = side_values(LOG, LOG[r.match_id], r.venue)
        weigh = (lambda age: 0.5 ** (age / 180)) if r.model == "time_weighted_180" else (lambda age: 1.0)
        w = [weigh(a) for a in ages]
        league = (sum(x * c for x, c in zip(w, past)) + 5) / (sum(w) + 5)
        parts = [(sum(weigh(a) * c for c, a in h), sum(weigh(a) for _, a in h)) for h in (scored, allowed)]
        if r.model == "retained":
            league = sum(past) / len(past)
            expected = sum(smooth(*p, league) for p in parts) / 2
        else:
            expected = smooth(*parts[0], league) * smooth(*parts[1], league) / league
        assert r.expected == pytest.approx(expected), r.model


def test_metrics_from_the_forecasts(contests):
    forecasts = sides_of(contests(LOG), START)
    tally = scoring.tally_counts(forecasts, SIDE_LINES, ["model"])
    rows = forecasts.collect()
    for metric in scoring.count_metrics(tally, SIDE_LINES, ["model"]).collect():
        own = [r for r in rows if r.model == metric.model]
        errors = [r.actual - r.expected for r in own]
        assert metric.n == len(own) and metric.n_unscored == 0
        assert metric.mae == pytest.approx(sum(map(abs, errors)) / len(own))
        assert metric.rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / len(own)))
        briers = [sum((p - (r.actual > x)) ** 2 for p, x in zip(r.p_over, SIDE_LINES)) / len(SIDE_LINES) for r in own]
        assert metric.mean_brier == pytest.approx(sum(briers) / len(own))


def test_unscored_forecasts_stay_out_of_every_metric(spark):
    schema = "model string, match_date date, actual int, expected double, dispersion double, p_over array<double>"
    day = dt.date(2020, 1, 1)
    good = [("m", day, 3, 2.5, 0.1, [0.4, 0.3, 0.2, 0.1]), ("m", day, 6, 4.5, 0.0, [0.7, 0.6, 0.4, 0.2])]
    bad = [("m", day, 3, 0.0, 0.1, [None] * 4), ("m", day, 3, None, 0.1, [None] * 4), ("n", day, 1, -1.0, 0.0, [None] * 4)]

    def metrics(rows):
        tally = scoring.tally_counts(spark.createDataFrame(rows, schema), SIDE_LINES, ["model"])
        found = [scoring.count_metrics(tally, SIDE_LINES, ["model"]), scoring.line_metrics(tally, SIDE_LINES, ["model"])]
        return tally, [r.asDict() for f in found for r in f.where("model = 'm'").collect()]

    tally, with_bad = metrics(good + bad)
    plain_tally, without = metrics(good)
    assert all(a.pop("n_unscored") == 2 and b.pop("n_unscored") == 0 for a, b in zip(with_bad, without))
    assert with_bad == without
    empty = scoring.count_metrics(tally, SIDE_LINES, ["model"]).where("model = 'n'").head()
    assert (empty.n, empty.n_unscored, empty.mae) == (0, 1, None)
    scoring.require_scored(plain_tally)
    with pytest.raises(ValueError, match="3 forecasts"):
        scoring.require_scored(tally)


def test_missing_probabilities_fall_into_no_bin(spark):
    day = dt.date(2020, 1, 1)
    rows = [("m", day, 0.95, 1), ("m", day, 0.3, 0), ("m", day, None, 1), ("m", day, 1.0, None)]
    tally = scoring.tally_events(spark.createDataFrame(rows, "model string, match_date date, p double, y int"), ["model"])
    row = scoring.event_metrics(tally, ["model"]).head()
    assert (row.n, row.n_unscored) == (2, 2)
    assert row.brier == pytest.approx((0.05**2 + 0.3**2) / 2) and row.observed_rate == 0.5
    assert row.ece == pytest.approx((0.05 + 0.3) / 2)
    bins = {r.bin: r.n for r in scoring.calibration_bins(tally, ["model"]).collect()}
    assert bins == {b: int(b in (3, 9)) for b in range(10)}


def test_competitions_do_not_mix(contests):
    one, two = seeded_log(4, 30), seeded_log(5, 30)
    both = contests(one).unionByName(contests(two, "E2").withColumn("match_id", F.col("match_id") + 1000))
    expected = [totals_of(contests(rows), rows[9][0]).select("expected").collect() for rows in (one, two)]
    first = min(one[9][0], two[9][0])
    together = totals_of(both, first).collect()
    for name, rows, alone in (("E1", one, expected[0]), ("E2", two, expected[1])):
        start = rows[9][0]
        assert sorted(r.expected for r in together if r.competition == name and r.match_date >= start) == sorted(r.expected for r in alone)


def test_prior_sensitivity_equals_separate_runs(contests):
    log = contests(LOG)
    together = reports.prior_report(log, (1, 4, 9), START)
    assert set(together) == {"1", "4", "9"}
    for prior in (1, 4, 9):
        assert together[str(prior)] == pytest.approx(reports.prior_report(log, (prior,), START)[str(prior)])
    with pytest.raises(ValueError):
        sides_of(log, START, priors=(0,))


@pytest.mark.parametrize("half_life", [180, 7, 1])
def test_decayed_sums_equal_a_self_join(spark, contests, half_life):
    """Half-lives of 7 and 1 days over 30 years take the era form."""
    rows = [(dt.date(1990, 1, 1) + dt.timedelta(days=(i * 97) % 11000), "AB"[i % 2], "CD"[i % 2], i % 9, i % 5) for i in range(300)]
    daily = daily_totals(contests(rows))
    got = {
        (r.team, r.match_date): (r.decayed_n, r.decayed_count_for)
        for r in team_state(daily, "home", [], ["n", "count_for"], half_life).collect()
    }
    for (team, day), (n, total) in got.items():
        past = [(r, (day - r[0]).days) for r in rows if r[1] == team and r[0] < day]
        assert n == pytest.approx(sum(0.5 ** (age / half_life) for _, age in past), rel=1e-9, abs=1e-12)
        assert total == pytest.approx(sum(r[3] * 0.5 ** (age / half_life) for r, age in past), rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        decayed_past("n", ["competition"], 0)


def with_other_results(rows, cutoff):
    """The same fixtures with other results from ``cutoff`` on."""
    return [(*r[:3], 20 + i % 5, 30 - i % 7, 5 + i % 2, i % 3) if r[0] >= cutoff else r for i, r in enumerate(rows)]


@pytest.mark.parametrize("make", [totals_of, sides_of, decay_of])
def test_count_forecasts_ignore_same_date_and_later_results(contests, make):
    cutoff = LOG[60][0]
    before, after = (make(contests(r), START).filter(F.col("match_date") <= F.lit(cutoff)) for r in (LOG, with_other_results(LOG, cutoff)))
    columns = ["model", "match_id", *(["venue"] if "venue" in before.columns else []), "expected", "dispersion", "p_over"]
    rows = sorted(map(tuple, before.select(*columns).collect()))
    assert rows and rows == sorted(map(tuple, after.select(*columns).collect()))


GOALS = seeded_log(3, 160, sides=8)
GOAL_START = GOALS[0][0]


@pytest.fixture(scope="module")
def goal_base(goal_log):
    return goal_forecasts(goals_of(goal_log(GOALS), GOAL_START)).collect()


def test_goal_base_models_from_the_definition(goal_base):
    cohort = {i for i, r in enumerate(GOALS) if len(past_of(GOALS, r)) >= 60}
    at = {(r.model, r.match_id, r.target): r for r in goal_base}
    assert set(at) == {(m, i, t) for m in GOAL_MODELS for i in cohort for t in ("over_2_5", "btts_yes")}
    for i in cohort:
        row, past = GOALS[i], past_of(GOALS, GOALS[i])
        rates = []
        for own, other, mine in ((1, 2, 5), (2, 1, 6)):
            league = sum(p[mine] for p in past) / len(past)
            history = [[p[mine] for p in past if p[side] == row[side]] for side in (own, other)]
            rates.append([smooth(sum(h), len(h), league) for h in history] + [league])
        for model, rate in (
            ("venue_poisson", lambda a, b, league: league),
            ("team_arithmetic", lambda a, b, league: (a + b) / 2),
            ("team_multiplicative", lambda a, b, league: a * b / league),
        ):
            h, a = (rate(*r) for r in rates)
            over = 1 - sum(math.exp(-h - a) * h**x * a**y / math.factorial(x) / math.factorial(y) for x in range(3) for y in range(3 - x))
            assert at[model, i, "over_2_5"].p == pytest.approx(over)
            assert at[model, i, "btts_yes"].p == pytest.approx((1 - math.exp(-h)) * (1 - math.exp(-a)))
        assert at["expanding_event_rate", i, "over_2_5"].p == pytest.approx((sum(p[5] + p[6] > 2 for p in past) + 1) / (len(past) + 2))
        assert at["coin_0_5", i, "btts_yes"].p == 0.5 and at["coin_0_5", i, "btts_yes"].y == (row[5] > 0 and row[6] > 0)


def test_goal_forecasts_ignore_same_date_and_later_results(goal_base, goal_log):
    cutoff = GOALS[120][0]
    changed = goal_forecasts(goals_of(goal_log(with_other_results(GOALS, cutoff)), GOAL_START)).collect()

    def part(found, early):
        return sorted((r.model, r.match_id, r.target, r.p, r.home_rate or 0, r.rho or 0) for r in found if (r.match_date <= cutoff) == early)

    assert part(goal_base, True) == part(changed, True) and part(goal_base, False) != part(changed, False)


def test_goal_forecasts_do_not_depend_on_row_order_or_partitioning(goal_base, goal_log):
    again = goal_forecasts(goals_of(goal_log(GOALS).orderBy(F.desc("match_id")).repartition(5), GOAL_START)).collect()
    key = lambda r: (r.model, r.match_id, r.target)
    first, second = ({key(r): r.p for r in found} for found in (goal_base, again))
    assert first.keys() == second.keys() and all(first[k] == pytest.approx(second[k], abs=1e-12) for k in first)


def test_counts_are_not_goal_features(goal_base, goal_log):
    other = [(*r[:3], 40 - i % 9, i % 4, *r[5:]) for i, r in enumerate(GOALS)]
    key = lambda r: (r.model, r.match_id, r.target, r.p)
    assert sorted(map(key, goal_base)) == sorted(map(key, goal_forecasts(goals_of(goal_log(other), GOAL_START)).collect()))


def test_over_event_is_the_same_with_and_without_correction(goal_base):
    at = {(r.model, r.match_id): r.p for r in goal_base if r.target == "over_2_5"}
    assert all(p == at[(model[:-3], match)] for (model, match), p in at.items() if model.endswith("_dc"))


def test_invalid_rho_counts_as_unscored(spark, goal_log):
    panel = goals_of(goal_log(GOALS), GOAL_START)
    broken = panel.withColumn("forecasts", F.transform("forecasts", lambda f: f.withField("p_btts_yes", F.when(~f["model"].endswith("_dc"), f["p_btts_yes"]))))
    row = scoring.event_metrics(scoring.tally_events(goal_forecasts(broken), ["model", "target"]), ["model", "target"])
    found = {(r.model, r.target): (r.n > 0, r.n_unscored > 0) for r in row.collect()}
    assert all(v == ((False, True) if m.endswith("_dc") and t == "btts_yes" else (True, False)) for (m, t), v in found.items())


def test_duplicates_are_found_and_reduced(spark, contests):
    rows = seeded_log(9, 12)
    log = contests([*rows, *rows[:3], rows[0]])
    assert sorted(r.n for r in quality.duplicate_fixtures(log).collect()) == [2, 2, 3]
    with pytest.raises(ValueError, match="duplicate fixture"):
        quality.require_unique_fixtures(log)
    kept = quality.unique_fixtures(log)
    assert sorted(r.match_id for r in kept.collect()) == list(range(12)) and kept.columns == log.columns
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def test_league_day_table_matches_the_log(contests):
    rows = seeded_log(2, 40)
    for r in league_daily(daily_totals(contests(rows))).collect():
        own = [x for x in rows if x[0] == r.match_date]
        sums = [len(own), *(sum(x[k] for x in own) for k in (3, 4)), *(sum(x[k] ** 2 for x in own) for k in (3, 4)), sum((x[3] + x[4]) ** 2 for x in own)]
        assert [r.n, r.home_sum, r.away_sum, r.home_sq, r.away_sq, r.total_sq] == sums
