"""Walk-forward forecasts of each side's count: venue average, team + opponent, time decay."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import (
    EVALUATION_START,
    HALF_LIFE_DAYS,
    MIN_DECAY_OBSERVATIONS,
    MIN_VENUE_CONTESTS,
    PRIOR_MATCHES,
    SIDE_LINES,
)
from foretally.functions.counts import add_over_probabilities, moment_dispersion
from foretally.functions.rates import arithmetic_rate, multiplicative_rate, smoothed_league
from foretally.operators.ledger import Ledger, league_state, prefixed, team_state
from foretally.workspace import attach

_TEAM_SUMS = ["n", "count_for", "count_allowed"]
_LEAGUE_SUMS = ["n", "home_sum", "away_sum", "home_sq", "away_sq"]
_DECAYED_LEAGUE = ["n", "home_sum", "away_sum"]


def with_state(
    facts: DataFrame,
    ledger: Ledger,
    team_columns: list[str],
    league_columns: list[str],
    decayed_team: Sequence[str] = (),
    decayed_league: Sequence[str] = (),
    half_life: float = HALF_LIFE_DAYS,
    start: dt.date | None = None,
) -> DataFrame:
    """Attach league state and both sides' venue-role state to wide contest rows.

    The home side's opponent state is the away side's own state on the same row, so three
    equi-joins on (competition, date[, team]) replace any as-of join. ``start`` trims state
    and facts after the windows have seen the earlier dates.
    """
    league = league_state(ledger.daily, league_columns, list(decayed_league), half_life)
    home = team_state(ledger.daily, "home", team_columns, list(decayed_team), half_life)
    away = team_state(ledger.daily, "away", team_columns, list(decayed_team), half_life)
    if start is not None:
        recent = F.col("match_date") >= F.lit(start)
        facts, league, home, away = (df.filter(recent) for df in (facts, league, home, away))
    keys = ["competition", "match_date"]
    base = {k: k for k in keys}
    facts = attach(facts, prefixed(league, "league", base), keys, ledger.dates)
    facts = attach(facts, prefixed(home, "home", {**base, "team": "home_team"}), [*keys, "home_team"], ledger.rows)
    return attach(facts, prefixed(away, "away", {**base, "team": "away_team"}), [*keys, "away_team"], ledger.rows)


def _facts(contests: DataFrame) -> DataFrame:
    columns = ["match_date", "competition", "home_team", "away_team", "home_count", "away_count"]
    return contests.select(*[c for c in ("match_id", *columns, "season", "copies") if c in columns or c in contests.columns])


def _venue_dispersion(venue: str) -> Column:
    c = lambda name: F.col(f"league_past_{name}")
    return moment_dispersion(c("n"), c(f"{venue}_sum"), c(f"{venue}_sq"))


def _panel(rows: DataFrame, home_models: list[Column], away_models: list[Column]) -> DataFrame:
    """One row per side of a contest with its aligned forecasts of all models."""

    def side(venue: str, models: list[Column]) -> Column:
        return F.struct(
            F.lit(venue).alias("venue"),
            F.col(f"{venue}_team").alias("team"),
            F.col(f"{venue}_count").alias("actual"),
            F.array(*models).alias("forecasts"),
        )

    kept = [c for c in ("match_id", "match_date", "competition", "season", "home_team", "away_team", "home_count", "away_count", "copies") if c in rows.columns]
    return rows.select(*kept, F.inline_outer(F.array(side("home", home_models), side("away", away_models))))


def _model(name: str, expected: Column, dispersion: Column, *extra: Column) -> Column:
    return F.struct(F.lit(name).alias("model"), *extra, expected.alias("expected"), dispersion.alias("dispersion"))


def long_forecasts(panel: DataFrame, lines: Sequence[float] = SIDE_LINES) -> DataFrame:
    """One row per model and side, with the probability of exceeding each line."""
    rows = panel.select(*[c for c in panel.columns if c != "forecasts"], F.inline_outer("forecasts"))
    return add_over_probabilities(rows, lines)


def side_panel(
    contests: DataFrame,
    ledger: Ledger,
    start: dt.date = EVALUATION_START,
    priors: Sequence[int] = (PRIOR_MATCHES,),
) -> DataFrame:
    """Venue-average baseline and one team + opponent challenger per prior, on every contest.

    History does not depend on the prior, so several priors share one pass; forecasts carry
    the prior (NULL for the baseline).
    """
    for prior in priors:
        if prior <= 0:
            raise ValueError("prior_matches must be greater than zero")
    rows = with_state(_facts(contests), ledger, _TEAM_SUMS, _LEAGUE_SUMS, start=start).filter(F.col("league_past_n") > 0)
    for venue, other in (("home", "away"), ("away", "home")):
        league = F.try_divide(f"league_past_{venue}_sum", "league_past_n")
        rows = rows.withColumn(f"{venue}_league", league).withColumn(f"{venue}_dispersion", _venue_dispersion(venue))
    for venue, other in (("home", "away"), ("away", "home")):
        for prior in priors:
            rows = rows.withColumn(
                f"{venue}_expected_{prior}",
                arithmetic_rate(
                    F.col(f"{venue}_past_count_for"),
                    F.col(f"{venue}_past_n"),
                    F.col(f"{other}_past_count_allowed"),
                    F.col(f"{other}_past_n"),
                    F.col(f"{venue}_league"),
                    prior,
                ),
            )

    def models(venue: str) -> list[Column]:
        dispersion = F.col(f"{venue}_dispersion")
        none = F.lit(None).cast("int").alias("prior")
        out = [_model("venue_average", F.col(f"{venue}_league"), dispersion, none)]
        for prior in priors:
            out.append(_model("team_opponent", F.col(f"{venue}_expected_{prior}"), dispersion, F.lit(prior).alias("prior")))
        return out

    return _panel(rows, models("home"), models("away"))


def decay_state(fixtures: DataFrame, ledger: Ledger, start: dt.date = EVALUATION_START, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Fixtures with equal-weight and decayed state of the league and both sides."""
    return with_state(
        _facts(fixtures), ledger, _TEAM_SUMS, _LEAGUE_SUMS, _TEAM_SUMS, _DECAYED_LEAGUE, half_life, start
    )


def eligible(
    rows: DataFrame,
    min_observations: int = MIN_DECAY_OBSERVATIONS,
    min_venue_contests: int = MIN_VENUE_CONTESTS,
) -> DataFrame:
    """The common cohort: enough league observations (two per contest) and venue history of both sides."""
    enough = F.col("league_past_n") * 2 >= min_observations
    return rows.filter(
        enough
        & (F.col("league_past_n") > 0)
        & (F.least("home_past_n", "away_past_n") >= min_venue_contests)
    )


def decay_panel(
    fixtures: DataFrame,
    ledger: Ledger,
    start: dt.date = EVALUATION_START,
    half_life: float = HALF_LIFE_DAYS,
    min_observations: int = MIN_DECAY_OBSERVATIONS,
    min_venue_contests: int = MIN_VENUE_CONTESTS,
) -> DataFrame:
    """Retained, equal-weight and time-weighted models on one cohort of unique fixtures.

    The retained model keeps its per-venue dispersion; the two others use the dispersion
    pooled over both venues.
    """
    rows = eligible(decay_state(fixtures, ledger, start, half_life), min_observations, min_venue_contests)
    n = F.col("league_past_n")
    rows = rows.withColumn(
        "pooled_dispersion",
        moment_dispersion(
            n * 2,
            F.col("league_past_home_sum") + F.col("league_past_away_sum"),
            F.col("league_past_home_sq") + F.col("league_past_away_sq"),
        ),
    )
    pairs = (("home", "away"), ("away", "home"))
    for venue, _ in pairs:
        rows = (
            rows.withColumn(f"{venue}_league", F.try_divide(F.col(f"league_past_{venue}_sum"), n))
            .withColumn(f"{venue}_dispersion", _venue_dispersion(venue))
            .withColumn(f"{venue}_league_equal", smoothed_league(F.col(f"league_past_{venue}_sum"), n))
            .withColumn(f"{venue}_league_decayed", smoothed_league(F.col(f"league_decayed_{venue}_sum"), F.col("league_decayed_n")))
        )
    for venue, other in pairs:

        def history(kind: str):
            return (
                F.col(f"{venue}_{kind}_count_for"),
                F.col(f"{venue}_{kind}_n"),
                F.col(f"{other}_{kind}_count_allowed"),
                F.col(f"{other}_{kind}_n"),
            )

        rows = (
            rows.withColumn(f"{venue}_retained", arithmetic_rate(*history("past"), F.col(f"{venue}_league")))
            .withColumn(f"{venue}_equal", multiplicative_rate(*history("past"), F.col(f"{venue}_league_equal")))
            .withColumn(f"{venue}_weighted", multiplicative_rate(*history("decayed"), F.col(f"{venue}_league_decayed")))
        )

    def models(venue: str) -> list[Column]:
        pooled = F.col("pooled_dispersion")
        return [
            _model("retained", F.col(f"{venue}_retained"), F.col(f"{venue}_dispersion")),
            _model("equal_weight", F.col(f"{venue}_equal"), pooled),
            _model("time_weighted_180", F.col(f"{venue}_weighted"), pooled),
        ]

    return _panel(rows, models("home"), models("away"))
