"""Walk-forward goal forecasts: over 2.5 goals and both sides scoring, ten models on one cohort."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import (
    BASE_GOAL_MODELS,
    EVALUATION_START,
    HALF_LIFE_DAYS,
    MIN_GOAL_CONTESTS,
    TARGETS,
)
from foretally.functions.counts import dixon_coles_events, poisson_events
from foretally.functions.rates import arithmetic_rate, event_rate, floored_league, multiplicative_rate
from foretally.operators.ledger import Ledger
from foretally.operators.rho import fit_rho, rate_rows
from foretally.plans.sides import with_state
from foretally.workspace import attach

_TEAM_SUMS = ["n", "goals_for", "goals_allowed"]
_LEAGUE_SUMS = ["n", "home_goals_sum", "away_goals_sum", "over_n", "btts_n"]
_DECAYED_LEAGUE = ["n", "home_goals_sum", "away_goals_sum"]


def outcomes(home_goals: Column, away_goals: Column) -> tuple[Column, Column]:
    over = (home_goals + away_goals >= 3).cast("int")
    both = ((home_goals > 0) & (away_goals > 0)).cast("int")
    return over, both


def goal_rates(fixtures: DataFrame, ledger: Ledger, half_life: float = HALF_LIFE_DAYS, min_contests: int = MIN_GOAL_CONTESTS) -> DataFrame:
    """Rates of the four base models and the event rates, from the first date with enough history.

    Dates before the evaluation start are kept: their forecasts feed the rho history.
    """
    facts = fixtures.select(
        "match_id", "match_date", "competition", "home_team", "away_team", "home_goals", "away_goals", "season"
    )
    rows = with_state(facts, ledger, _TEAM_SUMS, _LEAGUE_SUMS, _TEAM_SUMS, _DECAYED_LEAGUE, half_life).filter(
        F.col("league_past_n") >= max(1, min_contests)
    )
    pairs = (("home", "away"), ("away", "home"))
    for venue, _ in pairs:
        for kind in ("past", "decayed"):
            rows = rows.withColumn(
                f"{venue}_league_{kind}",
                floored_league(F.col(f"league_{kind}_{venue}_goals_sum"), F.col(f"league_{kind}_n")),
            )

    def history(venue: str, other: str, kind: str):
        return (
            F.col(f"{venue}_{kind}_goals_for"),
            F.col(f"{venue}_{kind}_n"),
            F.col(f"{other}_{kind}_goals_allowed"),
            F.col(f"{other}_{kind}_n"),
            F.col(f"{venue}_league_{kind}"),
        )

    def model(name: str, rate) -> Column:
        return F.struct(
            F.lit(name).alias("model"),
            rate("home", "away").alias("home_rate"),
            rate("away", "home").alias("away_rate"),
        )

    rates = [
        model("venue_poisson", lambda venue, other: F.col(f"{venue}_league_past")),
        model("team_arithmetic", lambda venue, other: arithmetic_rate(*history(venue, other, "past"))),
        model("team_multiplicative", lambda venue, other: multiplicative_rate(*history(venue, other, "past"))),
        model("team_decay_180", lambda venue, other: multiplicative_rate(*history(venue, other, "decayed"))),
    ]
    return rows.select(
        "match_id",
        "match_date",
        "competition",
        "home_team",
        "away_team",
        "home_goals",
        "away_goals",
        "season",
        event_rate(F.col("league_past_over_n"), F.col("league_past_n")).alias("over_rate"),
        event_rate(F.col("league_past_btts_n"), F.col("league_past_n")).alias("btts_rate"),
        F.array(*rates).alias("rates"),
    )


def rho_table(rates: DataFrame, start: dt.date = EVALUATION_START, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """rho per (competition, model, date); only the decay model weights its history by age."""
    return fit_rho(rate_rows(rates), start, {"team_decay_180": half_life})


def goal_panel(rates: DataFrame, rho: DataFrame, state_rows: int, start: dt.date = EVALUATION_START) -> DataFrame:
    """One row per fixture with the aligned forecasts of all ten models.

    ``state_rows`` bounds the number of (competition, date) pairs.
    """
    by_date = rho.groupBy("competition", "match_date").agg(
        *[F.max(F.when(F.col("model") == name, F.col("rho"))).alias(f"rho_{name}") for name in BASE_GOAL_MODELS]
    )
    scored = rates.filter(F.col("match_date") >= F.lit(start))
    joined = attach(scored, by_date, ["competition", "match_date"], state_rows)
    # probabilities get a projection of their own, so the array below only refers to columns
    computed = {}
    for i, name in enumerate(BASE_GOAL_MODELS):
        home, away = F.col("rates")[i]["home_rate"], F.col("rates")[i]["away_rate"]
        computed[f"home_{name}"], computed[f"away_{name}"] = home, away
    staged = joined.withColumns(computed)
    computed = {}
    for name in BASE_GOAL_MODELS:
        home, away, value = (F.col(f"{part}_{name}") for part in ("home", "away", "rho"))
        computed[f"over_{name}"], computed[f"btts_{name}"] = poisson_events(home, away)
        computed[f"over_{name}_dc"], computed[f"btts_{name}_dc"] = dixon_coles_events(home, away, value)
    staged = staged.withColumns(computed)

    none = F.lit(None).cast("double")

    def forecast(name: str, over: Column, both: Column, base: str | None = None, corrected: bool = False) -> Column:
        return F.struct(
            F.lit(name).alias("model"),
            over.alias("p_over_2_5"),
            both.alias("p_btts_yes"),
            (F.col(f"home_{base}") if base else none).alias("home_rate"),
            (F.col(f"away_{base}") if base else none).alias("away_rate"),
            (F.col(f"rho_{base}") if corrected else none).alias("rho"),
        )

    forecasts = [
        forecast("coin_0_5", F.lit(0.5), F.lit(0.5)),
        forecast("expanding_event_rate", F.col("over_rate"), F.col("btts_rate")),
    ]
    for suffix in ("", "_dc"):
        forecasts += [
            forecast(name + suffix, F.col(f"over_{name}{suffix}"), F.col(f"btts_{name}{suffix}"), name, suffix == "_dc")
            for name in BASE_GOAL_MODELS
        ]
    over, both = outcomes(F.col("home_goals"), F.col("away_goals"))
    return staged.select(
        "match_id",
        "match_date",
        "competition",
        "home_team",
        "away_team",
        "season",
        over.alias("y_over_2_5"),
        both.alias("y_btts_yes"),
        F.array(*forecasts).alias("forecasts"),
    )


def goal_forecasts(panel: DataFrame) -> DataFrame:
    """One row per fixture, model and target with the probability and the outcome."""
    keys = ["match_id", "match_date", "competition", "home_team", "away_team", "season"]
    wide = panel.select(*keys, *[f"y_{t}" for t in TARGETS], F.inline_outer("forecasts"))
    targets = [
        F.struct(F.lit(t).alias("target"), F.col(f"p_{t}").alias("p"), F.col(f"y_{t}").alias("y")) for t in TARGETS
    ]
    return wide.select(*keys, "model", "home_rate", "away_rate", "rho", F.inline_outer(F.array(*targets)))
