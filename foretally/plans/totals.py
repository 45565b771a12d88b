"""Walk-forward forecasts of the contest total from the expanding league mean."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.contracts import EVALUATION_START, TOTAL_LINES
from foretally.functions.counts import add_over_probabilities, moment_dispersion
from foretally.operators.ledger import Ledger, league_state
from foretally.workspace import attach

_TOTAL = "home_count + away_count AS actual"


def total_state(ledger: Ledger) -> DataFrame:
    """Expected total and dispersion per (competition, date); no row before the first result."""
    past = league_state(ledger.daily, ["n", "total_sum", "total_sq"]).filter(F.col("past_n") > 0)
    return past.select(
        "competition",
        "match_date",
        F.try_divide("past_total_sum", "past_n").alias("expected"),
        moment_dispersion(F.col("past_n"), F.col("past_total_sum"), F.col("past_total_sq")).alias("dispersion"),
    )


def total_forecasts(
    contests: DataFrame,
    ledger: Ledger,
    start: dt.date = EVALUATION_START,
    lines: Sequence[float] = TOTAL_LINES,
    with_poisson: bool = False,
) -> DataFrame:
    """One row per contest (and model). Probabilities are computed once per date, then attached."""
    facts = contests.filter(F.col("match_date") >= F.lit(start)).select(
        "match_id", "match_date", "competition", "home_team", "away_team", F.expr(_TOTAL)
    )
    return _with_forecasts(facts, ledger, start, lines, with_poisson)


def counted_total_forecasts(
    contests: DataFrame, ledger: Ledger, start: dt.date = EVALUATION_START, lines: Sequence[float] = TOTAL_LINES
) -> DataFrame:
    """One row per competition, date and total; ``copies`` counts its contests, which all have the same forecast."""
    facts = contests.filter(F.col("match_date") >= F.lit(start)).groupBy("match_date", "competition", F.expr(_TOTAL))
    return _with_forecasts(facts.agg(F.count(F.lit(1)).alias("copies")), ledger, start, lines)


def _with_forecasts(facts: DataFrame, ledger: Ledger, start: dt.date, lines: Sequence[float], with_poisson: bool = False) -> DataFrame:
    models = [F.struct(F.lit("negative_binomial").alias("model"), F.col("dispersion"))]
    if with_poisson:
        models.append(F.struct(F.lit("poisson").alias("model"), F.lit(0.0).alias("dispersion")))
    daily = (
        total_state(ledger)
        .filter(F.col("match_date") >= F.lit(start))
        .select("competition", "match_date", "expected", F.inline_outer(F.array(*models)))
    )
    state = add_over_probabilities(daily, lines)
    if with_poisson:
        state = state.groupBy("competition", "match_date", "expected").agg(
            F.sort_array(F.collect_list(F.struct("model", "dispersion", "p_over"))).alias("models")
        )
    else:
        state = state.withColumn("models", F.array(F.struct("model", "dispersion", "p_over"))).drop("model", "dispersion", "p_over")
    joined = attach(facts, state, ["competition", "match_date"], ledger.dates)
    return joined.select(*facts.columns, "expected", F.inline_outer("models"))
