"""Two models on the same observations: cohort check, aligned differences, block totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import SIDE_LINES, TARGETS
from foretally.functions.calendar import block_id
from foretally.functions.counts import add_mean_brier
from foretally.operators.scoring import cohort_sums


def cohort_mismatch(forecasts: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Observations that some of the models lack, hold twice, or describe with another outcome."""
    per_model = [F.count_if(F.col("model") == m) for m in models]
    ragged = per_model[0] != 1
    for count in per_model[1:]:
        ragged = ragged | (count != 1)
    return (
        forecasts.filter(F.col("model").isin(*models))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), (ragged | (F.min("actual") != F.max("actual"))).alias("ragged"))
        .filter("ragged")
        .drop("ragged")
    )


def require_same_cohort(forecasts: DataFrame, models: Sequence[str], keys: Sequence[str]) -> None:
    """Raise unless the models hold the same observations with the same outcomes.

    Each model's set is summed to a fingerprint, a row a model and task; only if these differ are observations
    compared by key, to name how many disagree.
    """
    own = forecasts.filter(F.col("model").isin(*models))
    sums = own.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *cohort_sums(keys)).collect()  # a row a model
    if len(sums) != len(set(models)) or len({tuple(row)[1:] for row in sums}) > 1:
        n = cohort_mismatch(forecasts, models, keys).count()
        raise ValueError(f"models must contain identical observations; {n} are not in all of them once")


def align(forecasts: DataFrame, baseline: str, challenger: str, keys: Sequence[str]) -> DataFrame:
    """Long forecasts to one row per observation, by key and never by position."""

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return forecasts.filter(F.col("model").isin(baseline, challenger)).groupBy(*keys).agg(
        F.max("actual").alias("actual"),
        *[of(baseline, c).alias(f"base_{c}") for c in ("expected", "dispersion")],
        *[of(challenger, c).alias(f"other_{c}") for c in ("expected", "dispersion")],
        of(baseline, "model").alias("base_model"),
        of(challenger, "model").alias("other_model"),
    )


def panel_pair(panel: DataFrame, models: Sequence[str], baseline: str, challenger: str) -> DataFrame:
    """The same from a panel, whose rows already hold all models: no shuffle."""
    b, c = (F.col("forecasts")[models.index(m)] for m in (baseline, challenger))
    return panel.select(
        *[k for k in panel.columns if k != "forecasts"],
        *[b[x].alias(f"base_{x}") for x in ("expected", "dispersion")],
        *[c[x].alias(f"other_{x}") for x in ("expected", "dispersion")],
    )


def side_deltas(pairs: DataFrame, lines: Sequence[float] = SIDE_LINES) -> DataFrame:
    """Challenger minus baseline: absolute error and mean Brier score of each observation."""
    scored = add_mean_brier(pairs, lines, "base_expected", "base_dispersion", name="base_brier")
    scored = add_mean_brier(scored, lines, "other_expected", "other_dispersion", name="other_brier")
    actual = F.col("actual")
    return scored.withColumns(
        {
            "mae_delta": F.abs(actual - F.col("other_expected")) - F.abs(actual - F.col("base_expected")),
            "brier_delta": F.col("other_brier") - F.col("base_brier"),
        }
    ).drop("base_brier", "other_brier")


CONTEST_VALUE = ("match_date", "competition", "home_team", "away_team", "home_count", "away_count")


def counted_contests(contests: DataFrame, start: dt.date) -> DataFrame:
    """Contests from ``start`` on, those with equal values as one row; ``copies`` counts them."""
    return contests.filter(F.col("match_date") >= F.lit(start)).groupBy(*CONTEST_VALUE).agg(F.count(F.lit(1)).alias("copies"))


def fixture_deltas(deltas: DataFrame, key: Sequence[str] = CONTEST_VALUE) -> DataFrame:
    """Mean difference per fixture; contests with equal values are one fixture."""
    return deltas.groupBy(*key).agg(
        F.avg("mae_delta").alias("mae_delta"),
        F.avg("brier_delta").alias("brier_delta"),
        F.count("brier_delta").alias("observations"),
    )


def block_totals(deltas: DataFrame, keys: Sequence[str], value: str = "brier_delta") -> DataFrame:
    """Number and sum of differences per calendar block, the unit of the block bootstrap; NULL ones don't count."""
    return (
        deltas.withColumn("block_id", block_id("match_date"))
        .groupBy(*keys, "block_id")
        .agg(F.count(value).alias("n"), F.sum(value).alias("s"))
        .where("n > 0")
    )


def goal_pair_deltas(panel: DataFrame, models: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Squared-error difference of every (challenger, baseline) pair and target, row by row.

    All models sit on the panel row, so the pairs are array look-ups; nothing is joined.
    """
    at = {m: i for i, m in enumerate(models)}

    def squared(model: str, target: str) -> Column:
        error = F.col("forecasts")[at[model]][f"p_{target}"] - F.col(f"y_{target}")
        return error * error

    used = sorted({m for pair in pairs for m in pair})
    rows = panel.select(
        "match_id", "match_date", "competition", *[squared(m, t).alias(f"e_{m}_{t}") for m in used for t in TARGETS]
    )
    entries = [
        F.struct(
            F.lit(f"{challenger}_minus_{baseline}").alias("pair"),
            F.lit(t).alias("target"),
            (F.col(f"e_{challenger}_{t}") - F.col(f"e_{baseline}_{t}")).alias("brier_delta"),
        )
        for challenger, baseline in pairs
        for t in TARGETS
    ]
    return rows.select("match_id", "match_date", "competition", F.inline_outer(F.array(*entries)))
