"""Forecast quality: per-row scores folded once, metrics read from the folded sums.

``tally_*`` is the only step that touches forecast rows. It keeps plain sums per group, so
it combines map-side, and every metric (overall, by venue, by season, by line, bins, ECE)
is arithmetic on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import CALIBRATION_BINS
from foretally.functions.counts import add_log_loss


def outcome(actual: Column, line: float) -> Column:
    return (actual > F.lit(float(line))).cast("double")


def mean_brier(p_over: Column, actual: Column, lines: Sequence[float]) -> Column:
    """Mean squared probability error over the lines, for one row."""
    terms = [F.pow(p_over[i] - outcome(actual, line), F.lit(2.0)) for i, line in enumerate(lines)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total / F.lit(float(len(lines)))


def cohort_sums(cohort: Sequence[str]) -> list[Column]:
    """Sums of two independent hashes of each observation's key and outcome: a fingerprint of a set that no order changes."""
    seen = [F.col(c) for c in (*cohort, "actual")]
    return [F.sum(F.xxhash64(F.lit(salt), *seen).cast("decimal(38,0)")).alias(f"s_cohort_{salt}") for salt in (1, 2)]


def require_one_cohort(tally: DataFrame, by: str = "model") -> None:
    """Raise unless all models of a tally with ``cohort_sums`` were scored on the same observations."""
    sums = tally.groupBy(by).agg(F.sum(F.col("n") + F.col("n_unscored")), F.sum("s_cohort_1"), F.sum("s_cohort_2")).drop(by)
    if sums.distinct().count() > 1:  # a row a model
        raise ValueError("models must contain identical observations")


def tally_counts(
    forecasts: DataFrame, lines: Sequence[float], keys: Sequence[str], cohort: Sequence[str] = (), copies: str | None = None
) -> DataFrame:
    """Score sums per group. Needs expected, actual, dispersion and p_over (one entry per line).

    ``cohort`` names the key of an observation; the tally then holds ``cohort_sums`` as well. ``copies`` names a whole number:
    how many equal observations a row stands for.

    ``n`` counts the scored forecasts. One without a distribution (a mean that is missing or not positive, a
    missing outcome) has no log loss; it enters no sum and is counted in ``n_unscored``.
    """
    actual = F.when(F.col("nll").isNotNull(), F.col("actual"))
    expected = F.when(F.col("nll").isNotNull(), F.col("expected"))
    error = actual - expected
    times = (lambda c: c * F.col(copies)) if copies else (lambda c: c)
    number = (lambda when: F.sum(F.when(when, F.col(copies)).otherwise(F.lit(0)))) if copies else F.count_if
    sums = [
        number(F.col("nll").isNotNull()).alias("n"),
        number(F.col("nll").isNull()).alias("n_unscored"),
        F.sum(times(expected)).alias("s_expected"),
        F.sum(times(actual.cast("bigint"))).alias("s_actual"),
        F.sum(times(F.abs(error))).alias("s_abs"),
        F.sum(times(error * error)).alias("s_sq"),
        F.sum(times(F.col("nll"))).alias("s_nll"),
    ]
    for i, line in enumerate(lines):
        p, y = F.col("p_over")[i], outcome(actual, line)
        sums += [
            F.sum(times((p - y) * (p - y))).alias(f"s_brier_{i}"),
            F.sum(times(F.when(F.col("nll").isNotNull(), p))).alias(f"s_p_{i}"),
            F.sum(times(y)).alias(f"s_y_{i}"),
        ]
    return add_log_loss(forecasts).groupBy(*keys).agg(*sums, *(cohort_sums(cohort) if cohort else []))


def _sum_columns(tally: DataFrame) -> list[str]:
    return [c for c in tally.columns if c in ("n", "n_unscored") or c.startswith("s_")]


def require_scored(tally: DataFrame) -> None:
    """Raise when a tally counts forecasts that could not be scored."""
    unscored = tally.agg(F.sum("n_unscored")).first()[0]
    if unscored:
        raise ValueError(f"{unscored} forecasts have no valid distribution")


def refold(tally: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold a tally to coarser keys."""
    return tally.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _sum_columns(tally)])


def refold_sets(tally: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Fold a tally to several key sets in one pass; absent keys are NULL."""
    grouped = tally.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(*[F.sum(c).alias(c) for c in _sum_columns(tally)])


def count_metrics(tally: DataFrame, lines: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """n, means, MAE, RMSE, log loss and mean Brier per group."""
    brier = F.lit(0.0)
    for i in range(len(lines)):
        brier = brier + F.col(f"s_brier_{i}")
    return tally.select(
        *keys,
        "n",
        "n_unscored",
        _mean("s_expected").alias("mean_predicted"),
        _mean("s_actual").alias("mean_actual"),
        _mean("s_abs").alias("mae"),
        F.sqrt(_mean("s_sq")).alias("rmse"),
        _mean("s_nll").alias("nll"),
        F.try_divide(brier, F.col("n") * F.lit(float(len(lines)))).alias("mean_brier"),
    )


def _mean(sums: str) -> Column:
    """A sum over the scored rows; NULL for a group without any."""
    return F.try_divide(F.col(sums), F.col("n"))


def line_metrics(tally: DataFrame, lines: Sequence[float], keys: Sequence[str], with_under: bool = False) -> DataFrame:
    """Brier, mean predicted and observed share over each line."""
    entries = []
    for i, line in enumerate(lines):
        p, y = _mean(f"s_p_{i}"), _mean(f"s_y_{i}")
        fields = [
            F.lit(float(line)).alias("line"),
            _mean(f"s_brier_{i}").alias("brier"),
            p.alias("predicted_over"),
            y.alias("actual_over"),
        ]
        if with_under:
            fields += [(1 - p).alias("predicted_under"), (1 - y).alias("actual_under")]
        entries.append(F.struct(*fields))
    return tally.select(*keys, "n", "n_unscored", F.inline_outer(F.array(*entries)))


METRICS = ("mae", "rmse", "nll", "mean_brier")


def metric_differences(metrics: DataFrame, baseline: str, challenger: str, keys: Sequence[str] = ()) -> DataFrame:
    """Challenger minus baseline for each headline metric."""

    def of(model: str, metric: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    return metrics.groupBy(*keys).agg(*[(of(challenger, m) - of(baseline, m)).alias(f"{m}_delta") for m in METRICS])


def win_counts(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """In how many slices the challenger is better (negative difference), and of how many."""
    return deltas.groupBy(*keys).agg(F.count_if(F.col(value) < 0).alias("wins"), F.count(F.lit(1)).alias("slices"))


# --- binary targets -----------------------------------------------------------


def probability_bin(p: Column) -> Column:
    """The bin of a probability; NULL for a missing one (``least`` alone would skip it)."""
    return F.when(p.isNotNull(), F.least(F.lit(CALIBRATION_BINS - 1), F.floor(p * CALIBRATION_BINS))).cast("int")


def tally_events(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score sums per group and probability bin. Needs p, y and match_date.

    Forecasts without probability or outcome are counted in ``n_unscored`` of a row without a bin and enter no sum.
    """
    scored = F.col("p").isNotNull() & F.col("y").isNotNull()
    error = F.col("p") - F.col("y")
    return (
        forecasts.withColumn("scored", scored)
        .withColumn("bin", F.when(F.col("scored"), probability_bin(F.col("p"))))
        .groupBy(*keys, "bin")
        .agg(
            F.count_if("scored").alias("n"),
            F.count_if(~F.col("scored")).alias("n_unscored"),
            F.sum(F.when(F.col("scored"), F.col("p"))).alias("s_p"),
            F.sum(F.when(F.col("scored"), F.col("y")).cast("bigint")).alias("s_y"),
            F.sum(error * error).alias("s_brier"),
            F.min(F.when(F.col("scored"), F.col("match_date"))).alias("first_date"),
            F.max(F.when(F.col("scored"), F.col("match_date"))).alias("last_date"),
        )
    )


def event_metrics(tally: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier, means, bias and expected calibration error per group."""
    gap = F.abs(F.col("s_p") - F.col("s_y"))  # n_b * |mean predicted - observed|
    n = F.sum("n")
    return tally.groupBy(*keys).agg(
        n.alias("n"),
        F.sum("n_unscored").alias("n_unscored"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.try_divide(F.sum("s_brier"), n).alias("brier"),
        F.try_divide(F.sum("s_p"), n).alias("mean_predicted"),
        F.try_divide(F.sum("s_y"), n).alias("observed_rate"),
        F.try_divide(F.sum("s_p") - F.sum("s_y"), n).alias("calibration_bias"),
        F.try_divide(F.sum(gap), n).alias("ece"),
    )


def calibration_bins(tally: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All bins of every group; a bin without forecasts has n = 0 and NULL means."""
    bins = tally.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(CALIBRATION_BINS - 1)))
    )
    filled = tally.where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("s_p").alias("s_p"), F.sum("s_y").alias("s_y"))
    return bins.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / F.lit(float(CALIBRATION_BINS))).alias("lower"),
        ((F.col("bin") + 1) / F.lit(float(CALIBRATION_BINS))).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        (F.col("s_p") / F.col("n")).alias("mean_predicted"),
        (F.col("s_y") / F.col("n")).alias("observed_rate"),
    )
