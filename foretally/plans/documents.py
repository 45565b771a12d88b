"""Reports as nested documents, one for each competition, built and written by Spark.

The reports of ``reports.py`` answer for one competition and come to the driver. Here every analysis is a table with a
row a competition whose ``report`` column nests models, venues, lines and intervals as structs and maps, so a
thousand competitions cost one pass over the log and nothing reaches the driver. What a competition's row gathers is
bounded by models times venues times lines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import (
    BLOCK_SAMPLES,
    BOOTSTRAP_SEED,
    DECAY_MODELS,
    EVALUATION_START,
    HALF_LIFE_DAYS,
    HOLDOUT_START,
    IID_SAMPLES,
    PRIOR_MATCHES,
    SIDE_LINES,
    SIDE_MODELS,
    TOTAL_LINES,
)
from foretally.operators import pairing, resample, scoring
from foretally.operators.ledger import Ledger, build_ledger
from foretally.plans.goals import goal_forecasts
from foretally.plans.reports import decay_intervals, goal_intervals, rho_summary, windowed
from foretally.plans.sides import decay_panel, long_forecasts, side_panel
from foretally.plans.totals import counted_total_forecasts
from foretally.workspace import settle

_OWN = "competition"


def as_map(rows: DataFrame, keys: Sequence[str], name: str, under: str) -> DataFrame:
    """One row for each of ``keys``: a map from ``name`` to a struct of all other columns, in order of the names."""
    rest = [c for c in rows.columns if c not in keys and c != name]
    entries = F.array_sort(
        F.collect_list(F.struct(F.col(name).cast("string").alias("key"), F.struct(*rest).alias("value"))),
        lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),  # the values may be maps
    )
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias(under))


def _scores(tally: DataFrame, lines: Sequence[float], keys: Sequence[str], with_under: bool = False) -> DataFrame:
    """Metrics of each key with a map of its lines."""
    per_line = scoring.line_metrics(tally, lines, keys, with_under).drop("n", "n_unscored")
    return scoring.count_metrics(tally, lines, keys).join(as_map(per_line, keys, "line", "lines"), list(keys))


def total_documents(contests: DataFrame, start: dt.date = EVALUATION_START, ledger: Ledger | None = None) -> DataFrame:
    """(competition, report) of contest totals."""
    forecasts = counted_total_forecasts(contests, ledger or build_ledger(contests), start)
    tally = settle(scoring.tally_counts(forecasts, TOTAL_LINES, [_OWN], copies="copies"), "tally")
    scores = _scores(tally, TOTAL_LINES, [_OWN], with_under=True)
    evaluation = F.struct(*[c for c in scores.columns if c != _OWN]).alias("evaluation")
    return scores.select(_OWN, _report(F.lit("full_match_total").alias("target"), _day(start), evaluation))


def side_documents(
    contests: DataFrame,
    start: dt.date = EVALUATION_START,
    prior: int = PRIOR_MATCHES,
    samples: int = IID_SAMPLES,
    ledger: Ledger | None = None,
) -> DataFrame:
    """(competition, report) of side totals, with the paired bootstrap of each competition's fixtures."""
    counted = settle(pairing.counted_contests(contests, start), "counted-contests", even=True)
    panel = side_panel(counted, ledger or build_ledger(contests), start, (prior,))
    tally = settle(scoring.tally_counts(long_forecasts(panel), SIDE_LINES, [_OWN, "model", "venue"], copies="copies"), "tally")
    overall = settle(_scores(scoring.refold(tally, [_OWN, "model"]), SIDE_LINES, [_OWN, "model"]), "overall")
    venues = as_map(_scores(tally, SIDE_LINES, [_OWN, "model", "venue"]), [_OWN, "model"], "venue", "by_venue")
    whole = overall.select(_OWN, "model", F.struct(*[c for c in overall.columns if c not in (_OWN, "model")]).alias("overall"))
    models = as_map(whole.join(venues, [_OWN, "model"]), [_OWN], "model", "models")
    change = scoring.metric_differences(overall, *SIDE_MODELS, [_OWN])
    change = change.select(_OWN, F.struct(*[F.col(f"{m}_delta").alias(m) for m in scoring.METRICS]).alias("challenger_minus_baseline"))
    fixtures = pairing.fixture_deltas(pairing.side_deltas(pairing.panel_pair(panel, SIDE_MODELS, *SIDE_MODELS)))
    key = [c for c in pairing.CONTEST_VALUE if c != _OWN]
    intervals = as_map(resample.iid_bootstrap(fixtures, key, samples=samples, by=[_OWN]), [_OWN], "metric", "metrics")
    bootstrap = F.struct(F.lit(samples).alias("samples"), F.lit(BOOTSTRAP_SEED).alias("seed"), "metrics").alias("paired_bootstrap")
    joined = models.join(change, _OWN).join(intervals, _OWN, "left")
    target = F.lit("side_totals").alias("target")
    return joined.select(_OWN, _report(target, _day(start), F.lit(prior).alias("prior_matches"), "models", "challenger_minus_baseline", bootstrap))


def decay_documents(
    fixtures: DataFrame, start: dt.date = EVALUATION_START, samples: int = BLOCK_SAMPLES, ledger: Ledger | None = None
) -> DataFrame:
    """(competition, report) of the three models on one cohort, with block intervals; ``fixtures`` are unique."""
    panel = settle(decay_panel(fixtures, ledger or build_ledger(fixtures), start), "decay-panel")
    tally = settle(scoring.tally_counts(long_forecasts(panel), SIDE_LINES, [_OWN, "model"]), "tally")
    models = as_map(_scores(tally, SIDE_LINES, [_OWN, "model"]).where(F.col("model").isin(*DECAY_MODELS)), [_OWN], "model", "models")
    intervals = as_map(decay_intervals(panel, samples, [_OWN]), [_OWN], "pair", "brier_intervals")
    half_life = F.lit(float(HALF_LIFE_DAYS)).alias("half_life_days")
    return models.join(intervals, _OWN).select(_OWN, _report(_day(start), half_life, "models", "brier_intervals"))


def goal_documents(panel: DataFrame, holdout: dt.date = HOLDOUT_START, samples: int = BLOCK_SAMPLES) -> DataFrame:
    """(competition, report) of the ten goal models on a written panel: windows, seasons, bins, rho and intervals."""
    keys = [_OWN, "window", "model", "target"]
    tally = settle(scoring.tally_events(windowed(goal_forecasts(panel), holdout), [*keys, "season"]), "tally")
    bins = scoring.calibration_bins(tally, keys)
    bins = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[c for c in bins.columns if c not in keys]))).alias("calibration_bins"))
    targets = as_map(scoring.event_metrics(tally, keys).join(bins, keys), keys[:3], "target", "targets")
    rho = rho_summary(windowed(panel, holdout), [_OWN, "window"])
    rho = rho.select(*keys[:3], F.struct("mean_rho", "min_rho", "max_rho").alias("rho"))
    models = as_map(targets.join(rho, keys[:3], "left"), keys[:2], "model", "models")
    metrics = as_map(models, [_OWN], "window", "metrics")
    seasons = scoring.event_metrics(tally.where("window = 'all'"), [_OWN, "season", "model", "target"])
    seasonal = as_map(as_map(as_map(seasons, [_OWN, "season", "model"], "target", "targets"), [_OWN, "season"], "model", "models"), [_OWN], "season", "seasonal_metrics")
    pairs = as_map(goal_intervals(panel, holdout, samples, [_OWN]), [_OWN, "window", "pair"], "target", "targets")
    intervals = as_map(as_map(pairs, [_OWN, "window"], "pair", "pairs"), [_OWN], "window", "paired_28_day_block_intervals")
    joined = metrics.join(seasonal, _OWN).join(intervals, _OWN, "left")
    latest = F.lit(holdout.isoformat()).alias("latest_window_start")
    return joined.select(_OWN, _report(latest, "metrics", "seasonal_metrics", "paired_28_day_block_intervals"))


def _day(start: dt.date) -> Column:
    return F.lit(start.isoformat()).alias("evaluation_start")


def _report(*parts: Column | str) -> Column:
    return F.struct(*parts).alias("report")


def write_documents(documents: DataFrame, path: str, analysis: str) -> None:
    """Put documents as JSON under ``path``, a partition for each analysis and competition.

    A second run replaces the partitions that it writes and leaves all others: Spark stages the new files and
    moves them at the commit, so a run that fails or is repeated leaves whole partitions.
    """
    rows = documents.select(F.to_json("report").alias("value"), F.lit(analysis).alias("analysis"), _OWN)
    spread = rows.repartition("analysis", _OWN)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis", _OWN).text(path)
