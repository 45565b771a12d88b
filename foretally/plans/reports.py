"""Report jobs: season files (or a contest log) in, small nested results out.

Only metric tables reach the driver; their size depends on the number of models, lines,
windows and seasons, never on the number of contests.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.contracts import (
    BLOCK_SAMPLES,
    BOOTSTRAP_SEED,
    COMPETITION_CODE,
    DECAY_MODELS,
    EVALUATION_START,
    GOAL_MODELS,
    GOAL_PAIRS,
    HALF_LIFE_DAYS,
    HOLDOUT_START,
    IID_SAMPLES,
    MIN_GOAL_CONTESTS,
    MIN_RHO_HISTORY,
    PRIOR_CHOICES,
    PRIOR_MATCHES,
    RHO_LIMIT,
    SIDE_LINES,
    SIDE_MODELS,
    TARGETS,
    TOTAL_LINES,
)
from foretally.functions.calendar import evaluation_windows
from foretally.operators import pairing, quality, resample, scoring
from foretally.operators.ledger import build_ledger
from foretally.plans.goals import goal_forecasts, goal_panel, goal_rates, rho_table
from foretally.plans.sides import decay_panel, long_forecasts, side_panel
from foretally.plans.totals import total_forecasts
from foretally.sources.season_csv import LoadedLog, file_manifest, load_contests, load_goals
from foretally.workspace import settle


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


_OBSERVATION = ("match_id", "venue")


def _quality(loaded: LoadedLog, strict: bool = True) -> dict:
    """Row counts of a load; without ``strict`` also the rows that were set aside."""
    overall = loaded.quality.filter(F.col("file_path").isNull()).head()
    counts = {k: overall[k] for k in ("rows_read", "rows_loaded", "rows_without_result")}
    if not strict:
        counts["rows_quarantined"] = overall["rows_quarantined"]
        if loaded.goal_quarantine is not None:
            counts["goal_rows_quarantined"] = loaded.goal_quarantine.count()
    return counts


def _metric_tree(tally: DataFrame, lines: Sequence[float], keys: Sequence[str], with_under: bool = False) -> dict[tuple, dict]:
    tree = {}
    for row in _rows(scoring.count_metrics(tally, lines, keys)):
        key = tuple(row.pop(k) for k in keys)
        tree[key] = {**row, "lines": {}}
    for row in _rows(scoring.line_metrics(tally, lines, keys, with_under)):
        key = tuple(row.pop(k) for k in keys)
        row.pop("n")
        row.pop("n_unscored")
        tree[key]["lines"][str(row.pop("line"))] = row
    return tree


def _delta(baseline: dict, challenger: dict) -> dict:
    return {m: challenger[m] - baseline[m] for m in scoring.METRICS}


def _usable(tally: DataFrame, strict: bool) -> None:
    quality.require_rows(tally)
    if strict:
        scoring.require_scored(tally)


def total_report(
    spark: SparkSession,
    paths: Iterable[str],
    start: dt.date = EVALUATION_START,
    strict: bool = True,
    multi_line: bool = False,
) -> dict:
    """Full-contest totals: expanding mean with Negative Binomial probabilities.

    With ``strict`` a malformed row or a forecast without a valid distribution raises; else it is left out and counted.
    """
    loaded = load_contests(spark, paths, strict, multi_line)
    quality.require_competitions(loaded.contests)
    forecasts = total_forecasts(loaded.contests, build_ledger(loaded.contests), start)
    tally = settle(scoring.tally_counts(forecasts, TOTAL_LINES, ["model"]), "tally")
    _usable(tally, strict)
    return {
        "competition": COMPETITION_CODE,
        "target": "full_match_total",
        "evaluation_start": start.isoformat(),
        "data_quality": _quality(loaded, strict),
        "evaluation": _metric_tree(tally, TOTAL_LINES, ["model"], with_under=True)[("negative_binomial",)],
    }


def side_report(
    spark: SparkSession,
    paths: Iterable[str],
    start: dt.date = EVALUATION_START,
    prior: int = PRIOR_MATCHES,
    samples: int = IID_SAMPLES,
    strict: bool = True,
    multi_line: bool = False,
) -> dict:
    """Side totals: venue average against team + opponent, with a paired fixture bootstrap."""
    loaded = load_contests(spark, paths, strict, multi_line)
    quality.require_competitions(loaded.contests)
    panel = side_panel(loaded.contests, build_ledger(loaded.contests), start, (prior,))
    keys = ["model", "venue"]
    by_venue = settle(scoring.tally_counts(long_forecasts(panel), SIDE_LINES, keys, _OBSERVATION), "tally")
    _usable(by_venue, strict)
    scoring.require_one_cohort(by_venue)
    overall = _metric_tree(scoring.refold(by_venue, ["model"]), SIDE_LINES, ["model"])
    venues = _metric_tree(by_venue, SIDE_LINES, keys)
    deltas = pairing.side_deltas(pairing.panel_pair(panel, SIDE_MODELS, *SIDE_MODELS))
    intervals = resample.iid_bootstrap(pairing.fixture_deltas(deltas), pairing.CONTEST_VALUE, samples=samples)
    return {
        "competition": COMPETITION_CODE,
        "target": "side_totals",
        "evaluation_start": start.isoformat(),
        "prior_matches": prior,
        "data_quality": _quality(loaded, strict),
        "models": {
            m: {"overall": overall[(m,)], "by_venue": {v: venues[(m, v)] for v in ("home", "away")}} for m in SIDE_MODELS
        },
        "team_opponent_minus_venue_average": _delta(overall[("venue_average",)], overall[("team_opponent",)]),
        "paired_bootstrap": {
            "samples": samples,
            "seed": BOOTSTRAP_SEED,
            "metrics": {row.pop("metric"): row for row in _rows(intervals)},
        },
    }


def prior_sensitivity(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Challenger minus baseline per prior, from forecasts of a panel with several priors."""
    tally = scoring.tally_counts(forecasts, SIDE_LINES, [*keys, "model", "prior"])
    metrics = scoring.count_metrics(tally, SIDE_LINES, [*keys, "model", "prior"])
    # the baseline is the row without a prior: of each group's few rows one aggregate keeps all
    base = [F.max(F.when(F.col("prior").isNull(), F.col(m))).alias(f"base_{m}") for m in scoring.METRICS]
    rows = F.collect_list(F.when(F.col("prior").isNotNull(), F.struct("prior", *scoring.METRICS)))
    grouped = metrics.groupBy(*keys).agg(*base, rows.alias("rows"))
    return grouped.select(*keys, *[f"base_{m}" for m in scoring.METRICS], F.inline("rows")).select(
        *keys, "prior", *[(F.col(m) - F.col(f"base_{m}")).alias(f"{m}_delta") for m in scoring.METRICS]
    )


def prior_report(contests: DataFrame, priors: Sequence[int] = PRIOR_CHOICES, start: dt.date = EVALUATION_START) -> dict:
    forecasts = long_forecasts(side_panel(contests, build_ledger(contests), start, tuple(priors)))
    return {str(row.pop("prior")): row for row in _rows(prior_sensitivity(forecasts))}


def decay_report(
    spark: SparkSession,
    paths: Iterable[str],
    start: dt.date = EVALUATION_START,
    samples: int = BLOCK_SAMPLES,
    strict: bool = True,
    multi_line: bool = False,
) -> dict:
    """Three models on one cohort, with block intervals of the time-weighted model."""
    loaded = load_contests(spark, paths, strict, multi_line)
    quality.require_rows(loaded.contests, "provide nonempty history")
    quality.require_competitions(loaded.contests)
    quality.require_unique_fixtures(loaded.contests)
    panel = decay_panel(loaded.contests, build_ledger(loaded.contests), start)
    tally = settle(scoring.tally_counts(long_forecasts(panel), SIDE_LINES, ["model"], _OBSERVATION), "tally")
    _usable(tally, strict)
    scoring.require_one_cohort(tally)
    metrics = _metric_tree(tally, SIDE_LINES, ["model"])
    intervals = _rows(decay_intervals(panel, samples))
    return {
        "settings": {
            "competition": COMPETITION_CODE,
            "evaluation_start": start.isoformat(),
            "half_life_days": HALF_LIFE_DAYS,
            "lines": list(SIDE_LINES),
        },
        "data_quality": _quality(loaded, strict),
        "models": {m: metrics[(m,)] for m in DECAY_MODELS},
        "brier_intervals": {row.pop("pair"): row for row in intervals},
    }


DECAY_PAIRS = (("time_weighted_180", "equal_weight"), ("time_weighted_180", "retained"))


def decay_deltas(panel: DataFrame) -> DataFrame:
    """Brier difference of the time-weighted model to both others, row by row.

    The panel row becomes a row a pair before it is scored: two models in a row keep the stage's code short.
    """
    kept = [c for c in ("match_id", "match_date", "competition", "season", "venue") if c in panel.columns]
    at = lambda m, name: [F.col("forecasts")[DECAY_MODELS.index(m)][x].alias(f"{name}_{x}") for x in ("expected", "dispersion")]
    pairs = [F.struct(F.lit(f"{c}_minus_{b}").alias("pair"), *at(c, "other"), *at(b, "base")) for c, b in DECAY_PAIRS]
    rows = panel.select(F.inline_outer(F.array(*pairs)), "actual", *kept)
    return pairing.side_deltas(rows, SIDE_LINES).select("pair", "brier_delta", *kept)


def decay_wins(forecasts: DataFrame, lines: Sequence[float] = SIDE_LINES) -> DataFrame:
    """Seasons, venues and lines in which the time-weighted model has the lower Brier score.

    One pass folds the forecasts to (model, season, venue) sums; the slices are refolds of it.
    """
    fine = settle(scoring.tally_counts(forecasts, lines, ["model", "season", "venue"]), "tally")
    parts = []
    for by in ("season", "venue"):
        metrics = scoring.count_metrics(scoring.refold(fine, ["model", by]), lines, ["model", by])
        parts.append(metrics.select(F.lit(by).alias("by"), F.col(by).alias("value"), "model", F.col("mean_brier").alias("brier")))
    per_line = scoring.line_metrics(scoring.refold(fine, ["model"]), lines, ["model"])
    parts.append(per_line.select(F.lit("line").alias("by"), F.col("line").cast("string").alias("value"), "model", "brier"))
    slices = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("brier")))
    pairs = [F.struct(F.lit(f"{c}_minus_{b}").alias("pair"), (of(c) - of(b)).alias("delta")) for c, b in DECAY_PAIRS]
    deltas = slices.groupBy("by", "value").agg(F.array(*pairs).alias("pairs"))
    return scoring.win_counts(deltas.select("by", F.inline_outer("pairs")), ["pair", "by"])


def decay_intervals(panel: DataFrame, samples: int = BLOCK_SAMPLES, keys: Sequence[str] = ()) -> DataFrame:
    return resample.block_bootstrap(pairing.block_totals(decay_deltas(panel), [*keys, "pair"]), [*keys, "pair"], samples)


def windowed(df: DataFrame, holdout: dt.date) -> DataFrame:
    """Rows repeated once per evaluation window they belong to."""
    return df.withColumn("window", F.explode(evaluation_windows("match_date", holdout)))


def goal_intervals(
    panel: DataFrame, holdout: dt.date = HOLDOUT_START, samples: int = BLOCK_SAMPLES, by: Sequence[str] = ()
) -> DataFrame:
    """Block intervals of every model pair and target, over all dates and the latest window."""
    keys = [*by, "window", "pair", "target"]
    blocks = pairing.block_totals(pairing.goal_pair_deltas(panel, GOAL_MODELS, GOAL_PAIRS), [*by, "pair", "target", "match_date"])
    # block sums per date first: the window split then repeats calendar rows, not fixtures
    spread_rows = windowed(blocks, holdout).filter(F.col("window") != "development")
    folded = spread_rows.groupBy(*keys, "block_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return resample.block_bootstrap(folded, keys, samples)


def goal_report(
    spark: SparkSession,
    paths: Iterable[str],
    start: dt.date = EVALUATION_START,
    holdout: dt.date = HOLDOUT_START,
    samples: int = BLOCK_SAMPLES,
    strict: bool = True,
    multi_line: bool = False,
) -> dict:
    """Ten goal models: metrics by window and season, calibration bins, paired intervals.

    The file manifest grows with the number of files, so it is written, and the report names where.
    """
    paths = [str(p) for p in paths]
    contests, loaded, excluded = load_goals(spark, paths, multi_line=multi_line, strict=strict)
    quality.require_rows(contests, "provide nonempty history")
    quality.require_competitions(contests)
    ledger = build_ledger(contests)
    rates = settle(goal_rates(contests, ledger), "goal-rates", even=True)
    panel = settle(goal_panel(rates, settle(rho_table(rates, start), "rho"), ledger.dates, start), "goal-panel")
    forecasts = goal_forecasts(panel)
    quality.require_rows(panel, "no predictions")
    tally = settle(scoring.tally_events(windowed(forecasts, holdout), ["window", "season", "model", "target"]), "tally")
    if strict:
        scoring.require_scored(tally)
    keys = ["window", "model", "target"]
    metrics: dict = {}
    for row in _rows(scoring.event_metrics(tally, keys)):
        w, m, t = (row.pop(k) for k in keys)
        metrics.setdefault(w, {}).setdefault(m, {})[t] = {**row, "calibration_bins": []}
    for row in _rows(scoring.calibration_bins(tally, keys).orderBy(*keys, "bin")):
        w, m, t = (row.pop(k) for k in keys)
        row.pop("bin")
        metrics[w][m][t]["calibration_bins"].append(row)
    for row in _rows(rho_summary(windowed(panel, holdout), ["window"])):
        metrics[row.pop("window")][row.pop("model")]["rho"] = row
    seasonal: dict = {}
    per_season = tally.filter(F.col("window") == "all")
    for row in _rows(scoring.event_metrics(per_season, ["season", "model", "target"])):
        s, m, t = (row.pop(k) for k in ("season", "model", "target"))
        seasonal.setdefault(s, {}).setdefault(m, {})[t] = row
    intervals: dict = {}
    for row in _rows(goal_intervals(panel, holdout, samples)):
        w, p, t = (row.pop(k) for k in ("window", "pair", "target"))
        intervals.setdefault(w, {}).setdefault(p, {})[t] = row
    return {
        "settings": {
            "competition": COMPETITION_CODE,
            "evaluation_start": start.isoformat(),
            "latest_window_start": holdout.isoformat(),
            "half_life_days": HALF_LIFE_DAYS,
            "prior_matches": PRIOR_MATCHES,
            "minimum_history": MIN_GOAL_CONTESTS,
            "minimum_rho_history": MIN_RHO_HISTORY,
            "rho_limit": RHO_LIMIT,
            "targets": list(TARGETS),
        },
        "data_quality": {
            **_quality(loaded, strict),
            "excluded_source_rows": excluded.count(),
            "manifest": settle(file_manifest(spark, paths, multi_line, loaded.rows), "manifest").inputFiles()[0].rsplit("/", 1)[0],
        },
        "metrics": metrics,
        "paired_28_day_block_intervals": intervals,
        "seasonal_metrics": seasonal,
    }


def rho_summary(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, smallest and largest rho over the forecasts that have one."""
    rows = panel.select(*keys, F.inline_outer("forecasts")).filter(F.col("rho").isNotNull())
    return rows.groupBy(*keys, "model").agg(
        F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho")
    )


def as_json(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A metric table as one JSON document per key, ready for a text or JSON sink."""
    return metrics.select(*keys, F.to_json(F.struct(*[c for c in metrics.columns if c not in keys])).alias("report"))


def write_report(metrics: DataFrame, path: str, form: str = "json") -> None:
    metrics.write.format(form).mode("errorifexists").save(path)
