"""The registered queries: every operator on the contest log derived from the order tables.

Derived base tables (contest log, unique fixtures, daily ledgers, goal rates, rho) are
settled once per session and folder; each query is a plan over them.
"""

from __future__ import annotations

import datetime as dt
import functools
import os
import uuid
from collections.abc import Callable
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretally.contracts import (
    PRIOR_CHOICES,
    SIDE_LINES,
    SIDE_MODELS,
    TOTAL_LINES,
)
from foretally.functions.calendar import july_season, time_weight
from foretally.functions.counts import (
    dixon_coles_events,
    moment_dispersion,
    negative_log_loss,
    over_probability,
)
from foretally.functions.parsing import parse_count, parse_match_date
from foretally.functions.rates import smoothed
from foretally.operators import pairing, quality, resample, rho as rho_ops, scoring, snapshots
from foretally.operators.ledger import Ledger, build_ledger, league_state, team_state
from foretally.operators.reshape import observations
from foretally.plans import documents, goals, reports, sides, totals
from foretally.sources.contest_log import FIXTURE_HOLDOUT, FIXTURE_START, contests_from, log_from_orders, raw_rows
from foretally.sources.season_csv import file_manifest, load_contests, load_goals, season_label
from foretally.workspace import at_release, run_folder, settle

#: Contests of a long run, and the lines of its total.
LONG_RUN = 50
LONG_RUN_LINES = (450.5, 500.5, 550.5)

#: Days at which the resumed queries close the history and go on from its snapshot.
ERA_ENDS = (dt.date(1995, 12, 31), dt.date(1999, 6, 30))

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


class Derived:
    """Base tables of one folder, settled on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def log(self) -> DataFrame:
        return settle(log_from_orders(self.spark, self.folder), "log", even=True)

    @property
    def contests(self) -> DataFrame:
        return contests_from(self.log)

    @cached_property
    def fixtures(self) -> DataFrame:
        return settle(unique_fixtures(self), "fixtures", even=True)

    @cached_property
    def ledger(self) -> Ledger:
        return build_ledger(self.contests)

    @cached_property
    def fixture_ledger(self) -> Ledger:
        return build_ledger(self.fixtures)

    @cached_property
    def raw(self) -> DataFrame:
        return raw_rows(self.log)

    @cached_property
    def judged(self) -> DataFrame:
        """Typed and judged rows with the cells that are read later: filters on them parse nothing again."""
        rows = quality.judged(self.raw).drop("faults", "Div", "Date", "HomeTeam", "AwayTeam")
        return settle(rows, "judged", even=True)

    @cached_property
    def goal_rates(self) -> DataFrame:
        return settle(goals.goal_rates(self.fixtures, self.fixture_ledger), "goal-rates", even=True)

    @cached_property
    def rho(self) -> DataFrame:
        return settle(goals.rho_table(self.goal_rates, FIXTURE_START), "rho")

    def _eras(self, contests: DataFrame, name: str) -> list[tuple[DataFrame, Ledger]]:
        """Each era's contests with a ledger that goes on from the snapshot before it."""
        path, found, before = os.path.join(run_folder(self.spark), f"history-{name}-{uuid.uuid4().hex}"), [], None
        for end in ERA_ENDS:
            era = _between(contests, before, end)
            found.append((era, snapshots.advance(era, path, end, before)))
            before = end
        last = _between(contests, before, None)
        return [*found, (last, snapshots.resume(last, snapshots.load(self.spark, path, before), before))]

    @cached_property
    def eras(self) -> list[tuple[DataFrame, Ledger]]:
        return self._eras(self.contests, "contests")

    @cached_property
    def fixture_eras(self) -> list[tuple[DataFrame, Ledger]]:
        return self._eras(self.fixtures, "fixtures")

    @property
    def side_panel(self) -> DataFrame:
        return sides.side_panel(self.contests, self.ledger, FIXTURE_START)

    @property
    def decay_panel(self) -> DataFrame:
        return sides.decay_panel(self.fixtures, self.fixture_ledger, FIXTURE_START)

    @property
    def goal_panel(self) -> DataFrame:
        return goals.goal_panel(self.goal_rates, self.rho, self.fixture_ledger.dates, FIXTURE_START)

    @property
    def goal_forecasts(self) -> DataFrame:
        return goals.goal_forecasts(self.goal_panel)


_derived: dict[tuple, Derived] = {}


def derived(spark: SparkSession, folder: str) -> Derived:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _derived or _derived[key].spark is not spark:
        _derived[key] = Derived(spark, folder)
    return _derived[key]


def _forget(application: str) -> None:
    """Base tables of a released application are gone."""
    for key in [key for key in _derived if key[0] == application]:
        del _derived[key]


at_release(_forget)


def _between(rows: DataFrame, after: dt.date | None, through: dt.date | None) -> DataFrame:
    """Rows later than one day, up to another; the filters reach the scan."""
    rows = rows if after is None else rows.where(F.col("match_date") > F.lit(after))
    return rows if through is None else rows.where(F.col("match_date") <= F.lit(through))


def _over(eras: list[tuple[DataFrame, Ledger]], plan: Callable[[DataFrame, Ledger], DataFrame]) -> DataFrame:
    """The rows of a plan over all eras."""
    return functools.reduce(DataFrame.unionByName, [plan(contests, ledger) for contests, ledger in eras])


# --- helpers ------------------------------------------------------------------


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that both engines print the same value (and no negative zero)."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def by_line(df: DataFrame, lines) -> DataFrame:
    """The probability array as one column per line."""
    columns = [F.col("p_over")[i].alias(f"p_{str(line).replace('.', '_')}") for i, line in enumerate(lines)]
    return df.select(*[c for c in df.columns if c != "p_over"], *columns)


def _tally(forecasts: DataFrame, lines, *keys: str) -> DataFrame:
    return scoring.tally_counts(forecasts, lines, keys)


# --- queries ------------------------------------------------------------------

Query = Callable[[Derived], DataFrame]
_queries: dict[str, Query] = {}


def register(query: Query) -> Query:
    """Register under the function's name; a trailing underscore avoids an import of that name."""
    _queries[query.__name__.rstrip("_")] = query
    return query


@register
def missing_result_filter(d: Derived) -> DataFrame:
    return d.raw.filter(~quality.without_result()).select("match_id", "file_name")


@register
def quarantine(d: Derived) -> DataFrame:
    bad = quality.quarantine(quality.judged(d.raw))
    return bad.select("match_id", "file_name", F.concat_ws("; ", "faults").alias("faults"))


@register
def parse_dates(d: Derived) -> DataFrame:
    return d.raw.select("match_id", "Date", parse_match_date("Date").alias("match_date"))


@register
def parse_counts(d: Derived) -> DataFrame:
    return d.raw.select("match_id", parse_count("HC").alias("home_count"), parse_count("AC").alias("away_count"))


@register
def contests_canonical(d: Derived) -> DataFrame:
    return quality.contests_from(d.judged)


@register
def constraint_violations(d: Derived) -> DataFrame:
    broken = quality.constraint_violations(quality.typed(d.raw))
    return broken.select("match_id", F.concat_ws("; ", "violations").alias("violations"))


@register
def row_quality(d: Derived) -> DataFrame:
    return quality.row_quality(quality.judged(d.raw))


@register
def unexpected_competitions(d: Derived) -> DataFrame:
    return quality.unexpected_competitions(contests_canonical(d), SEGMENTS)


@register
def duplicate_fixtures(d: Derived) -> DataFrame:
    return quality.duplicate_fixtures(d.contests)


@register
def unique_fixtures(d: Derived) -> DataFrame:
    return quality.unique_fixtures(d.contests, derived={"season": july_season("match_date")})


def _goal_source(d: Derived) -> DataFrame:
    return d.judged.select(
        "match_id",
        "match_date",
        "competition",
        "home_team",
        "away_team",
        parse_count("FTHG").alias("home_goals"),
        parse_count("FTAG").alias("away_goals"),
        season_label().alias("season"),
    )


@register
def goal_contests(d: Derived) -> DataFrame:
    completed = quality.unique_fixtures(quality.contests_from(d.judged))
    source = quality.unique_fixtures(_goal_source(d).where("match_date IS NOT NULL"))
    return quality.attach_goals(completed, source).select(
        "match_id", "home_goals", "away_goals", "season", "home_count", "away_count"
    )


@register
def excluded_rows(d: Derived) -> DataFrame:
    completed = quality.contests_from(d.judged)
    return quality.excluded_goal_rows(_goal_source(d), completed).select("match_id", "season")


def _season_files(d: Derived, rows: DataFrame, label: str) -> list[str]:
    """The raw rows as season files, one a season, every other season in another column order."""
    folder = os.path.join(run_folder(d.spark), f"{label}-{uuid.uuid4().hex}")
    columns = [c for c in rows.columns if c not in ("match_id", "file_name")]
    season = F.regexp_extract("file_name", "_([0-9]+)", 1)
    for odd, order in enumerate((columns, columns[::-1])):
        part = rows.withColumn("season", season).where(F.col("season").cast("int") % 2 == odd)
        writer = part.select(*order, "season").repartition("season").write.partitionBy("season")
        writer = writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.csv(os.path.join(folder, str(odd)))
    return [unquote(f) for f in d.spark.read.option("recursiveFileLookup", True).text(folder).inputFiles()]


@register
def season_scan(d: Derived) -> DataFrame:
    """The raw rows written as season files and loaded again."""
    loaded = load_contests(d.spark, _season_files(d, d.raw, "season-files"), strict=False)
    return loaded.contests.select("match_date", "competition", "home_team", "away_team", "home_count", "away_count")


@register
def season_goals(d: Derived) -> DataFrame:
    """Goals from season files of unique, completed fixtures, a set of files for each competition."""
    good = d.judged.where("status = 'loaded'").join(d.fixtures.select("match_id"), "match_id", "left_semi")
    clean = [F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.col("competition").alias("Div")]
    clean += [F.col(a).alias(b) for a, b in (("home_team", "HomeTeam"), ("away_team", "AwayTeam"))]
    rows = settle(good.select("match_id", "file_name", "competition", *clean, "FTHG", "FTAG", "HC", "AC"), "clean-rows")
    parts = []
    for segment in SEGMENTS:
        own = rows.where(F.col("competition") == segment).drop("competition")
        goals_, _, _ = load_goals(d.spark, _season_files(d, own, "goal-files"), segment)
        parts.append(goals_.select("match_date", "competition", "home_team", "away_team", "home_goals", "away_goals", "home_count", "away_count"))
    return functools.reduce(DataFrame.unionByName, parts)


@register
def file_manifest_(d: Derived) -> DataFrame:
    """Rows, dates and teams of each season file."""
    found = file_manifest(d.spark, _season_files(d, d.raw, "season-files"))
    return found.select(F.regexp_extract("file_path", "season=([0-9]+)", 1).alias("season"), "rows", "first_date", "last_date", "teams")


@register
def goal_outcomes(d: Derived) -> DataFrame:
    over, both = goals.outcomes(F.col("home_goals"), F.col("away_goals"))
    return d.contests.select("match_id", over.alias("over_2_5"), both.alias("btts_yes"))


@register
def report_json(d: Derived) -> DataFrame:
    return reports.as_json(total_metrics(d), ["competition"])


@register
def report_documents(d: Derived) -> DataFrame:
    """The documents of four analyses, written twice to one folder and read again: each model's rows and score."""
    folder = os.path.join(run_folder(d.spark), f"documents-{uuid.uuid4().hex}")
    total = documents.total_documents(d.contests, FIXTURE_START, d.ledger)
    made = {
        "total": total,
        "side": documents.side_documents(d.contests, FIXTURE_START, samples=20, ledger=d.ledger),
        "decay": documents.decay_documents(d.fixtures, FIXTURE_START, 20, d.fixture_ledger),
        "goals": documents.goal_documents(settle(d.goal_panel, "goal-panel"), FIXTURE_HOLDOUT, 20),
        "total again": total,
    }
    for name, report in made.items():
        documents.write_documents(report, folder, name.split()[0])
    score = "struct<n: bigint, mean_brier: double>"
    event = "struct<n: bigint, brier: double>"
    schema = (
        f"evaluation {score}, models map<string, struct<n: bigint, mean_brier: double, overall: {score}>>, "
        f"metrics map<string, struct<models: map<string, struct<targets: map<string, {event}>>>>>"
    )
    read = d.spark.read.text(folder).select("analysis", "competition", F.from_json("value", schema).alias("report"))
    goal = F.transform(
        F.map_entries(F.col("report.metrics")["all"]["models"]),
        lambda e: F.struct(e["key"].alias("model"), e["value"]["targets"]["over_2_5"]["n"].alias("n"), e["value"]["targets"]["over_2_5"]["brier"].alias("score")),
    )
    model = F.transform(
        F.map_entries("report.models"),
        lambda e: F.struct(
            e["key"].alias("model"),
            F.coalesce(e["value"]["overall"]["n"], e["value"]["n"]).alias("n"),
            F.coalesce(e["value"]["overall"]["mean_brier"], e["value"]["mean_brier"]).alias("score"),
        ),
    )
    whole = F.array(F.struct(F.lit("negative_binomial").alias("model"), F.col("report.evaluation.n").alias("n"), F.col("report.evaluation.mean_brier").alias("score")))
    found = F.when(F.col("analysis") == "total", whole).when(F.col("analysis") == "goals", goal).otherwise(model)
    return tidy(read.select("analysis", "competition", F.inline(found)))


@register
def observations_(d: Derived) -> DataFrame:
    return observations(d.contests).select("match_id", "venue", "team", "opponent", "count_for", "count_allowed")


@register
def daily_totals(d: Derived) -> DataFrame:
    return d.ledger.daily.select(
        "competition", "match_date", "venue", "team", "n", "count_for", "count_allowed", "sq_for", "sq_total"
    )


@register
def league_history(d: Derived) -> DataFrame:
    return league_state(d.ledger.daily, ["n", "home_sum", "away_sum", "home_sq", "away_sq", "total_sum", "total_sq"])


@register
def team_history(d: Derived) -> DataFrame:
    columns = ["n", "count_for", "count_allowed"]
    home = team_state(d.ledger.daily, "home", columns).withColumn("venue", F.lit("home"))
    away = team_state(d.ledger.daily, "away", columns).withColumn("venue", F.lit("away"))
    return home.unionByName(away)


@register
def decayed_history(d: Derived) -> DataFrame:
    columns = ["n", "count_for", "count_allowed"]
    parts = [
        team_state(d.fixture_ledger.daily, venue, [], columns).withColumn("venue", F.lit(venue)) for venue in ("home", "away")
    ]
    return tidy(parts[0].unionByName(parts[1]))


@register
def decayed_league_history(d: Derived) -> DataFrame:
    return tidy(league_state(d.fixture_ledger.daily, [], ["n", "home_sum", "away_sum"]), 5)


@register
def resumed_league_history(d: Derived) -> DataFrame:
    columns = ["n", "home_sum", "away_sum", "home_sq", "away_sq", "total_sum", "total_sq"]
    return _over(d.eras, lambda _, ledger: league_state(ledger.daily, columns))


@register
def resumed_team_history(d: Derived) -> DataFrame:
    columns = ["n", "count_for", "count_allowed"]
    at = lambda ledger, venue: team_state(ledger.daily, venue, columns).withColumn("venue", F.lit(venue))
    return _over(d.eras, lambda _, ledger: at(ledger, "home").unionByName(at(ledger, "away")))


@register
def resumed_decayed_history(d: Derived) -> DataFrame:
    columns = ["n", "count_for", "count_allowed"]
    at = lambda ledger, venue: team_state(ledger.daily, venue, [], columns).withColumn("venue", F.lit(venue))
    return tidy(_over(d.fixture_eras, lambda _, ledger: at(ledger, "home").unionByName(at(ledger, "away"))))


@register
def resumed_decayed_league_history(d: Derived) -> DataFrame:
    return tidy(_over(d.fixture_eras, lambda _, ledger: league_state(ledger.daily, [], ["n", "home_sum", "away_sum"])), 5)


@register
def resumed_event_rates(d: Derived) -> DataFrame:
    rates = _over(d.fixture_eras, goals.goal_rates).filter(F.col("match_date") >= F.lit(FIXTURE_START))
    return tidy(rates.select("match_id", "over_rate", "btts_rate"))


@register
def resumed_rho_bounds(d: Derived) -> DataFrame:
    parts, carry, ends = [], None, (None, *ERA_ENDS, None)
    for after, end in zip(ends[:-1], ends[1:]):
        rows = rho_ops.rate_rows(_between(d.goal_rates, after, end))
        parts.append(rho_ops.rho_bounds(rows, carry))
        if end is not None:
            carry = settle(snapshots.coefficient_carry(rho_ops.coefficient_days(rows), end, carry), "coefficient-carry")
    bounds = functools.reduce(DataFrame.unionByName, parts)
    return tidy(bounds.select("competition", "model", "match_date", "n_history", "low", "high"))


@register
def resumed_team_walkforward(d: Derived) -> DataFrame:
    rows = sides.long_forecasts(_over(d.eras, lambda contests, ledger: sides.side_panel(contests, ledger, FIXTURE_START)))
    return tidy(
        by_line(rows.select("match_id", "venue", "team", "model", "actual", "expected", "dispersion", "p_over"), SIDE_LINES)
    )


@register
def dispersion(d: Derived) -> DataFrame:
    past = league_state(d.ledger.daily, ["n", "home_sum", "away_sum", "home_sq", "away_sq", "total_sum", "total_sq"])
    c = lambda name: F.col(f"past_{name}")
    return tidy(
        past.select(
            "competition",
            "match_date",
            moment_dispersion(c("n"), c("total_sum"), c("total_sq")).alias("total"),
            moment_dispersion(c("n"), c("home_sum"), c("home_sq")).alias("home"),
            moment_dispersion(c("n"), c("away_sum"), c("away_sq")).alias("away"),
            moment_dispersion(c("n") * 2, c("home_sum") + c("away_sum"), c("home_sq") + c("away_sq")).alias("pooled"),
        )
    )


@register
def time_weight_(d: Derived) -> DataFrame:
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("match_date"))
    return tidy(d.contests.select("match_id", time_weight(age).alias("weight")))


@register
def total_walkforward(d: Derived) -> DataFrame:
    forecasts = totals.total_forecasts(d.contests, d.ledger, FIXTURE_START)
    return tidy(
        by_line(
            forecasts.select("match_id", "match_date", "competition", "actual", "expected", "dispersion", "p_over"),
            TOTAL_LINES,
        )
    )


@register
def total_metrics(d: Derived) -> DataFrame:
    forecasts = totals.total_forecasts(d.contests, d.ledger, FIXTURE_START)
    return tidy(scoring.count_metrics(_tally(forecasts, TOTAL_LINES, "competition"), TOTAL_LINES, ["competition"]))


@register
def total_line_metrics(d: Derived) -> DataFrame:
    forecasts = totals.total_forecasts(d.contests, d.ledger, FIXTURE_START)
    return tidy(scoring.line_metrics(_tally(forecasts, TOTAL_LINES, "competition"), TOTAL_LINES, ["competition"], True))


@register
def poisson_vs_nb(d: Derived) -> DataFrame:
    forecasts = totals.total_forecasts(d.contests, d.ledger, FIXTURE_START, with_poisson=True)
    return tidy(scoring.count_metrics(_tally(forecasts, TOTAL_LINES, "model"), TOTAL_LINES, ["model"]))


def _tails(d: Derived, alpha: Column) -> DataFrame:
    state = totals.total_state(d.ledger)
    tails = [
        F.struct(F.lit(line).alias("line"), over_probability(F.col("expected"), line, alpha).alias("p_over"))
        for line in (0.5, *TOTAL_LINES)
    ]
    return tidy(state.select("competition", "match_date", F.inline_outer(F.array(*tails))))


@register
def poisson_over(d: Derived) -> DataFrame:
    return _tails(d, F.lit(0.0))


@register
def nb_over(d: Derived) -> DataFrame:
    return _tails(d, F.col("dispersion"))


@register
def long_run_over(d: Derived) -> DataFrame:
    """Tails of the sum of ``LONG_RUN`` contests like the next one."""
    state = totals.total_state(d.ledger)
    mean, dispersion = F.col("expected") * LONG_RUN, F.col("dispersion") / LONG_RUN
    tails = [F.struct(F.lit(line).alias("line"), over_probability(mean, line, dispersion).alias("p_over")) for line in LONG_RUN_LINES]
    return tidy(state.select("competition", "match_date", F.inline_outer(F.array(*tails))))


@register
def nb_nll(d: Derived) -> DataFrame:
    forecasts = totals.total_forecasts(d.contests, d.ledger, FIXTURE_START)
    k, mu = F.col("actual"), F.col("expected")
    return tidy(
        forecasts.select(
            "match_id",
            negative_log_loss(k, mu, F.col("dispersion")).alias("nb_nll"),
            negative_log_loss(k, mu).alias("poisson_nll"),
        )
    )


@register
def smoothed_rates(d: Derived) -> DataFrame:
    rows = sides.with_state(
        d.contests.select("match_id", "match_date", "competition", "home_team", "away_team"),
        d.ledger,
        ["n", "count_for", "count_allowed"],
        ["n", "home_sum", "away_sum"],
        start=FIXTURE_START,
    ).filter(F.col("league_past_n") > 0)
    c = F.col

    def side(venue: str, other: str) -> Column:
        league = F.try_divide(f"league_past_{venue}_sum", "league_past_n")
        return F.struct(
            F.lit(venue).alias("venue"),
            smoothed(c(f"{venue}_past_count_for"), c(f"{venue}_past_n"), league).alias("attack"),
            smoothed(c(f"{other}_past_count_allowed"), c(f"{other}_past_n"), league).alias("defence"),
        )

    return tidy(rows.select("match_id", F.inline_outer(F.array(side("home", "away"), side("away", "home")))))


@register
def team_walkforward(d: Derived) -> DataFrame:
    rows = sides.long_forecasts(d.side_panel)
    return tidy(
        by_line(rows.select("match_id", "venue", "team", "model", "actual", "expected", "dispersion", "p_over"), SIDE_LINES)
    )


@register
def team_metrics(d: Derived) -> DataFrame:
    keys = ["competition", "model"]
    return tidy(scoring.count_metrics(_tally(sides.long_forecasts(d.side_panel), SIDE_LINES, *keys), SIDE_LINES, keys))


@register
def team_line_metrics(d: Derived) -> DataFrame:
    keys = ["competition", "model"]
    return tidy(scoring.line_metrics(_tally(sides.long_forecasts(d.side_panel), SIDE_LINES, *keys), SIDE_LINES, keys))


@register
def team_metrics_by_venue(d: Derived) -> DataFrame:
    fine = _tally(sides.long_forecasts(d.side_panel), SIDE_LINES, "model", "venue")
    folded = scoring.refold_sets(fine, [["model"], ["model", "venue"]], ["model", "venue"])
    return tidy(scoring.count_metrics(folded, SIDE_LINES, ["model", "venue"]))


@register
def metric_differences(d: Derived) -> DataFrame:
    keys = ["competition", "model"]
    metrics = scoring.count_metrics(_tally(sides.long_forecasts(d.side_panel), SIDE_LINES, *keys), SIDE_LINES, keys)
    return tidy(scoring.metric_differences(metrics, *SIDE_MODELS, ["competition"]))


@register
def prior_sensitivity(d: Derived) -> DataFrame:
    panel = sides.side_panel(d.contests, d.ledger, FIXTURE_START, PRIOR_CHOICES)
    return tidy(reports.prior_sensitivity(sides.long_forecasts(panel), ["competition"]))


@register
def invalid_scores(d: Derived) -> DataFrame:
    """Forecasts of every model without a valid distribution; those of counts from the first date on,
    where early means may be zero."""
    first = dt.date(1900, 1, 1)
    counts = [
        totals.total_forecasts(d.contests, d.ledger, first),
        sides.long_forecasts(sides.side_panel(d.contests, d.ledger, first)),
        sides.long_forecasts(sides.decay_panel(d.fixtures, d.fixture_ledger, first)),
    ]
    parts = [df.select("model", quality.scorable(df).alias("valid")) for df in counts]
    parts.append(d.goal_forecasts.select("model", F.col("p").isNotNull().alias("valid")))
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("forecasts"), F.count_if(~F.col("valid")).alias("unscored"))


@register
def paired_deltas(d: Derived) -> DataFrame:
    deltas = pairing.side_deltas(pairing.panel_pair(d.side_panel, SIDE_MODELS, *SIDE_MODELS))
    return tidy(pairing.fixture_deltas(deltas))


@register
def aligned_deltas(d: Derived) -> DataFrame:
    """The same differences from long forecasts, aligned by key instead of taken from a panel."""
    rows = sides.long_forecasts(d.side_panel)
    pairs = pairing.align(rows, *SIDE_MODELS, ["match_id", "venue"])
    return tidy(pairing.side_deltas(pairs).select("match_id", "venue", "mae_delta", "brier_delta"))


@register
def cohort_mismatch(d: Derived) -> DataFrame:
    """Observations of the side models that the common decay cohort leaves out."""
    columns = ["model", "match_id", "venue", "actual"]
    wide = sides.long_forecasts(sides.side_panel(d.fixtures, d.fixture_ledger, FIXTURE_START)).select(*columns)
    common = sides.long_forecasts(d.decay_panel).select(*columns)
    return pairing.cohort_mismatch(wide.unionByName(common), ["team_opponent", "retained"], ["match_id", "venue"])


@register
def eligible_fixtures(d: Derived) -> DataFrame:
    rows = sides.eligible(sides.decay_state(d.fixtures, d.fixture_ledger, FIXTURE_START))
    return rows.select(
        "match_id",
        (F.col("league_past_n") * 2).alias("league_observations"),
        F.col("home_past_n").alias("home_contests"),
        F.col("away_past_n").alias("away_contests"),
    )


@register
def decay_predictions(d: Derived) -> DataFrame:
    rows = sides.long_forecasts(d.decay_panel)
    return tidy(by_line(rows.select("match_id", "venue", "model", "expected", "dispersion", "p_over"), SIDE_LINES))


@register
def decay_metrics(d: Derived) -> DataFrame:
    return tidy(scoring.count_metrics(_tally(sides.long_forecasts(d.decay_panel), SIDE_LINES, "model"), SIDE_LINES, ["model"]))


@register
def block_totals(d: Derived) -> DataFrame:
    return tidy(pairing.block_totals(reports.decay_deltas(d.decay_panel), ["competition", "pair"]), 5)


@register
def block_bootstrap(d: Derived) -> DataFrame:
    return tidy(reports.decay_intervals(d.decay_panel))


@register
def win_counts(d: Derived) -> DataFrame:
    return reports.decay_wins(sides.long_forecasts(d.decay_panel))


@register
def iid_bootstrap(d: Derived) -> DataFrame:
    deltas = pairing.side_deltas(pairing.panel_pair(d.side_panel, SIDE_MODELS, *SIDE_MODELS))
    fixtures = pairing.fixture_deltas(deltas)
    return tidy(resample.iid_bootstrap(fixtures, pairing.CONTEST_VALUE))


@register
def iid_bootstrap_poisson(d: Derived) -> DataFrame:
    deltas = pairing.side_deltas(pairing.panel_pair(d.side_panel, SIDE_MODELS, *SIDE_MODELS))
    fixtures = pairing.fixture_deltas(deltas)
    return tidy(resample.iid_bootstrap(fixtures, pairing.CONTEST_VALUE, method="poisson"))


@register
def event_rate_forecast(d: Derived) -> DataFrame:
    return tidy(d.goal_rates.filter(F.col("match_date") >= F.lit(FIXTURE_START)).select("match_id", "over_rate", "btts_rate"))


@register
def goal_rates(d: Derived) -> DataFrame:
    return tidy(rho_ops.rate_rows(d.goal_rates).select("match_id", "model", "home_rate", "away_rate"))


@register
def rho_history(d: Derived) -> DataFrame:
    rows = rho_ops.rate_rows(d.goal_rates).filter(F.col("c").isNotNull())
    return tidy(rows.select("match_id", "model", "c"))


@register
def rho_bounds(d: Derived) -> DataFrame:
    bounds = rho_ops.rho_bounds(rho_ops.rate_rows(d.goal_rates))
    return tidy(bounds.select("competition", "model", "match_date", "n_history", "low", "high"))


@register
def rho_by_date(d: Derived) -> DataFrame:
    return tidy(d.rho.select("competition", "model", "match_date", "n_history", "rho"))


@register
def dc_probabilities(d: Derived) -> DataFrame:
    rows = rho_ops.rate_rows(d.goal_rates)
    over, both = dixon_coles_events(F.col("home_rate"), F.col("away_rate"), F.lit(-0.1))
    return tidy(rows.select("match_id", "model", over.alias("over_2_5"), both.alias("btts_yes")))


@register
def goal_forecasts(d: Derived) -> DataFrame:
    return tidy(d.goal_forecasts.select("match_id", "model", "target", "p", "y"))


@register
def goal_metrics(d: Derived) -> DataFrame:
    keys = ["model", "target"]
    return tidy(scoring.event_metrics(scoring.tally_events(d.goal_forecasts, keys), keys))


@register
def calibration_bins(d: Derived) -> DataFrame:
    keys = ["model", "target"]
    return tidy(scoring.calibration_bins(settle(scoring.tally_events(d.goal_forecasts, keys), "tally"), keys))


@register
def window_metrics(d: Derived) -> DataFrame:
    keys = ["window", "model", "target"]
    tally = scoring.tally_events(reports.windowed(d.goal_forecasts, FIXTURE_HOLDOUT), keys)
    return tidy(scoring.event_metrics(tally, keys))


@register
def seasonal_metrics(d: Derived) -> DataFrame:
    keys = ["season", "model", "target"]
    return tidy(scoring.event_metrics(scoring.tally_events(d.goal_forecasts, keys), keys))


@register
def rho_summary(d: Derived) -> DataFrame:
    return tidy(reports.rho_summary(d.goal_panel))


@register
def goal_block_bootstrap(d: Derived) -> DataFrame:
    return tidy(reports.goal_intervals(d.goal_panel, FIXTURE_HOLDOUT))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(derived(spark, folder))

    return {name: bind(query) for name, query in _queries.items()}
