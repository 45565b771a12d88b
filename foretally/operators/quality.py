"""Data quality: which rows of a raw season table become contests, and why others do not."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import COMPETITION_CODE, FIXTURE_KEY
from foretally.functions.parsing import is_blank, is_too_large, parse_count, parse_match_date, stripped


def without_result(home: str = "HC", away: str = "AC") -> Column:
    """Both counts blank: a contest that has no result yet."""
    return is_blank(home) & is_blank(away)


def typed(raw: DataFrame, home: str = "HC", away: str = "AC") -> DataFrame:
    """Add the canonical columns to raw rows; cells that do not parse become NULL.

    Cells are trimmed in a projection of their own, because parsing looks at each several times.
    """
    trimmed = {f"_{c}": stripped(c) for c in ("Date", home, away)}
    return (
        raw.withColumns(trimmed)
        .withColumns(
            {
                "match_date": parse_match_date("_Date", trimmed=True),
                "competition": stripped("Div"),
                "home_team": stripped("HomeTeam"),
                "away_team": stripped("AwayTeam"),
                "home_count": parse_count(f"_{home}", trimmed=True),
                "away_count": parse_count(f"_{away}", trimmed=True),
            }
        )
        .drop(*trimmed)
    )


def _count_reason(cell: str, parsed: str) -> Column:
    why = (
        F.when(is_blank(cell), F.lit("count is missing"))
        .when(is_too_large(cell), F.lit("count is above 2147483647"))
        .otherwise(F.lit("count is not a non-negative integer"))
    )
    return F.when(F.col(parsed).isNull(), why)


def _is_faulty() -> Column:
    """True where ``row_faults`` names a fault: one test for each, without the texts."""
    tests = [F.col("match_date").isNull(), *[F.col(c) == "" for c in ("competition", "home_team", "away_team")]]
    tests += [F.lower("home_team") == F.lower("away_team"), F.col("home_count").isNull(), F.col("away_count").isNull()]
    return functools.reduce(Column.__or__, tests)


def row_faults(home: str = "HC", away: str = "AC") -> Column:
    """Reasons why a completed raw row is not a contest, in a fixed order; empty for a good row."""
    return F.array_compact(
        F.array(
            F.when(F.col("match_date").isNull(), F.lit("unsupported match date")),
            F.when(F.col("competition") == "", F.lit("competition must not be empty")),
            F.when(F.col("home_team") == "", F.lit("home_team must not be empty")),
            F.when(F.col("away_team") == "", F.lit("away_team must not be empty")),
            F.when(
                F.lower("home_team") == F.lower("away_team"), F.lit("home_team and away_team must be different")
            ),
            F.concat(F.lit("home "), _count_reason(home, "home_count")),
            F.concat(F.lit("away "), _count_reason(away, "away_count")),
        )
    )


def judged(raw: DataFrame) -> DataFrame:
    """Typed rows with ``status``: 'no_result', 'quarantined' or 'loaded', and the fault list.

    The status doesn't read the list, so a filter on it parses no cell for the sake of a reason.
    """
    rows = typed(raw).withColumn("faults", row_faults())
    status = (
        F.when(without_result(), F.lit("no_result"))
        .when(_is_faulty(), F.lit("quarantined"))
        .otherwise(F.lit("loaded"))
    )
    return rows.withColumn("status", status)


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "quarantined")


def contests_from(rows: DataFrame) -> DataFrame:
    extra = [c for c in ("home_goals", "away_goals", "season") if c in rows.columns]
    return rows.filter(F.col("status") == "loaded").select(
        "match_id", "match_date", "competition", "home_team", "away_team", "home_count", "away_count", *extra
    )


def row_quality(rows: DataFrame, by: Sequence[str] = ("file_name",)) -> DataFrame:
    """Rows read, loaded, without result and quarantined: per file and (file NULL) overall."""
    return rows.rollup(*by).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("status") == "loaded").alias("rows_loaded"),
        F.count_if(F.col("status") == "no_result").alias("rows_without_result"),
        F.count_if(F.col("status") == "quarantined").alias("rows_quarantined"),
    )


def constraint_violations(contests: DataFrame) -> DataFrame:
    """Typed contests that break a row constraint, with the broken rules."""
    rules = {
        "match_date must be a date": F.col("match_date").isNull(),
        "competition must not be empty": is_blank("competition"),
        "home_team must not be empty": is_blank("home_team"),
        "away_team must not be empty": is_blank("away_team"),
        "home_team and away_team must be different": F.lower(stripped("home_team")) == F.lower(stripped("away_team")),
        "home_count must be a non-negative integer": F.col("home_count").isNull() | (F.col("home_count") < 0),
        "away_count must be a non-negative integer": F.col("away_count").isNull() | (F.col("away_count") < 0),
    }
    for side in ("home", "away"):
        if f"{side}_goals" in contests.columns:
            goals = F.col(f"{side}_goals")
            rules[f"{side}_goals must be a non-negative integer"] = goals.isNull() | (goals < 0)
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]))
    return contests.withColumn("violations", broken).filter(F.size("violations") > 0)


def unexpected_competitions(contests: DataFrame, expected: Iterable[str] = (COMPETITION_CODE,)) -> DataFrame:
    return contests.filter(~F.col("competition").isin(*expected)).select("competition").distinct()


def require_competitions(contests: DataFrame, expected: Sequence[str] = (COMPETITION_CODE,)) -> None:
    """Raise when other competitions are present; the message names them all."""
    found = [r[0] for r in unexpected_competitions(contests, expected).orderBy("competition").collect()]
    if found:
        raise ValueError(f"supports {', '.join(expected)} rows only; found: {', '.join(found)}")


def duplicate_fixtures(contests: DataFrame, key: Sequence[str] = FIXTURE_KEY) -> DataFrame:
    """Fixture keys that occur more than once, with their number of rows."""
    return contests.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique_fixtures(contests: DataFrame, key: Sequence[str] = FIXTURE_KEY) -> None:
    if not duplicate_fixtures(contests, key).isEmpty():
        raise ValueError("duplicate fixture; supply non-overlapping season files")


def unique_fixtures(
    contests: DataFrame, key: Sequence[str] = FIXTURE_KEY, derived: Mapping[str, Column] | None = None
) -> DataFrame:
    """Keep the row with the smallest match_id of each fixture key.

    Numbers are kept by a ``min_by`` each, whose buffers fit a hash aggregate: copies of one fixture
    shrink to one row per task before the shuffle, and nothing is sorted. ``derived`` gives columns that
    follow from the kept ones; a text column that doesn't would bring the sort back.
    """
    derived = derived or {}
    rest = [c for c in contests.columns if c not in key and c != "match_id" and c not in derived]
    kept = [F.min_by(c, "match_id").alias(c) for c in rest]
    grouped = contests.groupBy(*key).agg(F.min("match_id").alias("match_id"), *kept)
    return grouped.withColumns(dict(derived)).select(*contests.columns) if derived else grouped.select(*contests.columns)


def require_rows(df: DataFrame, message: str = "no predictions are available for evaluation") -> None:
    if df.isEmpty():
        raise ValueError(message)


def attach_goals(contests: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals onto the completed contests, by fixture key."""
    return contests.join(goals.select(*FIXTURE_KEY, "home_goals", "away_goals", "season"), list(FIXTURE_KEY), "inner")


def joined_goals(goals: DataFrame, contests: DataFrame) -> DataFrame:
    """Every goal row with its completed contest, if it has one: one join for matched and excluded rows."""
    own = contests.select(*FIXTURE_KEY, F.col("match_id").alias("contest_id"), "home_count", "away_count")
    return goals.join(own, list(FIXTURE_KEY), "left")


def matched(joined: DataFrame) -> DataFrame:
    """Contests with goals out of ``joined_goals``."""
    return joined.where(F.col("contest_id").isNotNull()).select(
        F.col("contest_id").alias("match_id"), *FIXTURE_KEY, "home_count", "away_count", "home_goals", "away_goals", "season"
    )


def unmatched(joined: DataFrame) -> DataFrame:
    """Goal rows without a completed contest out of ``joined_goals``."""
    return joined.where(F.col("contest_id").isNull()).drop("contest_id", "home_count", "away_count")


def excluded_goal_rows(goals: DataFrame, contests: DataFrame) -> DataFrame:
    """Goal rows that have no completed contest."""
    return goals.join(contests.select(*FIXTURE_KEY), list(FIXTURE_KEY), "left_anti")


def scorable(forecasts: DataFrame) -> Column:
    """True where the mean and the dispersion of a forecast define a distribution."""
    mu, alpha = F.col("expected"), F.col("dispersion")
    return F.coalesce((mu > 0) & (alpha >= 0) & ~F.isnan(mu) & ~F.isnan(alpha), F.lit(False))
