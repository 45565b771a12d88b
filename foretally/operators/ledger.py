"""Point-in-time state: everything known about a league or a side before a date.

The contest log is first folded to one row per (competition, date, venue, team) — a
map-side combinable aggregate, so a team or competition that owns a large share of the log
is reduced before any shuffle. Windows then run over that daily ledger, where one partition
can never hold more rows than there are calendar days. Every frame ends one day before the
row's own date, so results of the same date are never visible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import HALF_LIFE_DAYS
from foretally.operators.reshape import observations
from foretally.workspace import settle

# Decay weights are taken relative to a fixed day, so that a decayed sum is an ordinary
# prefix sum. 2**900 stays clear of overflow; half-lives too short for that use eras.
ANCHOR_DAY = 10957  # 2000-01-01
_SAFE_HALVINGS = 900
_LONG_SPAN_DAYS = 75_000
CARRIED = "carried"
_AGED = "aged_"


@dataclass(frozen=True)
class Ledger:
    """The settled daily table with its exact row counts, which bound every state table.

    A ledger that resumes from a snapshot (see ``snapshots.py``) also has ``carried`` rows: the totals of all earlier
    dates, at the snapshot's date. They feed every window and are no state of their own.

    ``rows`` bounds team state, ``dates`` (competition and date pairs) bounds league state.
    """

    daily: DataFrame
    rows: int
    dates: int


def daily_totals(contests: DataFrame) -> DataFrame:
    """One row per (competition, date, venue, team) with the sums every feature needs."""
    goals = "home_goals" in contests.columns
    sums = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("count_for").cast("bigint")).alias("count_for"),
        F.sum(F.col("count_allowed").cast("bigint")).alias("count_allowed"),
        F.sum(F.col("count_for").cast("bigint") * F.col("count_for")).alias("sq_for"),
        F.sum((F.col("count_for") + F.col("count_allowed")).cast("bigint") * (F.col("count_for") + F.col("count_allowed"))).alias("sq_total"),
    ]
    if goals:
        sums += [
            F.sum(F.col("goals_for").cast("bigint")).alias("goals_for"),
            F.sum(F.col("goals_allowed").cast("bigint")).alias("goals_allowed"),
            F.count_if(F.col("goals_for") + F.col("goals_allowed") >= 3).alias("over_n"),
            F.count_if((F.col("goals_for") > 0) & (F.col("goals_allowed") > 0)).alias("btts_n"),
        ]
    return observations(contests).groupBy("competition", "match_date", "venue", "team").agg(*sums)


def build_ledger(contests: DataFrame) -> Ledger:
    return measured(settle(daily_totals(contests), "ledger"))


def measured(daily: DataFrame) -> Ledger:
    """The ledger of a written daily table."""
    sizes = daily.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("competition", "match_date").alias("dates")
    ).head()
    return Ledger(daily, sizes.rows, sizes.dates)


def aged(column: str, half_life: float) -> str:
    """Name of a sum whose carried rows hold the decayed total of earlier dates."""
    return f"{_AGED}{str(float(half_life)).replace('.', '_')}_{column}"


def league_daily(daily: DataFrame) -> DataFrame:
    """Daily ledger folded to one row per (competition, date)."""

    def at(venue: str, column: str, name: str) -> Column:
        return F.expr(f"sum(IF(venue = '{venue}', {column}, 0L)) AS {name}")

    sums = [
        at("home", "n", "n"),
        at("home", "count_for", "home_sum"),
        at("away", "count_for", "away_sum"),
        at("home", "sq_for", "home_sq"),
        at("away", "sq_for", "away_sq"),
        at("home", "sq_total", "total_sq"),
        F.expr("sum(count_for) AS total_sum"),
    ]
    if "goals_for" in daily.columns:
        sums += [
            at("home", "goals_for", "home_goals_sum"),
            at("away", "goals_for", "away_goals_sum"),
            at("home", "over_n", "over_n"),
            at("home", "btts_n", "btts_n"),
        ]
    if CARRIED in daily.columns:
        sums.append(F.bool_or(CARRIED).alias(CARRIED))
        league = {"n": ("home", "n"), "home_sum": ("home", "count_for"), "away_sum": ("away", "count_for")}
        if "goals_for" in daily.columns:
            league |= {"home_goals_sum": ("home", "goals_for"), "away_goals_sum": ("away", "goals_for")}
        for prefix in [c.removesuffix("count_for") for c in daily.columns if c.startswith(_AGED) and c.endswith("count_for")]:
            sums += [at(venue, prefix + c, prefix + name) for name, (venue, c) in league.items()]
    return daily.groupBy("competition", "match_date").agg(*sums)


def _strict_frame(keys: Sequence[str]) -> str:
    return (
        f"(PARTITION BY {', '.join(keys)} ORDER BY unix_date(match_date) "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def strict_past(value: str, keys: Sequence[str]) -> Column:
    """Sum of the SQL expression ``value`` over strictly earlier dates of the same key; 0 where there are none."""
    return F.expr(f"coalesce(sum({value}) OVER {_strict_frame(keys)}, 0L)")


def strict_past_extreme(value: str, keys: Sequence[str], largest: bool) -> Column:
    """Running maximum (or minimum) over strictly earlier dates; NULL where there are none."""
    return F.expr(f"{'max' if largest else 'min'}({value}) OVER {_strict_frame(keys)}")


def decayed_past(value: str, keys: Sequence[str], half_life: float = HALF_LIFE_DAYS) -> Column:
    """Sum over strictly earlier dates of ``value * 0.5 ** (age / half_life)``.

    ``0.5 ** ((d - d_i) / H)`` factors into a part of the earlier row and a part of the
    current row, so the decayed sum is a prefix sum scaled at the end. When the half-life is
    so short that the two factors would leave the double range, dates are cut into eras of
    500 half-lives: the sum within the era is added to what the era before it still
    contributes (anything older weighs below 2**-500).
    """
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    day, h = "unix_date(match_date)", f"{float(half_life)!r}D"
    if _SAFE_HALVINGS * half_life >= _LONG_SPAN_DAYS:
        scale = f"pow(2D, ({day} - {ANCHOR_DAY}) / {h})"
        return F.expr(f"coalesce(sum(({value}) * {scale}) OVER {_strict_frame(keys)}, 0D) / {scale}")
    era_days = max(1, int(500 * half_life))
    era = f"floor({day} / {era_days})"
    scale = f"pow(2D, ({day} - {era} * {era_days}) / {h})"
    shrunk = f"pow(2D, ({day} - ({era} + 1) * {era_days}) / {h})"
    before = f"(PARTITION BY {', '.join(keys)} ORDER BY {era} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    own = f"coalesce(sum(({value}) * {scale}) OVER {_strict_frame([*keys, era])}, 0D)"
    carried = f"coalesce(sum(({value}) * {shrunk}) OVER {before}, 0D)"
    return F.expr(f"({own} + {carried}) / {scale}")


def _state(daily: DataFrame, columns: Sequence[str], decayed: Sequence[str], keys: Sequence[str], half_life: float) -> list[Column]:
    def decaying(c: str) -> str:
        if CARRIED not in daily.columns:
            return c
        if aged(c, half_life) not in daily.columns:
            raise ValueError(f"the snapshot has no {c} with a half-life of {half_life} days")
        return aged(c, half_life)

    picked = [strict_past(c, keys).alias(f"past_{c}") for c in columns]
    return picked + [decayed_past(decaying(c), keys, half_life).alias(f"decayed_{c}") for c in decayed]


def _own_dates(daily: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns (windows among them) of the rows that aren't carried; carried rows go after the windows have seen them."""
    if CARRIED not in daily.columns:
        return daily.select(*columns)
    return daily.select(*columns, CARRIED).where(~F.col(CARRIED)).drop(CARRIED)


def team_state(
    daily: DataFrame,
    venue: str,
    columns: Sequence[str],
    decayed: Sequence[str] = (),
    half_life: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """Strict-past sums per team in one venue role, one row per date the team plays.

    Equal-weight sums keep their names behind ``past_``; decayed sums are behind ``decayed_``.
    """
    own = daily.filter(F.col("venue") == venue)
    return _own_dates(own, "competition", "match_date", "team", *_state(own, columns, decayed, ["competition", "team"], half_life))


def league_state(
    daily: DataFrame, columns: Sequence[str], decayed: Sequence[str] = (), half_life: float = HALF_LIFE_DAYS
) -> DataFrame:
    """Strict-past league sums, one row per (competition, date)."""
    league = league_daily(daily)
    return _own_dates(league, "competition", "match_date", *_state(league, columns, decayed, ["competition"], half_life))


def prefixed(df: DataFrame, prefix: str, keep: dict[str, str]) -> DataFrame:
    """Rename state columns with a role prefix; ``keep`` maps key columns to their new names."""
    return df.select(
        *[F.col(old).alias(new) for old, new in keep.items()],
        *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keep],
    )
