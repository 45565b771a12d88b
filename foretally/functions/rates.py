"""Expected-count models as column expressions over point-in-time sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretally.contracts import LEAGUE_RATE_FLOOR, PRIOR_MATCHES


def _positive(prior) -> Column:
    if isinstance(prior, Column):
        return prior
    if prior <= 0:
        raise ValueError("prior_matches must be greater than zero")
    return F.lit(float(prior))


def smoothed(total: Column, matches: Column, league_mean: Column, prior=PRIOR_MATCHES) -> Column:
    """History blended with ``prior`` matches at the league mean."""
    k = _positive(prior)
    return (total + k * league_mean) / (matches + k)


def arithmetic_rate(scored, n, conceded, opponent_n, league_mean, prior=PRIOR_MATCHES) -> Column:
    attack = smoothed(scored, n, league_mean, prior)
    defence = smoothed(conceded, opponent_n, league_mean, prior)
    return (attack + defence) / 2


def multiplicative_rate(scored, n, conceded, opponent_n, league_mean, prior=PRIOR_MATCHES) -> Column:
    attack = smoothed(scored, n, league_mean, prior)
    defence = smoothed(conceded, opponent_n, league_mean, prior)
    return F.try_divide(attack * defence, league_mean)


def smoothed_league(total: Column, matches: Column, prior=PRIOR_MATCHES) -> Column:
    """League rate pulled towards one count per match."""
    k = _positive(prior)
    return (total + k) / (matches + k)


def floored_league(total: Column, matches: Column) -> Column:
    """Plain league mean with a tiny positive floor."""
    return F.greatest(F.lit(LEAGUE_RATE_FLOOR), F.try_divide(total, matches))


def event_rate(events: Column, matches: Column) -> Column:
    """Event frequency under a uniform Beta prior."""
    return (events + 1) / (matches + 2)
