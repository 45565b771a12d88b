"""Date-derived columns: day numbers, blocks, windows, seasons, decay weights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretally.contracts import BLOCK_DAYS, HALF_LIFE_DAYS, ORDINAL_OF_1970


def day_number(date_col: Column | str) -> Column:
    return F.unix_date(date_col)


def block_id(date_col: Column | str, days: int = BLOCK_DAYS) -> Column:
    """Calendar block counted from 0001-01-01, the same in every process."""
    return F.floor((F.unix_date(date_col) + F.lit(ORDINAL_OF_1970)) / F.lit(days)).cast("bigint")


def time_weight(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ** (age / half_life); a negative age has no weight and fails the query."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    weight = F.pow(F.lit(0.5), age_days.cast("double") / F.lit(float(half_life)))
    return F.when(age_days >= 0, weight).otherwise(F.raise_error(F.lit("age must not be negative")).cast("double"))


def evaluation_windows(date_col: Column | str, holdout_start: dt.date) -> Column:
    """Array of window labels a date belongs to; every date is in 'all'."""
    date_col = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.array(
        F.lit("all"),
        F.when(date_col < F.lit(holdout_start), F.lit("development")).otherwise(F.lit("latest")),
    )


def july_season(date_col: Column | str) -> Column:
    """Four-digit label of the July-to-June year, for logs without source files."""
    first = F.year(F.add_months(date_col, -6))
    return F.format_string("%02d%02d", first % 100, (first + 1) % 100)
