"""Running histories that resume: a snapshot holds what all dates up to one day leave behind.

A snapshot is one carry row for each (competition, venue, team): the sums of all dates up to and including
``through``, and for every half-life the sums decayed to that day. A later batch of contests is folded to its own
daily ledger, and the carry rows join it as rows of the snapshot's day. Every strict-past window then sees the
whole history at its first row, so all plans over a ledger work on a resumed one unchanged, and read only the
batch and one row a team. The running extremes of low-score coefficients carry in the same way.

Snapshots lie side by side, a folder for each day. Writing one again replaces only its own folder, and a
folder counts once its write has ended, so a lost run is repeated from the snapshot before it.

Batches go forward in time: a contest on or before the day of the snapshot that it resumes from fails the job,
with its competition and date. Nulls: a batch is a valid contest log. An empty batch carries the old totals on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.contracts import HALF_LIFE_DAYS
from foretally.operators.ledger import CARRIED, Ledger, aged, build_ledger, daily_totals, measured
from foretally.workspace import settle

SIDE_KEYS = ["competition", "venue", "team"]
MODEL_KEYS = ["competition", "model"]
_SUMS = ["n", "count_for", "count_allowed", "sq_for", "sq_total"]
_GOAL_SUMS = ["goals_for", "goals_allowed", "over_n", "btts_n"]
_DECAYING = ["n", "count_for", "count_allowed", "goals_for", "goals_allowed"]


def after(contests: DataFrame, through: dt.date) -> DataFrame:
    """``contests``, each proven to be later than ``through`` when it is read."""
    late = F.format_string("%s: a contest on %s, but the history is closed through %s", "competition", F.col("match_date").cast("string"), F.lit(str(through)))
    return contests.withColumn("match_date", F.when(F.col("match_date") > F.lit(through), F.col("match_date")).otherwise(F.raise_error(late).cast("date")))


def carry(daily: DataFrame, through: dt.date, half_lives: Sequence[float] = (HALF_LIFE_DAYS,)) -> DataFrame:
    """One row for each (competition, venue, team) with its totals through a day, from a ledger that ends by then.

    The ledger may itself resume: its carried rows count like any other, their decayed sums from their own day.
    """
    resumed = CARRIED in daily.columns
    present = [c for c in [*_SUMS, *_GOAL_SUMS] if c in daily.columns]
    age = F.datediff(F.lit(through), F.col("match_date"))
    in_time = F.when(age >= 0, age).otherwise(F.raise_error(F.lit(f"the ledger goes beyond {through}")).cast("int"))

    def decayed(column: str, half_life: float) -> Column:
        if half_life <= 0:
            raise ValueError("half_life must be positive")
        value = F.col(aged(column, half_life) if resumed else column)
        return F.sum(value * F.pow(F.lit(0.5), in_time / F.lit(float(half_life)))).alias(aged(column, half_life))

    sums = [F.sum(c).alias(c) for c in present]
    return daily.groupBy(*SIDE_KEYS).agg(*sums, *[decayed(c, h) for h in half_lives for c in _DECAYING if c in present])


def resume(batch: DataFrame, state: DataFrame, through: dt.date) -> Ledger:
    """The ledger of a batch of contests on top of the carry rows of all dates through a day."""
    fresh = daily_totals(after(batch, through)).withColumn(CARRIED, F.lit(False))
    for column in [c for c in state.columns if c not in fresh.columns]:
        plain = next(c for c in sorted(_DECAYING, key=len, reverse=True) if column.endswith(f"_{c}"))
        fresh = fresh.withColumn(column, F.col(plain).cast("double"))
    old = state.withColumns({"match_date": F.lit(through), CARRIED: F.lit(True)})
    return measured(settle(fresh.unionByName(old), "resumed-ledger"))


def coefficient_carry(days: DataFrame, through: dt.date, before: DataFrame | None = None) -> DataFrame:
    """Count and extremes of all low-score coefficients through a day, one row for each (competition, model).

    ``days`` are those of ``rho.coefficient_days``; ``before`` is the carry of the snapshot that they follow.
    """
    columns = [*MODEL_KEYS, "n_low", "day_min", "day_max"]
    rows = days.select(*columns) if before is None else days.select(*columns).unionByName(before.select(*columns))
    folded = rows.groupBy(*MODEL_KEYS).agg(F.sum("n_low").alias("n_low"), F.min("day_min").alias("day_min"), F.max("day_max").alias("day_max"))
    return folded.withColumn("match_date", F.lit(through))


def _folder(path: str, through: dt.date) -> str:
    return f"{path}/through={through.isoformat()}"


def save(state: DataFrame, path: str, through: dt.date) -> None:
    """Write carry rows as the snapshot of a day; no other snapshot changes."""
    state.write.mode("overwrite").parquet(_folder(path, through))


def load(spark: SparkSession, path: str, through: dt.date) -> DataFrame:
    """The carry rows of a day's snapshot."""
    folder = _folder(path, through)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        raise ValueError(f"no finished snapshot through {through} in {path}")
    return spark.read.parquet(folder)


def advance(
    batch: DataFrame,
    path: str,
    through: dt.date,
    resumed_from: dt.date | None = None,
    half_lives: Sequence[float] = (HALF_LIFE_DAYS,),
) -> Ledger:
    """Take a batch of contests into the history: its ledger, and a new snapshot through a day.

    ``resumed_from`` names the snapshot to go on from; None starts a history.
    """
    if resumed_from is None:
        ledger = build_ledger(batch)
    elif resumed_from >= through:
        raise ValueError(f"a snapshot through {through} can't follow one through {resumed_from}")
    else:
        ledger = resume(batch, load(batch.sparkSession, path, resumed_from), resumed_from)
    save(carry(ledger.daily, through, half_lives), path, through)
    return ledger
