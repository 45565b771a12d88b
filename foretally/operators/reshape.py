"""Contest rows to side rows.

Arrays of structs are flattened with ``inline_outer`` throughout the package. The arrays are
never empty, so it returns what ``inline`` does, but the optimizer then adds no
"array is not empty" filter, which would evaluate every model expression a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEAM_KEYS = ("competition", "match_date", "team")


def observations(contests: DataFrame) -> DataFrame:
    """Two rows per contest: one for each side, in its venue role."""
    goals = "home_goals" in contests.columns

    def side(venue: str, other: str):
        fields = [
            F.lit(venue).alias("venue"),
            F.col(f"{venue}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.col(f"{venue}_count").alias("count_for"),
            F.col(f"{other}_count").alias("count_allowed"),
        ]
        if goals:
            fields += [
                F.col(f"{venue}_goals").alias("goals_for"),
                F.col(f"{other}_goals").alias("goals_allowed"),
            ]
        return F.struct(*fields)

    return contests.select(
        "match_id",
        "match_date",
        "competition",
        F.inline_outer(F.array(side("home", "away"), side("away", "home"))),
    )
