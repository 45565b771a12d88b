"""Schemas and fixed parameters shared by every operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
TOTAL_LINES = (8.5, 9.5, 10.5, 11.5)
SIDE_LINES = (3.5, 4.5, 5.5, 6.5)
EVALUATION_START = dt.date(2018, 7, 1)
HOLDOUT_START = dt.date(2024, 7, 1)
COMPETITION_CODE = "E1"
PRIOR_MATCHES = 5
PRIOR_CHOICES = (2, 5, 10)
HALF_LIFE_DAYS = 180
MIN_DECAY_OBSERVATIONS = 100  # two observations per contest
MIN_VENUE_CONTESTS = 5
MIN_GOAL_CONTESTS = 100  # contests
MIN_RHO_HISTORY = 50
RHO_LIMIT = 0.25
RHO_MARGIN = 0.95
LEAGUE_RATE_FLOOR = 1e-9
POISSON_DISPERSION = 1e-12  # dispersion at or below this is read as Poisson
BLOCK_DAYS = 28
ORDINAL_OF_1970 = 719163  # proleptic Gregorian ordinal of 1970-01-01
BOOTSTRAP_SEED = 7
IID_SAMPLES = 1000
BLOCK_SAMPLES = 2000
CALIBRATION_BINS = 10

SIDE_MODELS = ("venue_average", "team_opponent")
DECAY_MODELS = ("retained", "equal_weight", "time_weighted_180")
BASE_GOAL_MODELS = ("venue_poisson", "team_arithmetic", "team_multiplicative", "team_decay_180")
GOAL_MODELS = (
    ("coin_0_5", "expanding_event_rate")
    + BASE_GOAL_MODELS
    + tuple(name + "_dc" for name in BASE_GOAL_MODELS)
)
TARGETS = ("over_2_5", "btts_yes")
GOAL_PAIRS = (
    ("team_decay_180", "expanding_event_rate"),
    ("team_arithmetic", "expanding_event_rate"),
    ("team_multiplicative", "expanding_event_rate"),
    ("team_decay_180", "team_arithmetic"),
    ("team_decay_180", "team_multiplicative"),
) + tuple((name + "_dc", name) for name in BASE_GOAL_MODELS)

COUNT_COLUMNS = ("Date", "Div", "HomeTeam", "AwayTeam", "HC", "AC")
GOAL_COLUMNS = ("Date", "Div", "HomeTeam", "AwayTeam", "FTHG", "FTAG")

# --- schemas ----------------------------------------------------------------
CONTESTS = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("match_date", T.DateType()),
        T.StructField("competition", T.StringType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("home_count", T.IntegerType()),
        T.StructField("away_count", T.IntegerType()),
    ]
)

GOAL_CONTESTS = T.StructType(
    CONTESTS.fields
    + [
        T.StructField("home_goals", T.IntegerType()),
        T.StructField("away_goals", T.IntegerType()),
        T.StructField("season", T.StringType()),
    ]
)

FIXTURE_KEY = ("competition", "match_date", "home_team", "away_team")
