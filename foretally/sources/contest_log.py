"""A contest log derived from order tables (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.functions.calendar import july_season

FIXTURE_START = dt.date(1996, 7, 1)
FIXTURE_HOLDOUT = dt.date(2000, 7, 1)


def contests_from(log: DataFrame) -> DataFrame:
    """The rows of the log that are contests: a nation doesn't play itself."""
    return log.filter(F.col("home_team") != F.col("away_team"))


def log_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order that has line items, between the customer's and a supplier's nation.

    Line items are folded to one row per order before any join. The dimension joins carry no
    hints: Spark broadcasts a side only if its file size is below the session threshold.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    odd = F.col("l_linenumber") % 2 == 1
    per_order = (
        table("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("l_suppkey"),
            F.floor(F.coalesce(F.sum(F.when(odd, F.col("l_quantity"))), F.lit(0.0)) / 10).cast("int").alias("home_count"),
            F.floor(F.coalesce(F.sum(F.when(~odd, F.col("l_quantity"))), F.lit(0.0)) / 10).cast("int").alias("away_count"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("home_goals"),
            F.count_if(F.col("l_returnflag") == "A").cast("int").alias("away_goals"),
        )
    )
    nation = table("nation").select("n_nationkey", "n_name")
    hosts = (
        table("customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("c_mktsegment").alias("competition"), F.col("n_name").alias("home_team"))
    )
    guests = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("away_team"))
    )
    return (
        table("orders")
        .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("match_date"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(hosts, F.col("o_custkey") == F.col("c_custkey"))
        .join(guests, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderkey").alias("match_id"),
            "match_date",
            "competition",
            "home_team",
            "away_team",
            "home_count",
            "away_count",
            "home_goals",
            "away_goals",
            july_season("match_date").alias("season"),
        )
    )


def raw_rows(log: DataFrame) -> DataFrame:
    """The whole log, sides that play themselves and repeated fixtures included, written back as the string cells of a season file, with typical faults.

    The faults are a fixed rule on ``match_id``, so that both engines of the correctness
    check see the same bad cells; no row is left out.
    """
    k = F.col("match_id")
    long_date = F.date_format("match_date", "dd/MM/yyyy")
    short_date = F.date_format("match_date", "dd/MM/yy")
    date_cell = (
        F.when(k % 101 == 7, F.date_format("match_date", "yyyy-MM-dd"))
        .when(k % 103 == 9, F.concat(F.lit("31/02/"), F.date_format("match_date", "yyyy")))
        .when(k % 5 == 1, short_date)
        .when(k % 7 == 2, F.concat(F.lit(" "), long_date, F.lit("\t")))
        .otherwise(long_date)
    )
    home, away = F.col("home_count").cast("string"), F.col("away_count").cast("string")
    home_cell = (
        F.when(k % 89 == 3, F.lit(""))
        .when(k % 97 == 4, F.lit(" "))
        .when(k % 107 == 5, F.lit("not-a-number"))
        .when(k % 109 == 6, F.lit("-1"))
        .when(k % 113 == 8, F.lit("2.5"))
        .when(k % 11 == 3, F.concat(home, F.lit(".0")))
        .when(k % 13 == 4, F.concat(F.lit(" "), home, F.lit("e0 ")))
        .otherwise(home)
    )
    away_cell = F.when(k % 89 == 3, F.lit(None).cast("string")).when(k % 127 == 10, F.lit("nan")).otherwise(away)
    return log.select(
        "match_id",
        F.when(k % 131 == 11, F.lit("E0")).when(k % 3 == 0, F.concat(F.lit(" "), F.col("competition"))).otherwise(F.col("competition")).alias("Div"),
        date_cell.alias("Date"),
        F.when(k % 137 == 12, F.lit("  ")).otherwise(F.col("home_team")).alias("HomeTeam"),
        F.when(k % 139 == 13, F.lower("home_team")).otherwise(F.col("away_team")).alias("AwayTeam"),
        F.col("home_goals").cast("string").alias("FTHG"),
        F.col("away_goals").cast("string").alias("FTAG"),
        home_cell.alias("HC"),
        away_cell.alias("AC"),
        F.concat(F.lit("E1_"), F.col("season"), F.lit(".csv")).alias("file_name"),
    )
