"""Shapes that must hold at any size: pruned scans, pushed filters, checked broadcasts, early folding."""

import re

from pyspark.sql import functions as F

from foretally import catalog, workspace
from foretally.operators.ledger import build_ledger, daily_totals
from foretally.plans import sides
from foretally.sources.contest_log import FIXTURE_START, log_from_orders

FOLDER = "/root/testdata/sf0.001"

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_needed_columns(spark):
    plan = plan_of(log_from_orders(spark, FOLDER))
    schema = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_orderkey" in s)
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_evaluation_start_reaches_the_fact_scan_but_not_the_history(spark):
    d = catalog.derived(spark, FOLDER)
    plan = plan_of(catalog.queries()["total_walkforward"](spark, FOLDER))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    facts = [filters for columns, filters in scans if "home_team" in columns or "home_count" in columns]
    history = [filters for columns, filters in scans if "sq_total" in columns]
    assert facts and all("GreaterThanOrEqual(match_date" in f for f in facts)
    assert history and not any("match_date,1996" in f for f in history)
    assert d.ledger.dates < d.ledger.rows


def test_join_strategy_follows_the_measured_size(spark):
    d = catalog.derived(spark, FOLDER)
    facts, state = d.contests, d.ledger.daily.filter("venue = 'home'").withColumnRenamed("team", "home_team")
    keys = ["competition", "match_date", "home_team"]
    small = workspace.attach(facts, state, keys, d.ledger.rows)
    large = workspace.attach(facts, state, keys, d.ledger.rows, limit=10)
    assert "BroadcastHashJoin" in plan_of(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(large)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forecasts_are_the_same_without_broadcasts(spark, monkeypatch):
    d = catalog.derived(spark, FOLDER)
    pick = lambda df: sorted(map(tuple, sides.long_forecasts(df).select("match_id", "venue", "model", "expected").collect()))
    before = pick(d.side_panel)
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert pick(sides.side_panel(d.contests, d.ledger, FIXTURE_START)) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_team_shrinks_before_the_shuffle(spark):
    """A side that plays in a third of a log keeps at most one ledger row per date and venue."""
    log = spark.range(30_000).select(
        F.col("id").alias("match_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("match_date"),
        F.lit("E1").alias("competition"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id") % 500)).alias("home_team"),
        F.concat(F.lit("a"), F.col("id") % 700).alias("away_team"),
        (F.col("id") % 7).cast("int").alias("home_count"),
        (F.col("id") % 5).cast("int").alias("away_count"),
    )
    daily = daily_totals(log)
    assert daily.filter("team = 'hot'").count() <= 100
    assert "partial_sum" in plan_of(daily)
    assert build_ledger(log).dates == 100


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


def test_one_walk_forward_feeds_the_whole_report(spark):
    """Facts are scanned once and meet three states; nothing is joined without a key."""
    for name in ("prior_sensitivity", "block_totals"):
        plan = final_plan(catalog.queries()[name](spark, FOLDER)).split("== Initial Plan ==")[0]
        facts = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "home_count" in s or "home_team" in s]
        joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|NestedLoopJoin|CartesianProduct)", plan)
        assert len(facts) == 1, name
        assert len(joins) == 3 and not {"NestedLoopJoin", "CartesianProduct"} & set(joins), (name, joins)


def test_unique_fixtures_need_no_sort(spark):
    plan = plan_of(catalog.queries()["unique_fixtures"](spark, FOLDER))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_intermediate_tables_can_be_released(tmp_path):
    """In a session of its own, since the tables of all others would go with it."""
    import os
    import subprocess
    import sys

    code = """
import os
from foretally.workspace import start_session, settle, release, run_folder
spark = start_session("release", "local[2]", 2)
settle(spark.range(50_000).repartition(1), "once", even=True)
folder = run_folder(spark)
assert len(os.listdir(folder)) == 1, os.listdir(folder)  # the first copy is gone
release(spark)
assert not os.path.exists(folder)
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=env, cwd=workspace.__file__.rsplit("/", 2)[0])


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = workspace.shared_folder(spark)
    assert folder == configured if configured else folder


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_work_after_a_release(spark):
    query = catalog.queries()["row_quality"]
    before = sorted(map(tuple, query(spark, FOLDER).collect()), key=str)
    workspace.release(spark)
    assert sorted(map(tuple, query(spark, FOLDER).collect()), key=str) == before
