import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from foretally.contracts import CONTESTS
from foretally.operators import pairing, resample
from foretally.plans import documents, sides
from foretally.operators.ledger import build_ledger
from tests.conftest import seeded_log


@pytest.fixture(scope="module")
def many(spark):
    """A thousand competitions of a few contests each."""
    rows = [(c * 100 + i, *row[:1], f"C{c:04d}", *row[1:5]) for c in range(1000) for i, row in enumerate(seeded_log(c % 7, 10, sides=4))]
    return spark.createDataFrame(rows, CONTESTS)


def files_of(folder):
    return {(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def reports_of(spark, folder):
    return {(r.analysis, r.competition): json.loads(r.value) for r in spark.read.text(folder).collect()}


collect = DataFrame.collect


def few(df):
    """``collect`` for the sums that plans measure their tables with."""
    rows = collect(df)
    assert len(rows) <= 1, "rows reached the driver"
    return rows


def test_a_thousand_competitions_in_one_call_and_partitions_of_their_own(spark, many, tmp_path, monkeypatch):
    start, folder = dt.date(2015, 3, 5), str(tmp_path / "documents")
    with monkeypatch.context() as patch:
        for name in ("toPandas", "toArrow", "toLocalIterator"):
            patch.setattr(f"pyspark.sql.classic.dataframe.DataFrame.{name}", lambda *a, **k: pytest.fail("rows reached the driver"))
        patch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", few)
        documents.write_documents(documents.total_documents(many, start), folder, "total")
        documents.write_documents(documents.total_documents(many.where("competition < 'C0003'"), start), folder, "again")
    held, before = reports_of(spark, folder), files_of(folder)
    assert len(held) == 1003 and held["total", "C0002"] == held["again", "C0002"]
    one = held["total", "C0001"]["evaluation"]
    assert one["n"] == sum(r[0] >= start for r in seeded_log(1, 10, sides=4)) and set(one["lines"]) == {"8.5", "9.5", "10.5", "11.5"}
    # a second run replaces what it writes and nothing else
    shifted = many.where("competition in ('C0001', 'C0500')").withColumn("home_count", F.col("home_count") + 3)
    documents.write_documents(documents.total_documents(shifted, start), folder, "total")
    changed = {key[0].rsplit("=", 1)[-1] for key in before.keys() ^ files_of(folder).keys()}
    assert changed == {"C0001", "C0500"}
    now = reports_of(spark, folder)
    assert now["total", "C0001"] != held["total", "C0001"] and now["total", "C0002"] == held["total", "C0002"] and len(now) == 1003


def test_side_documents_hold_each_competitions_own_bootstrap(spark):
    logs = {"A": seeded_log(5, 60), "B": seeded_log(6, 80)}
    rows = [(k * 1000 + i, row[0], name, *row[1:5]) for k, (name, log) in enumerate(logs.items()) for i, row in enumerate(log)]
    contests = spark.createDataFrame(rows, CONTESTS)
    start = dt.date(2015, 3, 20)
    found = {r.competition: r.report for r in documents.side_documents(contests, start, samples=15).collect()}
    for name in logs:
        own = contests.where(F.col("competition") == name)
        panel = sides.side_panel(own, build_ledger(own), start)
        fixtures = pairing.fixture_deltas(pairing.side_deltas(pairing.panel_pair(panel, ("venue_average", "team_opponent"), "venue_average", "team_opponent")))
        key = [c for c in pairing.CONTEST_VALUE if c != "competition"]
        alone = {r.metric: r for r in resample.iid_bootstrap(fixtures, key, samples=15).collect()}
        report = found[name]
        for metric, row in alone.items():
            assert report.paired_bootstrap.metrics[metric].mean_delta == pytest.approx(row.mean_delta, abs=1e-12)
            assert report.paired_bootstrap.metrics[metric].upper_95 == pytest.approx(row.upper_95, abs=1e-12)
        models = report.models
        assert models["venue_average"].overall.n == 2 * models["venue_average"].by_venue["home"].n
        delta = models["team_opponent"].overall.mae - models["venue_average"].overall.mae
        assert report.challenger_minus_baseline.mae == pytest.approx(delta)
