import csv
import datetime as dt
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from foretally.functions.parsing import parse_count, parse_match_date
from foretally.operators import quality
from foretally.plans import reports
from foretally.sources import season_csv
from tests.conftest import seeded_log

FIELDS = ("Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HC", "AC")


def season_rows(log, code="E1", blank_every=0):
    """Rows of a seeded log as cells by column; every n-th one without a result."""
    rows = []
    for i, (day, home, away, hc, ac, hg, ag) in enumerate(log):
        row = dict(zip(FIELDS, (code, day.strftime("%d/%m/%Y"), home, away, hg, ag, hc, ac)))
        if blank_every and i % blank_every == blank_every - 1:
            row |= {"FTHG": "", "FTAG": "", "HC": "\t", "AC": " "}
        rows.append(row)
    return rows


def as_csv(rows, fields=FIELDS):
    out = io.StringIO()
    writer = csv.DictWriter(out, fields, extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def loaded_rows(log, blank_every=0):
    return sorted(r[:5] for i, r in enumerate(log) if not blank_every or i % blank_every != blank_every - 1)


def as_tuples(contests):
    return sorted((r.match_date, r.home_team, r.away_team, r.home_count, r.away_count) for r in contests.collect())


@pytest.fixture
def season(tmp_path):
    def write(text, name="E1_1516.csv", encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write


def test_loads_counts_and_quality(spark, season):
    log = seeded_log(21, 40)
    loaded = season_csv.load_contests(spark, [season(as_csv(season_rows(log, blank_every=8)))])
    assert as_tuples(loaded.contests) == loaded_rows(log, 8)
    overall = loaded.quality.filter("file_path IS NULL").head()
    assert (overall.rows_read, overall.rows_loaded, overall.rows_without_result) == (40, 35, 5)


def test_other_headers_give_the_same_rows_and_unique_ids(spark, season):
    logs = [seeded_log(22 + k, 25) for k in range(3)]
    orders = (FIELDS, FIELDS[::-1], ("Note", *FIELDS[4:], *FIELDS[:4]))
    names = ("E1 15 16.csv", "E1+1617.csv", "E1_%41.csv")
    paths = [
        season(as_csv([{**r, "Note": "x,y"} for r in season_rows(log)], order), name, encoding)
        for log, order, name, encoding in zip(logs, orders, names, ("utf-8-sig", "utf-8", "utf-8"))
    ]
    contests = season_csv.load_contests(spark, paths).contests
    assert as_tuples(contests) == sorted(r for log in logs for r in loaded_rows(log))
    assert contests.select("match_id").distinct().count() == 75
    assert {r.file_name for r in season_csv.file_manifest(spark, paths[:2]).collect()} == set(names[:2])


def test_missing_columns_are_named(spark, season):
    text = as_csv(season_rows(seeded_log(1, 3)), ("Date", "HomeTeam", "AwayTeam", "HC"))
    with pytest.raises(ValueError, match="missing required columns: AC, Div"):
        season_csv.load_contests(spark, [season(text)])
    with pytest.raises(ValueError, match="missing required columns"):
        season_csv.load_contests(spark, [season("", "empty.csv")])


@pytest.mark.parametrize(
    "column, cell, reason",
    [
        ("HC", "many", "home count is not a non-negative integer"),
        ("AC", "", "away count is missing"),
        ("HC", "3000000000", "home count is above 2147483647"),
        ("Date", "2016-02-01", "unsupported match date"),
        ("AwayTeam", "\t", "away_team must not be empty"),
    ],
)
def test_malformed_row_names_file_and_row(spark, season, column, cell, reason):
    rows = season_rows(seeded_log(31, 20))
    rows[13][column] = cell
    path = season(as_csv(rows), "bad one.csv")
    with pytest.raises(ValueError, match=rf"bad one\.csv row 15: .*{reason}"):
        season_csv.load_contests(spark, [path])
    loaded = season_csv.load_contests(spark, [path], strict=False)
    assert loaded.contests.count() == 19 and loaded.quarantine.count() == 1


def test_rows_have_a_number_and_an_id_that_splits_do_not_change(spark, season):
    logs = [seeded_log(33 + k, 120) for k in range(2)]
    paths = [season(as_csv(season_rows(log)), f"E1_{1516 + k}.csv") for k, log in enumerate(logs)]
    runs = []
    for size in ("134217728", "700", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = season_csv.load_contests(spark, paths).rows.select("file_name", "row", "match_id", "home_team", "match_date")
            runs.append(sorted(map(tuple, rows.collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert runs[0] == runs[1] == runs[2]
    for k, log in enumerate(logs):
        own = [r for r in runs[0] if r[0] == f"E1_{1516 + k}.csv"]
        assert [r[1] for r in own] == list(range(2, 122))
        assert [(r[4], r[3]) for r in own] == [(c[0], c[1]) for c in log]
    assert len({r[2] for r in runs[0]}) == 240


def test_headers_take_one_bounded_read_a_file(spark, season, monkeypatch):
    wide = season("Div,Date," + ",".join(f"c{i}" for i in range(20_000)) + "\nE1,x\n", "wide.csv")
    plain = season("\ufeffDiv,Date\r\nE1,01/01/2016\r\n" + "x" * 300_000, "plain.csv")
    lone = season("only", "lone.csv")
    jobs = []
    monkeypatch.setattr("pyspark.sql.DataFrame.collect", lambda self: jobs.append(self))
    found = {path.rsplit("/", 1)[-1]: names for path, names in season_csv.headers_of(spark, [wide, plain, lone]).items()}
    assert not jobs and len(found["wide.csv"]) == 20_002
    assert found["plain.csv"] == ("Div", "Date") and found["lone.csv"] == ("only",)


def test_an_error_names_rows_and_their_number(spark, season):
    rows = season_rows(seeded_log(34, 60))
    for row in rows[10:40]:
        row["HC"] = "many"
    with pytest.raises(ValueError) as caught:
        season_csv.load_contests(spark, [season(as_csv(rows))])
    lines = str(caught.value).splitlines()
    assert lines[0].startswith("E1_1516.csv row 12: ") and lines[-1] == "and 10 more rows" and len(lines) == 21


def test_bad_goal_rows_can_be_set_aside(spark, season):
    log = seeded_log(44, 20)
    rows = season_rows(log)
    rows[3]["FTHG"], rows[4]["Div"], rows[5]["HC"] = "-1", "E0", "?"
    goals, loaded, excluded = season_csv.load_goals(spark, [season(as_csv(rows)), season(as_csv(rows[:2]), "E1_copy.csv")], strict=False)
    assert goals.count() == 17 and loaded.quarantine.count() == 1 and excluded.count() == 1
    found = sorted((r.row, r.goal_faults) for r in loaded.goal_quarantine.collect())
    assert found == [(5, ["invalid goal result"]), (6, ["malformed or foreign fixture"])]
    assert {r.season for r in goals.collect()} == {"1516"}  # of a repeated fixture the first file's row


def test_files_of_any_size_are_hashed(spark, season, tmp_path):
    small = season("Div,Date\nE1,x\n", "small one.csv")
    large = tmp_path / "large.csv"
    with open(large, "wb") as out:
        out.truncate(2_500_000_000)  # a hole: no disk is used
    expected = hashlib.sha256()
    for _ in range(2500):
        expected.update(bytes(1_000_000))
    found = {r.file_name: (r.bytes, r.sha256) for r in season_csv.file_hashes(spark, [small, str(large)]).collect()}
    assert found["large.csv"] == (2_500_000_000, expected.hexdigest())
    assert found["small one.csv"] == next(
        (r.bytes, r.sha256) for r in season_csv.file_hashes(spark, [small], whole_bytes=0).collect()
    )


def test_short_and_long_rows(spark, season):
    lines = as_csv(season_rows(seeded_log(32, 6))).splitlines()
    lines[2] = ",".join(lines[2].split(",")[:4])  # cells that aren't there are blank
    lines[4] += ",more"  # fine for counts
    loaded = season_csv.load_contests(spark, [season("\n".join(lines))])
    assert loaded.quality.filter("file_path IS NULL").head().rows_without_result == 1 and loaded.contests.count() == 5


@pytest.mark.parametrize(
    "cell,expected",
    [("6", 6), (" 6.0 ", 6), ("1e1", 10), ("+3", 3), ("", None), ("2.5", None), ("-1", None), ("nan", None), ("6d", None), ("inf", None), ("1_0", None)],
)
def test_count_cells(spark, cell, expected):
    assert spark.createDataFrame([(cell,)], "c string").select(parse_count("c").alias("v")).head().v == expected


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("05/08/2017", dt.date(2017, 8, 5)),
        ("5/8/17", dt.date(2017, 8, 5)),
        ("\t05/08/69 ", dt.date(1969, 8, 5)),
        ("05/08/68", dt.date(2068, 8, 5)),
        ("31/02/2017", None),
        ("2017-08-05", None),
        ("", None),
        ("05/08/017", None),
    ],
)
def test_date_cells(spark, cell, expected):
    assert spark.createDataFrame([(cell,)], "c string").select(parse_match_date("c").alias("v")).head().v == expected


def test_row_constraints(spark, contests):
    day = dt.date(2026, 8, 8)
    good = contests([(day, "North", "South", 2, 3)])
    assert quality.constraint_violations(good).isEmpty()
    cases = {
        "competition": F.lit(""),
        "match_date": F.lit(None).cast("date"),
        "home_team": F.lit(" "),
        "away_team": F.lit(""),
        "home_count": F.lit(-1),
        "away_count": F.lit(None).cast("int"),
    }
    for column, bad in cases.items():
        broken = quality.constraint_violations(good.withColumn(column, bad)).head()
        assert any(v.startswith(column) for v in broken.violations)
    same = quality.constraint_violations(good.withColumn("away_team", F.lit("NORTH"))).head()
    assert same.violations == ["home_team and away_team must be different"]


def test_blank_sides_of_any_white_space(spark, contests):
    good = contests([(dt.date(2016, 5, 1), "P", "Q", 1, 2)])
    for cell in ("\t", "\u00a0", " \n"):
        assert quality.constraint_violations(good.withColumn("home_team", F.lit(cell))).head().violations == ["home_team must not be empty"]
    same = good.withColumn("away_team", F.lit("\u00a0p\t"))
    assert quality.constraint_violations(same).head().violations == ["home_team and away_team must be different"]


def test_every_other_competition_is_named(spark, contests):
    frames = [contests([(dt.date(2016, 5, 1), "P", "Q", 1, 2)], f"X{i:02d}") for i in range(30)]
    log = frames[0]
    for frame in frames[1:]:
        log = log.unionByName(frame)
    with pytest.raises(ValueError, match="X00, X01.*X29"):
        quality.require_competitions(log)


def test_goals_join_the_completed_cohort(spark, season):
    log = seeded_log(41, 30)
    path = season(as_csv(season_rows(log)))
    half = season_rows(log, blank_every=5)
    for row, whole in zip(half, season_rows(log)):
        row |= {"FTHG": whole["FTHG"], "FTAG": whole["FTAG"]}  # a goal result without counts is excluded
    goals, loaded, excluded = season_csv.load_goals(spark, [season(as_csv(half), "E1_1617.csv")])
    expected = sorted((*r[:3], *r[5:7]) for i, r in enumerate(log) if i % 5 != 4)
    assert sorted((r.match_date, r.home_team, r.away_team, r.home_goals, r.away_goals) for r in goals.collect()) == expected
    assert {r.season for r in goals.collect()} == {"1617"} and excluded.count() == 6
    with pytest.raises(ValueError, match="duplicate"):
        season_csv.load_goals(spark, [path, season(as_csv(season_rows(log)[:1]), "E1_copy.csv")])


@pytest.mark.parametrize("change, message", [({"FTHG": "-2"}, "invalid goal"), ({"FTAG": ""}, "invalid goal"), ({"Div": "E0"}, "malformed or foreign"), ({"AC": "4,9"}, "malformed or foreign")])
def test_bad_goal_rows_raise(spark, season, change, message):
    rows = season_rows(seeded_log(42, 9))
    rows[4] |= change
    text = as_csv(rows).replace('"4,9"', "4,9")
    with pytest.raises(ValueError, match=f"row 6: {message}"):
        season_csv.load_goals(spark, [season(text)])


def test_season_comes_from_the_file_name(spark, season):
    path = season(as_csv(season_rows(seeded_log(43, 5, first=dt.date(2020, 7, 20)))), "E1_19 20.csv")
    assert {r.season for r in season_csv.load_goals(spark, [path])[0].collect()} == {"19 20"}


def test_manifest_by_full_path(spark, season):
    logs = [seeded_log(51, 12), seeded_log(52, 17)]
    paths = [season(as_csv(season_rows(log)), f"{folder}/E1_1516.csv") for log, folder in zip(logs, ("one", "two"))]
    found = {r.file_path.removeprefix("file:"): r for r in season_csv.file_manifest(spark, paths).collect()}
    for path, log in zip(paths, logs):
        row = next(r for p, r in found.items() if p.endswith(path.lstrip("/")))
        assert (row.file_name, row.rows, row.teams) == ("E1_1516.csv", len(log), len({t for r in log for t in r[1:3]}))
        assert row.sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest() and row.bytes == len(open(path, "rb").read())
        assert (row.first_date, row.last_date) == (log[0][0], log[-1][0])


REPORT_LOG = seeded_log(61, 80)
REPORT_START = REPORT_LOG[30][0]
EVALUATED = sum(r[0] >= REPORT_START for r in REPORT_LOG)


def test_total_report(spark, season):
    result = reports.total_report(spark, [season(as_csv(season_rows(REPORT_LOG)))], REPORT_START)
    assert result["data_quality"] == {"rows_read": 80, "rows_loaded": 80, "rows_without_result": 0}
    evaluation = result["evaluation"]
    assert (evaluation["n"], evaluation["n_unscored"]) == (EVALUATED, 0) and set(evaluation["lines"]) == {"8.5", "9.5", "10.5", "11.5"}
    for line in evaluation["lines"].values():
        assert line["predicted_over"] + line["predicted_under"] == pytest.approx(1)
    json.dumps(result)
    with pytest.raises(ValueError, match="no predictions"):
        reports.total_report(spark, [season(as_csv(season_rows(REPORT_LOG)))], dt.date(2040, 1, 1))


def test_zero_means_stop_a_strict_report(spark, season):
    log = [(*r[:3], 0, 0, *r[5:]) if r[0] < REPORT_LOG[6][0] else r for r in REPORT_LOG]
    path = season(as_csv(season_rows(log)))
    with pytest.raises(ValueError, match="no valid distribution"):
        reports.total_report(spark, [path], log[0][0])
    loose = reports.total_report(spark, [path], log[0][0], strict=False)["evaluation"]
    assert loose["n_unscored"] > 0 and loose["n"] + loose["n_unscored"] == sum(r[0] > log[0][0] for r in log)


def test_side_report(spark, season):
    result = reports.side_report(spark, [season(as_csv(season_rows(REPORT_LOG)))], REPORT_START, samples=20)
    for model in ("venue_average", "team_opponent"):
        assert result["models"][model]["overall"]["n"] == 2 * EVALUATED
        assert result["models"][model]["by_venue"]["home"]["n"] == EVALUATED
    assert set(result["paired_bootstrap"]["metrics"]) == {"mae", "brier"}
    json.dumps(result)


def test_reports_reject_other_competitions(spark, season):
    path = season(as_csv(season_rows(REPORT_LOG, "E0")))
    with pytest.raises(ValueError, match="found: E0"):
        reports.total_report(spark, [path])


def test_report_sink(spark, contests, tmp_path):
    metrics = spark.createDataFrame([("a", 1.5)], "model string, mae double")
    reports.write_report(metrics, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).head().mae == 1.5
    assert reports.as_json(metrics, ["model"]).head().report == '{"mae":1.5}'


def test_decay_report(spark, season):
    log = seeded_log(71, 150, sides=4)
    path = season(as_csv(season_rows(log)))
    result = reports.decay_report(spark, [path], log[60][0], samples=50)
    sizes = {v["n"] for v in result["models"].values()}
    assert len(result["models"]) == 3 and len(sizes) == 1 and sizes.pop() > 0
    for interval in result["brier_intervals"].values():
        assert interval["lower_95"] <= interval["mean_delta"] <= interval["upper_95"]
    json.dumps(result)
    with pytest.raises(ValueError, match="duplicate fixture"):
        reports.decay_report(spark, [path, season(as_csv(season_rows(log)[:1]), "again.csv")])


def test_goal_report(spark, season):
    log = seeded_log(72, 200, sides=5)
    rows, holdout = season_rows(log), log[170][0]
    files = [season(as_csv(rows[:120]), "E1_1516.csv"), season(as_csv(rows[120:]), "E1_1617.csv")]
    result = reports.goal_report(spark, files, log[0][0], holdout, samples=40)
    evaluated = [r for r in log if sum(p[0] < r[0] for p in log) >= 100]
    everything = result["metrics"]["all"]
    assert set(result["metrics"]) == {"all", "development", "latest"} and len(everything) == 10
    assert everything["coin_0_5"]["over_2_5"]["brier"] == 0.25 and everything["coin_0_5"]["over_2_5"]["n"] == len(evaluated)
    assert len(everything["team_arithmetic"]["btts_yes"]["calibration_bins"]) == 10
    parts = [result["metrics"][w]["coin_0_5"]["over_2_5"]["n"] for w in ("development", "latest")]
    assert parts == [sum(r[0] < holdout for r in evaluated), sum(r[0] >= holdout for r in evaluated)]
    assert set(result["paired_28_day_block_intervals"]) == {"all", "latest"}
    unchanged = result["paired_28_day_block_intervals"]["all"]["team_arithmetic_dc_minus_team_arithmetic"]["over_2_5"]
    assert (unchanged["delta_brier"], unchanged["lower_95"], unchanged["upper_95"]) == (0, 0, 0)
    assert set(everything["venue_poisson_dc"]["rho"]) == {"mean_rho", "min_rho", "max_rho"}
    assert result["data_quality"]["excluded_source_rows"] == 0
    assert spark.read.parquet(result["data_quality"]["manifest"]).count() == 2
    json.dumps(result, default=str)


def test_goal_report_scans_the_files_once(spark, season, monkeypatch):
    log = seeded_log(73, 160, sides=4)
    path = season(as_csv(season_rows(log)))
    scans, hashes = [], []
    scan, whole = season_csv.scan, season_csv.file_hashes
    monkeypatch.setattr(season_csv, "scan", lambda *a, **k: scans.append(a) or scan(*a, **k))
    monkeypatch.setattr(season_csv, "file_hashes", lambda *a, **k: hashes.append(a) or whole(*a, **k))
    result = reports.goal_report(spark, [path], log[0][0], log[150][0], samples=5)
    assert len(scans) == len(hashes) == 1
    assert spark.read.parquet(result["data_quality"]["manifest"]).head().rows == 160


def test_reports_can_set_bad_rows_aside(spark, season):
    rows = season_rows(REPORT_LOG)
    rows[2]["HC"], rows[7]["Date"] = "many", "soon"
    path = season(as_csv(rows))
    with pytest.raises(ValueError, match="row 4"):
        reports.total_report(spark, [path], REPORT_START)
    result = reports.total_report(spark, [path], REPORT_START, strict=False)
    assert result["data_quality"] == {"rows_read": 80, "rows_loaded": 78, "rows_without_result": 0, "rows_quarantined": 2}
    assert result["evaluation"]["n"] == EVALUATED


def test_line_breaks_inside_quoted_cells(spark, season):
    rows = [{**r, "Note": "two\nlines", "HomeTeam": r["HomeTeam"] + ", x"} for r in season_rows(REPORT_LOG)]
    path = season(as_csv(rows, ("Note", *FIELDS)))
    contests = season_csv.load_contests(spark, [path], multi_line=True).contests
    assert {r.home_team for r in contests.collect()} == {r["HomeTeam"] for r in rows}
    assert reports.total_report(spark, [path], REPORT_START, multi_line=True)["evaluation"]["n"] == EVALUATED
    assert season_csv.file_manifest(spark, [path], multi_line=True).head().rows == 80
