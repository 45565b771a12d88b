import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.contracts import SIDE_LINES, SIDE_MODELS
from foretally.operators import pairing, resample, scoring
from foretally.plans import sides
from foretally.operators.ledger import build_ledger
from tests.conftest import seeded_log

D = dt.date
MASK = 0xFFFFFFFF


def mixed(x):
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) & MASK
    return x ^ (x >> 16)


def drawn(seed, sample, draw, n):
    key = mixed((seed * 2654435761 + sample) & MASK)
    return mixed(((draw * 2654435761) & MASK) ^ key) % n


def units(spark, n=300, shift=0.1):
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(shift, 1, (n, 2)))]
    return spark.createDataFrame(rows, "unit string, mae_delta double, brier_delta double")


def by_metric(df):
    return {r.metric: r for r in df.collect()}


def test_multinomial_draws_against_plain_python(spark):
    df = units(spark, 40)
    got = by_metric(resample.iid_bootstrap(df, ["unit"], samples=20, seed=3))
    ordered = [r.mae_delta for r in df.withColumn("tag", resample.unit_tag(["unit"])).orderBy("tag").collect()]
    means = sorted(np.mean([ordered[drawn(3, s, i, 40)] for i in range(40)]) for s in range(20))
    assert got["mae"].mean_delta == pytest.approx(np.mean(means))
    # ranks are truncated: int(0.025 * 19) and int(0.975 * 19)
    assert got["mae"].lower_95 == pytest.approx(means[0]) and got["mae"].upper_95 == pytest.approx(means[18])
    assert got["mae"].share_below_zero == pytest.approx(np.mean([m < 0 for m in means]))


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_interval_has_the_right_centre_and_width(spark, method):
    df = units(spark, 400, 0.5)
    row = by_metric(resample.iid_bootstrap(df, ["unit"], samples=400, method=method))["mae"]
    values = np.array([r.mae_delta for r in df.collect()])
    assert row.mean_delta == pytest.approx(values.mean(), abs=0.02)
    assert row.upper_95 - row.lower_95 == pytest.approx(2 * 1.96 * values.std() / 20, rel=0.2)


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_result_does_not_depend_on_partitioning(spark, method):
    df = units(spark, 60)
    runs = [by_metric(resample.iid_bootstrap(x, ["unit"], samples=30, method=method)) for x in (df, df.orderBy("mae_delta").repartition(7))]
    for metric in ("mae", "brier"):
        assert tuple(runs[0][metric])[1:] == pytest.approx(tuple(runs[1][metric])[1:])


def test_bucketed_draws_do_not_depend_on_partitioning(spark):
    df = units(spark, 900)
    runs = []
    for frame, shuffles in ((df.repartition(1), "1"), (df.orderBy("mae_delta").repartition(64), "64")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            runs.append(by_metric(resample.iid_bootstrap(frame, ["unit"], samples=30, bucket_units=100)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    for metric in ("mae", "brier"):
        assert tuple(runs[0][metric])[1:] == pytest.approx(tuple(runs[1][metric])[1:], abs=1e-12)
    with pytest.raises(ValueError, match="method"):
        resample.iid_bootstrap(df, ["unit"], method="auto")


def paths_of(sizes):
    """Each bucket's path through the tree over the sizes, as the plan gives it."""
    depth, paths = (len(sizes) - 1).bit_length(), []
    for bucket in range(len(sizes)):
        low, high, node, path = 0, len(sizes), 1, []
        for _ in range(depth):
            middle = (low + high) // 2
            right = bucket >= middle
            path.append((node, int(sizes[low:middle].sum()), int(sizes[low:high].sum()), right))
            low, high, node = (middle, high, 2 * node + 1) if right else (low, middle, 2 * node)
        paths.append(path)
    return paths


def test_buckets_share_a_samples_draws_in_proportion():
    sizes = np.array([700, 0, 1, 299, 1000, 500, 250, 250])
    samples, paths = range(400), paths_of(sizes)
    counts = np.array([resample.bucket_draws(3000, path, samples, 7) for path in paths])
    assert (counts.sum(axis=0) == sizes.sum()).all() and (counts[1] == 0).all()
    share = sizes / sizes.sum()
    assert counts.mean(axis=1) == pytest.approx(sizes, rel=0.1, abs=0.2)
    for b in (0, 4, 6):  # a multinomial's marginals are binomial
        assert counts[b].var() == pytest.approx(3000 * share[b] * (1 - share[b]), rel=0.25)
    assert np.corrcoef(counts[0], counts[4])[0, 1] == pytest.approx(-np.sqrt(share[0] * share[4] / (1 - share[0]) / (1 - share[4])), abs=0.15)
    assert (resample.bucket_draws(3000, paths[5], range(100, 130), 7) == counts[5, 100:130]).all()


def test_planned_paths_are_the_trees(spark):
    df = units(spark, 700).withColumn("g", F.when(F.col("mae_delta") > 0.9, F.lit("small")).otherwise(F.lit("large")))
    placed, buckets = resample._bucketed(df, ["unit"], ["mae_delta"], ["g"], 70)
    for group in ("small", "large"):
        rows = {r.bucket: r for r in buckets.where(F.col("g") == group).collect()}
        depth = next(iter(rows.values())).depth
        sizes = np.array([rows[b].n if b in rows else 0 for b in range(1 << depth)])
        assert sizes.sum() == df.where(F.col("g") == group).count() and (1 << depth) >= sizes.sum() / 70
        for bucket, row in rows.items():
            assert [(s.node, s.left, s.whole, s.right) for s in row.path or []] == paths_of(sizes)[bucket]


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_groups_are_resampled_by_themselves(spark, method):
    df = units(spark, 200).withColumn("g", F.when(F.col("unit") < "u15", F.lit("a")).otherwise(F.lit("b")))
    both = resample.iid_bootstrap(df, ["unit"], samples=25, method=method, by=["g"])
    for group in ("a", "b"):
        alone = by_metric(resample.iid_bootstrap(df.where(F.col("g") == group), ["unit"], samples=25, method=method))
        own = by_metric(both.where(F.col("g") == group).drop("g"))
        for metric in ("mae", "brier"):
            assert tuple(own[metric])[1:] == pytest.approx(tuple(alone[metric])[1:], abs=1e-12)


def test_bucketed_interval_has_the_right_centre_and_width(spark):
    df = units(spark, 2000, 0.5)
    row = by_metric(resample.iid_bootstrap(df, ["unit"], samples=400, bucket_units=150))["mae"]
    values = np.array([r.mae_delta for r in df.collect()])
    assert row.mean_delta == pytest.approx(values.mean(), abs=0.01)
    assert row.upper_95 - row.lower_95 == pytest.approx(2 * 1.96 * values.std() / np.sqrt(2000), rel=0.15)


def test_no_draw_is_shuffled_or_joined(spark):
    df = units(spark, 500)
    samples = 40
    means = resample.iid_draws(df, ["unit"], ["mae_delta"], samples, 7, bucket_units=100)
    plan = means._jdf.queryExecution().executedPlan().toString()
    # the units, their buckets' paths, and a row for each sample and task
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3
    drawn = means.collect()
    assert len(drawn) == samples


def test_missing_differences_count_nowhere(spark):
    df = units(spark, 30)
    gaps = df.unionByName(df.limit(3).select(F.concat(F.lit("x"), "unit").alias("unit"), F.lit(None).cast("double").alias("mae_delta"), "brier_delta"))
    one, two = (by_metric(resample.iid_bootstrap(x, ["unit"], samples=20)) for x in (df, gaps))
    assert all(tuple(one[m])[1:] == pytest.approx(tuple(two[m])[1:]) for m in one)
    rows = [("p", D(2020, 1, 1), 0.5), ("p", D(2020, 1, 2), None), ("q", D(2020, 1, 1), None)]
    blocks = pairing.block_totals(spark.createDataFrame(rows, "pair string, match_date date, brier_delta double"), ["pair"]).collect()
    assert [(r.pair, r.n, r.s) for r in blocks] == [("p", 1, 0.5)]


def test_invalid_arguments(spark):
    with pytest.raises(ValueError):
        resample.iid_bootstrap(units(spark, 5), ["unit"], samples=0)
    with pytest.raises(ValueError, match="no predictions"):
        resample.iid_bootstrap(units(spark, 5).limit(0), ["unit"])


def test_block_bootstrap_is_a_ratio_of_sums(spark):
    blocks = [("p", b, n, s) for b, n, s in ((700, 3, 0.6), (701, 1, -0.4), (705, 10, 2.5))]
    df = spark.createDataFrame(blocks, "pair string, block_id bigint, n bigint, s double")
    row = resample.block_bootstrap(df, ["pair"], samples=50, seed=7).head()
    ratios = []
    for sample in range(50):
        picked = [blocks[drawn(7, sample, i, 3)] for i in range(3)]
        ratios.append(sum(p[3] for p in picked) / sum(p[2] for p in picked))
    ratios.sort()
    assert row.delta_brier == pytest.approx(2.7 / 14) and row.blocks == 3
    assert (row.lower_95, row.upper_95) == (pytest.approx(ratios[1]), pytest.approx(ratios[47]))


def test_equal_models_have_a_zero_interval(spark):
    blocks = spark.createDataFrame([("p", b, 5, 0.0) for b in range(6)], "pair string, block_id bigint, n bigint, s double")
    row = resample.block_bootstrap(blocks, ["pair"], samples=20).head()
    assert (row.lower_95, row.upper_95, row.share_below_zero) == (0, 0, 0)


def test_fixture_differences_merge_equal_contests(spark, contests):
    rows = seeded_log(81, 30)
    later = sum(r[0] >= rows[10][0] for r in rows)
    log = contests([*rows, *rows[-2:]])
    panel = sides.side_panel(log, build_ledger(log), rows[10][0])
    pairs = pairing.side_deltas(pairing.panel_pair(panel, SIDE_MODELS, *SIDE_MODELS))
    sizes = sorted(r.observations for r in pairing.fixture_deltas(pairs).collect())
    assert sizes == [2] * (later - 2) + [4, 4]


def test_alignment_by_key_equals_the_panel(contests):
    rows = seeded_log(82, 40)
    log = contests(rows)
    panel = sides.side_panel(log, build_ledger(log), rows[9][0])
    long = sides.long_forecasts(panel)
    columns = ["match_id", "venue", "mae_delta", "brier_delta"]
    direct = pairing.side_deltas(pairing.panel_pair(panel, SIDE_MODELS, *SIDE_MODELS)).select(*columns)
    aligned = pairing.side_deltas(pairing.align(long, *SIDE_MODELS, ["match_id", "venue"])).select(*columns)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, aligned.collect()))


def test_cohorts_must_match(contests):
    rows = seeded_log(83, 40)
    log = contests(rows)
    long = sides.long_forecasts(sides.side_panel(log, build_ledger(log), rows[9][0]))
    pairing.require_same_cohort(long, SIDE_MODELS, ["match_id", "venue"])
    gap = long.filter("NOT (model = 'team_opponent' AND match_id = 27 AND venue = 'home')")
    assert [tuple(r) for r in pairing.cohort_mismatch(gap, SIDE_MODELS, ["match_id", "venue"]).collect()] == [(27, "home", 1)]
    with pytest.raises(ValueError, match="identical observations; 1 "):
        pairing.require_same_cohort(gap, SIDE_MODELS, ["match_id", "venue"])
    # same numbers of observations, other outcomes
    other = long.withColumn("actual", F.when(F.expr("model = 'team_opponent' AND match_id IN (27, 28)"), 55 - F.col("match_id")).otherwise(F.col("actual")))
    with pytest.raises(ValueError, match="identical observations"):
        pairing.require_same_cohort(other, SIDE_MODELS, ["match_id", "venue"])
    for df, bad in ((long, False), (gap, True), (other, True)):
        tally = scoring.tally_counts(df, (3.5, 4.5, 5.5, 6.5), ["model", "venue"], ("match_id", "venue"))
        plan = tally._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(model") == 1
        if bad:
            with pytest.raises(ValueError, match="identical observations"):
                scoring.require_one_cohort(tally)
        else:
            scoring.require_one_cohort(tally)


def test_event_metrics_and_bins(spark):
    from foretally.operators import scoring

    rows = [("m", "t", D(2020, 1, 1), 0.2, 0), ("m", "t", D(2020, 1, 2), 0.7, 1), ("m", "t", D(2020, 1, 3), 1.0, 1)]
    df = spark.createDataFrame(rows, "model string, target string, match_date date, p double, y int")
    tally = scoring.tally_events(df, ["model", "target"])
    row = scoring.event_metrics(tally, ["model", "target"]).head()
    assert row.brier == pytest.approx((0.04 + 0.09) / 3)
    assert row.ece == pytest.approx((0.2 + 0.3 + 0.0) / 3)
    assert row.calibration_bias == pytest.approx(1.9 / 3 - 2 / 3)
    bins = scoring.calibration_bins(tally, ["model", "target"]).orderBy("bin").collect()
    assert len(bins) == 10 and sum(b.n for b in bins) == 3
    assert bins[9].n == 1 and bins[0].n == 0 and bins[0].mean_predicted is None
