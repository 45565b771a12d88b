"""Paired bootstrap with draws that depend only on (seed, sample, bucket, draw).

A draw is a 32-bit mix of whole numbers in plain 64-bit arithmetic, so it is the same on any partitioning and in
any engine. Samples are never materialised: a task adds its draws into one partial row per sample, and only those
partial rows are shuffled. The draws of fixtures are made by numpy inside Arrow groups of bounded size, where a
row for each draw would have to be exploded and hashed otherwise; everything else is column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.contracts import BLOCK_SAMPLES, BOOTSTRAP_SEED, IID_SAMPLES
from foretally.workspace import attach, settle, ship_package, spread

#: Units that are drawn from in one place, about.
BUCKET_UNITS = 1 << 18
_SPACE = 2**32


def check_samples(samples: int) -> None:
    if samples <= 0:
        raise ValueError("samples must be greater than zero")


# --- fixed values: multipliers of the integer mix -----------------------------
_SPREAD = 2654435761
_MIX = 0x45D9F3B
_MASK = 0xFFFFFFFF


def with_mix(df: DataFrame, name: str, start: str) -> DataFrame:
    """Add column ``name``: the whole number ``start`` in [0, 2**32) scrambled one to one.

    Every step is a projection of its own, so no step's input is computed twice.
    """
    df = df.withColumn(name, F.expr(f"cast({start} AS BIGINT) & {_MASK}"))
    for _ in range(2):
        df = df.withColumn(name, F.expr(f"(({name} ^ shiftright({name}, 16)) * {_MIX}) & {_MASK}"))
    return df.withColumn(name, F.expr(f"{name} ^ shiftright({name}, 16)"))


def with_sample_key(df: DataFrame, seed: int) -> DataFrame:
    """Per-sample starting point of the mix; needs ``sample``."""
    return with_mix(df, "key", f"{seed * _SPREAD % (_MASK + 1)}L + sample")


def with_drawn_index(df: DataFrame, n: str) -> DataFrame:
    """Index ``idx`` in [0, n) of each ``draw`` (below 2**31) under ``key``."""
    mixed = with_mix(df, "idx", f"((draw * {_SPREAD}L) & {_MASK}) ^ key")
    # coalesce only tells the optimizer that the join key is never NULL
    return mixed.withColumn("idx", F.expr(f"coalesce(idx % {n}, 0L)"))


def unit_tag(key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """``with_mix`` on 32-bit integers, whose products wrap around by themselves."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(_MIX)
    return x ^ (x >> np.uint32(16))


def bucket_draws(total: int, path: Sequence[tuple[int, int, int, bool]], samples: range, seed: int) -> np.ndarray:
    """How many of a sample's ``total`` draws fall into a bucket, for each sample: a binomial for each node above it.

    ``path`` has, from the root down, each node's number, the units on its left and in all, and whether the bucket lies
    to the right. A node's binomial depends on (seed, sample, node) alone, so every task that walks through
    it finds the same number, and the buckets' draws add up.
    """
    counts = np.empty(len(samples), np.int64)
    for i, sample in enumerate(samples):
        draws = total
        for node, left, whole, right in path:
            taken = draws if left == whole else 0
            if draws and 0 < left < whole:
                stream = np.random.Generator(np.random.Philox(key=[seed & _MASK | sample << 32, node]))
                taken = int(stream.binomial(draws, left / whole))
            draws = draws - taken if right else taken
        counts[i] = draws
    return counts


def drawn_sums(values: np.ndarray, bucket: int, draws: np.ndarray, samples: range, seed: int) -> np.ndarray:
    """For each sample the sums of the rows of ``values`` that its draws in this bucket hit."""
    sums = np.zeros((len(samples), values.shape[1]))
    keys = _mixed((seed * _SPREAD + np.arange(samples.start, samples.stop) & _MASK).astype(np.uint32))
    if bucket:
        keys = _mixed(keys + np.uint32(bucket * _SPREAD & _MASK))
    spread_draws = np.arange(draws.max(initial=0), dtype=np.uint32) * np.uint32(_SPREAD)
    size = np.uint32(len(values))
    for i, (key, n) in enumerate(zip(keys, draws)):
        if n:
            hits = np.bincount((_mixed(spread_draws[:n] ^ key) % size).astype(np.int64), minlength=len(values))
            sums[i] = hits @ values
    return sums


_PATH = "array<struct<level: int, node: bigint, left: bigint, whole: bigint, right: boolean>>"


def _bucketed(units: DataFrame, key: Sequence[str], metrics: Sequence[str], groups: list[str], bucket_units: int) -> tuple[DataFrame, DataFrame]:
    """Units with their bucket, and for each bucket its group's units, its depth and the path to it; both written."""
    tagged = units.select(*groups, unit_tag(key).alias("tag"), *[F.col(m).cast("double") for m in metrics])
    totals = settle(tagged.groupBy(*groups).agg(F.count(F.lit(1)).alias("total")), "bootstrap-groups")
    buckets = F.ceil(F.col("total") / bucket_units) - 1
    totals = totals.withColumn("depth", F.when(buckets > 0, F.length(F.bin(buckets))).otherwise(F.lit(0)))
    n_groups, deepest = totals.agg(F.count(F.lit(1)), F.max("depth")).first()
    if not deepest:  # each group is one bucket
        return tagged.withColumn("bucket", F.lit(0)), totals.select("*", F.lit(0).alias("bucket"), F.lit(None).cast(_PATH).alias("path"))
    word = F.conv(F.substring("tag", 1, 8), 16, 10).cast("bigint").alias("word")
    placed = attach(tagged.select("*", word), totals, groups, n_groups).withColumn("bucket", F.expr("shiftright(word, 32 - depth)"))
    placed = settle(placed.drop("word"), "bootstrap-buckets")
    counts = settle(placed.groupBy(*groups, "bucket", "total", "depth").agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    above = counts.select("*", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    above = above.withColumn("node", F.expr("shiftleft(1L, level) + shiftright(bucket, depth - level)"))
    nodes = settle(above.groupBy(*groups, "node").agg(F.sum("n").alias("units")), "bucket-nodes")
    whole = nodes.withColumnRenamed("units", "whole")
    left = nodes.where("node % 2 = 0").select(*groups, (F.col("node") / 2).cast("bigint").alias("node"), F.col("units").alias("left"))
    steps = above.where("level < depth").join(whole, [*groups, "node"]).join(left, [*groups, "node"], "left")
    right = F.expr("shiftright(bucket, depth - level - 1) % 2 = 1")
    step = F.struct("level", "node", F.coalesce("left", F.lit(0)).alias("left"), "whole", right.alias("right"))
    paths = steps.groupBy(*groups, "bucket").agg(F.sort_array(F.collect_list(step)).alias("path"))  # a step a level
    return placed.drop("total", "depth"), settle(counts.join(paths, [*groups, "bucket"], "left"), "bucket-paths")


def iid_draws(
    units: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str],
    samples: int,
    seed: int,
    bucket_units: int = BUCKET_UNITS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Means of as many draws with replacement as a group has units, by sample, through hierarchical splitting.

    Units fall into buckets by the digest of their key, about ``bucket_units`` in each. A binomial tree over the
    buckets' sizes gives each bucket its number of draws in each sample; they are drawn in the bucket, so no index
    leaves it and nothing is looked up elsewhere. What is shuffled are the units, once, and a row for each sample and
    task. Where there are fewer buckets than cores, samples are dealt to several tasks too; that changes no number.
    """
    spark = units.sparkSession
    ship_package(spark)
    groups = list(by) or ["_all"]
    units = units if by else units.withColumn("_all", F.lit(0))
    placed, buckets = _bucketed(units, key, metrics, groups, bucket_units)
    parts = max(1, min(samples, -(-spark.sparkContext.defaultParallelism // max(1, buckets.count()))))
    per_part = -(-samples // parts)
    part = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // per_part) - 1))).alias("part")
    names, kinds = list(metrics), ", ".join(f"`{g}` {units.schema[g].dataType.simpleString()}" for g in groups)

    def draw(group: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
        *own, bucket, part = group
        bucket, total = bucket.as_py(), plan.column("total")[0].as_py()
        path = [(s["node"], s["left"], s["whole"], s["right"]) for s in plan.column("path")[0].as_py() or ()]
        rows = rows.sort_by([("tag", "ascending"), *[(name, "ascending") for name in names]])
        values = np.column_stack([rows.column(name).to_numpy() for name in names])
        dealt = range(part.as_py() * per_part, min(samples, (part.as_py() + 1) * per_part))
        sums = drawn_sums(values, bucket, bucket_draws(total, path, dealt, seed), dealt, seed)
        head = [pa.array([value.as_py()] * len(dealt), value.type) for value in own]
        columns = [*head, pa.array(np.arange(dealt.start, dealt.stop)), pa.array([total] * len(dealt), pa.int64())]
        return pa.table([*columns, *[pa.array(sums[:, i]) for i in range(len(names))]], [*groups, "sample", "total", *names])

    grouping = [*groups, "bucket", "part"]
    dealt = placed.select("*", part).groupBy(*grouping).cogroup(buckets.select("*", part).groupBy(*grouping))
    drawn = dealt.applyInArrow(draw, f"{kinds}, sample long, total long, " + ", ".join(f"`{name}` double" for name in names))
    means = drawn.groupBy(*groups, "sample").agg(*[(F.sum(m) / F.max("total")).alias(m) for m in metrics])
    return means if by else means.drop("_all")


def poisson_thresholds() -> list[int]:
    """Upper tail starts of a unit-rate Poisson variable on the 32-bit scale."""
    cumulative, term, out = 0.0, math.exp(-1.0), []
    for k in range(12):
        cumulative += term
        out.append(math.floor(cumulative * _SPACE))
        term /= k + 1
    return out


def poisson_draws(
    units: DataFrame, key: Sequence[str], metrics: Sequence[str], samples: int, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Sample means with a unit-rate Poisson number of copies per unit.

    Equivalent to n draws with replacement up to the random total, which the ratio divides
    out. No unit is looked up by index, so nothing is broadcast or joined at any n.
    """
    word = lambda start: F.conv(F.substring("tag", start, 8), 16, 10).cast("bigint")
    tagged = units.select(*by, unit_tag(key).alias("tag"), *metrics).select(
        *by, word(1).alias("word_1"), word(9).alias("word_2"), *metrics
    )
    rows = spread(tagged, "word_1").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    keyed = with_mix(with_sample_key(rows, seed), "inner", "word_1 ^ key")
    u = with_mix(keyed, "u", "inner ^ word_2")
    steps = " + ".join(f"IF(u >= {threshold}L, 1, 0)" for threshold in poisson_thresholds())
    weighted = u.withColumn("copies", F.expr(steps))
    total = F.sum("copies")
    return weighted.groupBy(*by, "sample").agg(
        *[F.try_divide(F.sum(F.col("copies") * F.col(m)), total).alias(m) for m in metrics]
    )


def iid_bootstrap(
    fixtures: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str] = ("mae_delta", "brier_delta"),
    samples: int = IID_SAMPLES,
    seed: int = BOOTSTRAP_SEED,
    method: str = "multinomial",
    bucket_units: int = BUCKET_UNITS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Interval of the mean difference per metric from paired resampling of fixtures, for each group of ``by``.

    'multinomial' draws n fixtures with replacement, at every n. 'poisson' is another estimator, used
    only when asked for: each fixture comes in a unit-rate Poisson number of copies.
    Fixtures without a difference are left out.
    """
    check_samples(samples)
    if method not in ("multinomial", "poisson"):
        raise ValueError("method must be 'multinomial' or 'poisson'")
    settled = settle(fixtures.select(*by, *[c for c in key if c not in by], *metrics).dropna(subset=list(metrics)), "bootstrap-units")
    if settled.count() == 0:
        raise ValueError("no predictions are available for bootstrapping")
    if method == "multinomial":
        means = iid_draws(settled, key, metrics, samples, seed, bucket_units, by)
    else:
        means = poisson_draws(settled, key, metrics, samples, seed, by)
    entries = [F.struct(F.lit(m.removesuffix("_delta")).alias("metric"), F.col(m).alias("delta")) for m in metrics]
    return summarise(means.select(*by, "sample", F.inline_outer(F.array(*entries))), [*by, "metric"], samples)


def summarise(deltas: DataFrame, keys: Sequence[str], samples: int) -> DataFrame:
    """Mean, order statistics at truncated ranks and share below zero; one row per sample comes in."""
    ordered = F.sort_array(F.collect_list("delta"))
    low, high = int(0.025 * (samples - 1)), int(0.975 * (samples - 1))
    return deltas.groupBy(*keys).agg(
        F.avg("delta").alias("mean_delta"),
        F.element_at(ordered, low + 1).alias("lower_95"),
        F.element_at(ordered, high + 1).alias("upper_95"),
        (F.count_if(F.col("delta") < 0) / F.lit(float(samples))).alias("share_below_zero"),
    )


def block_bootstrap(
    blocks: DataFrame, keys: Sequence[str], samples: int = BLOCK_SAMPLES, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """Interval of the ratio of sums from resampling whole blocks, per key.

    The number of blocks is bounded by the calendar, not by the data. Draws depend only on the
    number of blocks, so they are counted once per distinct number and shared by all keys.
    """
    check_samples(samples)
    blocks = settle(blocks, "blocks")
    by_key = Window.partitionBy(*keys)
    indexed = blocks.withColumn("blocks", F.count(F.lit(1)).over(by_key)).withColumn(
        "idx", (F.row_number().over(by_key.orderBy("block_id")) - 1).cast("bigint")
    )
    sizes = indexed.select("blocks").distinct()
    drawn = (
        sizes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    )
    drawn = (
        with_drawn_index(with_sample_key(drawn, seed), "blocks")
        .groupBy("blocks", "sample", "idx")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ratios = (
        drawn.join(indexed.select(*keys, "blocks", "idx", "n", "s"), ["blocks", "idx"])
        .groupBy(*keys, "sample")
        .agg((F.sum(F.col("copies") * F.col("s")) / F.sum(F.col("copies") * F.col("n"))).alias("delta"))
    )
    point = indexed.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("delta_brier"), F.count(F.lit(1)).alias("blocks")
    )
    return point.join(summarise(ratios, keys, samples), list(keys))
