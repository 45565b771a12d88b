import math

import numpy as np
import pytest

from foretally.llm import topk


def brute(rows, asks, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    found = []
    for q, a in asks:
        if q is None or not usable(a):
            continue
        a = [math.floor(256 * x) for x in a]
        scored = [(-sum(x * math.floor(256 * y) for x, y in zip(a, v)), i) for i, v in rows if i is not None and i != q and usable(v) and len(v) == len(a)]
        found += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("round_bytes", [1, 1 << 25])
def test_against_brute_force(spark, round_bytes):
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=4)]) for i in range(300)]
    rows += [(300 + i, list(rows[7][1])) for i in range(150)]  # a large group of equal vectors
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(950, [1.0, 2.0]), (951, [0.5, -1.0]), (1000, [3.0, 4.0]), (1050, [1.0]), (None, [1.0] * 4), (7, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    asks = df.where("vec_id % 50 = 0")
    found = topk.top_k(df, asks, rows=32, round_bytes=round_bytes).collect()
    expected = brute(rows, [(i, v) for i, v in rows if i is not None and i % 50 == 0], 5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == expected


def test_large_numbers_take_integer_products(spark):
    rows = [(0, [1.0e7, 1.0]), (1, [1.0e7, 2.0]), (2, [1.0e7, 3.0]), (3, [-1.0e7, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(r[2], r[3]) for r in brute(rows, rows[:1], 5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).collect() == []


def test_usable_row_of_a_repeated_query_id_asks(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [None, 1.0]), (0, [2.0, 1.0]), (50, [-inf, 0.0]), (50, [0.5, 3.0]), (50, [nan, 0.0]), (50, None), (100, [nan, None]), (1, [1.0, 2.0]), (2, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows, [(0, [2.0, 1.0]), (50, [0.5, 3.0])], 5)
