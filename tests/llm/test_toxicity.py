import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foretally.llm import quality, toxicity
from foretally.llm.fitting import held_out


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, the shortest of equals, then the same left and right of it."""

    def split(low, high):
        best = None
        for a in range(low, high):
            total = 0
            for b in range(a, high):
                total += scores[b]
                if total > 0 and (best is None or (total, a - b) > (best[2], best[0] - best[1])):
                    best = (a, b, total)
        if best is None:
            return []
        return split(low, best[0]) + [best] + split(best[1] + 1, high)

    return split(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3, -3, -3, 1, 2, 5, 10, 20]), max_size=40))
def test_segments_match_their_definition(scores):
    places = [i for i, s in enumerate(scores) if s > 0]
    found = toxicity.maximal_segments(places, [float(scores[i]) for i in places], 3.0)
    expected = brute_segments(scores)
    assert sorted((a, b, round(s)) for a, b, s in found) == sorted(expected)


def sample_tables(spark, n=900):
    draw = random.Random(11)
    plain = [f"word{i}" for i in range(120)]
    rude = ["grobian", "lout", "oaf"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = draw.choices(plain, k=60)
        if toxic:
            for _ in range(6):
                words[draw.randrange(60)] = draw.choice(rude + ["nasty" + draw.choice("abcdefghijklmnop") + draw.choice("xyz")])
        docs.append((i, " ".join(words), "en", i))
        labels.append((i, int(toxic)))
    docs += [(5000, None, "en", 1), (5001, "", "en", 1), (None, "lout lout oaf", "en", 1), (5002, "OAF, lout! " * 4000, "en", 1), (5002, "OAF, lout! " * 4000, "en", 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"),
        spark.createDataFrame([*labels, (5001, None), (None, 1)], "doc_id long, toxic int"),
    )


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = sample_tables(spark)
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    kept = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(kept) > 200 and sum(r.predicted == (r.doc_id % 5 == 0) for r in kept) / len(kept) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score and by[5000].predicted == 0
    assert all(r.predicted == 1 for r in rows if r.doc_id == 5002)
    assert by[None].held_out is False and by[None].n_passages == 1


def test_filter_keeps_all_columns_and_clean_rows(spark):
    docs, labels = sample_tables(spark)
    model = toxicity.fit(docs, labels)
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    scores = {(r.doc_id, r.score < toxicity.REJECT) for r in toxicity.score_documents(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, clean in scores if clean}


def test_fold_and_no_labels(spark):
    import zlib

    ids = spark.range(50).select("id", held_out(toxicity.F.col("id")).alias("h")).collect()
    assert [r.h for r in ids] == [zlib.crc32(str(r.id).encode()) % 3 == 1 for r in ids]
    docs, labels = sample_tables(spark, 10)
    rows = toxicity.judged(docs, labels.limit(0)).collect()
    assert len({r.score for r in rows}) == 1
    assert toxicity.judged(docs.limit(0), labels).collect() == []


def test_word_without_support_falls_back_to_its_beginning():
    table = [("nastyab", 4, 0), ("nastycd", 5, 0), ("nastyef", 6, 0), ("common", 30, 600), ("nastyok", 0, 40)]
    model = toxicity.term_scores(table + [(f"w{i}", 3, 60) for i in range(50)])
    scores = toxicity.token_scores(pa.array(["nastyzz", "nastyok", "common", "other"]), model)
    assert scores[0] > 0 and scores[1] <= 0 and scores[2] <= 0 and scores[3] == -toxicity.DRIFT


def clean_bests(n, seed):
    """Word counts and best segments of clean texts whose words score at random."""
    draw = random.Random(seed)
    counts, bests = [], []
    for _ in range(n):
        words = draw.randint(30, 400)
        scores = {i: draw.expovariate(1.4) for i in range(words) if draw.random() < 0.03}
        found = toxicity.maximal_segments(list(scores), list(scores.values()), 0.2)
        counts.append(words)
        bests.append(max((s for *_, s in found), default=0.0))
    return np.array(counts, float), np.array(bests)


def test_e_values_of_held_out_clean_texts_match_their_counts():
    n, best = clean_bests(4000, 1)
    model = toxicity.ToxicModel()
    model.log_k, model.scale = toxicity.fit_law(n, best)
    n, best = clean_bests(4000, 2)
    e_values = np.array([math.exp(-toxicity.evidence(s, k, model)) if s > 0 else math.inf for s, k in zip(best, n)])
    for limit in (0.3, 0.1, 0.03, 0.01):
        expected, observed = len(n) * (1 - math.exp(-limit)), int((e_values <= limit).sum())
        assert expected / 2 <= observed <= expected * 2, (limit, expected, observed)


def test_law_of_exact_extremes_is_found_and_odd_samples_have_one():
    draw = np.random.default_rng(3)
    n = draw.integers(50, 500, 20000).astype(float)
    best = np.maximum((np.log(n * 0.02) - np.log(draw.exponential(size=len(n)))) / 0.6, 0)
    log_k, scale = toxicity.fit_law(n, best)
    assert abs(scale - 0.6) < 0.02 and abs(log_k - math.log(0.02)) < 0.05
    for n, best in (([], []), ([0, 0], [0, 0]), ([10, 20], [0, 0]), ([10, 20], [1.5, 1.5]), ([10] * 50, [2.0] * 50)):
        assert all(map(math.isfinite, toxicity.fit_law(np.array(n, float), np.array(best, float))))


def test_an_id_with_a_third_of_all_documents_is_one_row_of_the_sample(spark):
    docs, labels = sample_tables(spark, 600)
    kept = next(i for i in range(600) if not held_out_by_hand(i))
    many = spark.range(300).selectExpr(f"{kept}L AS doc_id", "concat('word1 word2 text ', id) AS text", "'en' AS lang", "1 AS score")
    long = spark.createDataFrame([(1, "lout " * 5000, "en", 1)], docs.schema)
    sample = toxicity.labelled_sample(docs.unionByName(many).unionByName(long), labels, "toxic").collect()
    ids = [r.doc_id for r in sample]
    assert len(ids) == len(set(ids)) == sum(not held_out_by_hand(i) for i in range(600))
    assert max(len(r.text) for r in sample) <= 16 << 10
    hot = docs.unionByName(many)
    assert toxicity.judged(hot, labels).count() == quality.judged(hot, labels.withColumnRenamed("toxic", "quality")).count() == hot.count()


def held_out_by_hand(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1
