import itertools
import math
import random

import numpy as np
import pyarrow as pa

from foretally.llm import quality


def test_marginals_by_enumeration():
    draw = np.random.default_rng(2)
    offsets = np.array([0, 1, 4, 9, 11])
    bad, moves = draw.normal(size=11) * 3, draw.normal(size=(2, 2))
    p, pairs, log_z = quality.marginals(bad, moves, offsets)
    total_pairs, total_z, expected = np.zeros((2, 2)), 0.0, np.zeros(11)
    for a, b in zip(offsets, offsets[1:]):
        z, held = 0.0, np.zeros(b - a)
        own_pairs = np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            weight = math.exp(sum(bad[a + i] for i, x in enumerate(labels) if x) + sum(moves[x, y] for x, y in zip(labels, labels[1:])))
            z += weight
            held += weight * np.array(labels)
            for x, y in zip(labels, labels[1:]):
                own_pairs[x, y] += weight
        expected[a:b] = held / z
        total_pairs += own_pairs / z
        total_z += math.log(z)
    assert np.allclose(p, expected) and np.allclose(pairs, total_pairs) and abs(log_z - total_z) < 1e-9


def test_line_features_by_hand():
    texts = pa.array(["Ab 1!\nAb 1!\n", "", "x x x"])
    features, offsets, lengths = quality.line_features(texts)
    assert offsets.tolist() == [0, 3, 4, 5] and lengths.tolist() == [5, 5, 0, 0, 5]
    own = features[:, 1:14]
    assert np.allclose(own[0, :9], [0.2, 0.2, 0.2, 0.2, 0, 0.2, 0, 0, 0])
    assert own[:, 10].tolist() == [0, 1, 0, 0, 0]  # lines seen before in the text
    assert np.allclose(own[4, 9], 2 / 3)
    assert np.allclose(features[1, 14:27], own[0]) and not features[0, 14:27].any() and not features[3, 28:41].any()


def sample_tables(spark, n=600):
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join(draw.choices(["the", "house", "stands", "near", "a", "green", "hill"], k=draw.randint(4, 12))).capitalize() + "." for _ in range(draw.randint(1, 6))]
        if not good:
            lines[1:] = [draw.choice(["BUY!! NOW!! " * 5, "a | b | c | " * 4, "ha " * 20]) for _ in range(draw.randint(1, 8))]
        docs.append((i, "\n".join(lines), i))
        labels.append((i, int(good)))
    docs += [(9000, None, 1), (9001, "", 1), (None, "A house.", 1), (9002, "ha ha\n" * 9000, 1), (9002, "ha ha\n" * 9000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = sample_tables(spark)
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    kept = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in kept) / len(kept) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[9001].score and 0 <= by[9000].score <= 1
    assert len({r.score for r in rows if r.doc_id == 9002}) == 1 and by[9002].predicted == 0


def test_no_labels_and_empty_table(spark):
    docs, labels = sample_tables(spark, 10)
    assert len({r.score for r in quality.judged(docs, labels.limit(0)).collect()}) == 1
    assert quality.judged(docs.limit(0), labels).collect() == []
