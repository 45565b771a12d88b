import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from foretally.llm import lexical
from foretally.llm.balltree import Best, Tree, Vectors

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n string, score int", "item_id long, text string, term string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    rows = []
    for item_id in {i for i, _ in items if i is not None}:
        asked = Counter(terms(min((t for i, t in items if i == item_id and t is not None), default="")))
        scored = []
        for doc_id, held in counted:
            m = 100 - 25 + 25 * sum(held.values()) * n_docs // length
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (1_000_000_000 * held[t] // (1000 * held[t] + 12 * m))
                for t, n in asked.items()
                if t in held
            )
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        rows += [(item_id, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows)


def ranks(docs, items, **options):
    return sorted(map(tuple, lexical.ranked_search(docs, items, **options).collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" a1Z_É字 \x7f-", max_size=20), max_size=5))
def test_terms_of_any_text(given_texts):
    words, offsets = lexical.terms_of(pa.array(given_texts, pa.string()))
    assert [words[a:b].to_pylist() for a, b in zip(offsets, offsets[1:])] == [terms(t) for t in given_texts]


def test_tree_finds_the_best_and_prunes():
    draw = np.random.default_rng(2)
    n, width, k = 3000, 400, 5
    topic = draw.integers(0, 20, n)
    dense = np.zeros((n, width), np.int64)
    for row in range(n):  # documents of a topic share its terms
        dense[row, topic[row] * 20 + draw.integers(0, 20, 12)] = draw.integers(1, 1000, 12)
    dense[5:9] = dense[4]  # ties
    row, term = np.nonzero(dense)
    vectors = Vectors(np.searchsorted(row, np.arange(n + 1)), term, dense[row, term])
    asked = np.zeros((8, width), np.int64)
    for q in range(8):
        asked[q, q * 20 + draw.integers(0, 20, 10)] = draw.integers(1, 9000, 10)
    row, term = np.nonzero(asked)
    queries = Vectors(np.searchsorted(row, np.arange(9)), term, asked[row, term])
    ids = draw.permutation(n)
    best = [Best(k) for _ in range(8)]
    opened = Tree(ids, vectors, np.ones(width), leaf=16).search(queries, best)
    products = asked @ dense.T
    for q in range(8):
        order = sorted((-s, i) for s, i in zip(products[q].tolist(), ids.tolist()) if s > 0)[:k]
        assert list(zip((-best[q].scores).tolist(), best[q].ids.tolist())) == order
    assert opened < 8 * 256 / 2  # of the leaves


def test_whole_table_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranks(docs, items) == expected
    assert ranks(docs, items, round_terms=100) == expected  # many rounds


def test_odd_rows(spark):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choice("ab c É 字1 Dd ee".split()) for _ in range(draw.randint(0, 9)))) for i in range(60)]
    docs += [(7, "ab ab"), (7, "ab ab"), (None, "ab c"), (70, None), (71, ""), (72, "AB " * 50_000)]
    items = [(1, "ab AB c"), (2, "nothing here"), (2, "dd ee"), (3, None), (4, "---"), (None, "ab"), (5, "É字1 É"), (5, None)]
    left = spark.createDataFrame([Row(d, t, "n", 1) for d, t in docs], DOCS)
    right = spark.createDataFrame([Row(i, t, "t") for i, t in items], ITEMS)
    assert ranks(left, right) == brute_ranks(docs, items)
    assert ranks(left, right, k=3) == brute_ranks(docs, items, 3)
    assert ranks(left.limit(0), right) == ranks(left, right.limit(0)) == []
