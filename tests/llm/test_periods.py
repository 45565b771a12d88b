import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from foretally.llm import periods
from foretally.llm.recompression import Grammar

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, collapsed int"


def brute_runs(words):
    """(start, length, period) of all runs, every period tried at every place."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and words and h % 10 == 0:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


texts = st.lists(
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 12)).map(lambda x: x[0] * x[1]), max_size=4
).map(lambda parts: sum(parts, []))


@settings(max_examples=250, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_runs_of_any_texts(given_texts):
    codes = np.array(sum(given_texts, []), np.int64)
    offsets = np.cumsum([0, *map(len, given_texts)])
    found = [[] for _ in given_texts]
    for text, *run in zip(*(a.tolist() for a in periods.runs_of(codes, offsets))):
        found[text].append(tuple(run))
    assert found == [brute_runs(t) for t in given_texts]


def test_extensions_on_the_grammar_and_its_mirror():
    draw = random.Random(8)
    for _ in range(60):
        body = [draw.randint(0, draw.choice([0, 1, 4])) for _ in range(draw.randint(2, 90))]
        sequence = np.array([90, *body, 91])
        fences = np.zeros(len(sequence), bool)
        fences[[0, -1]] = True
        grammar = Grammar.of(sequence, fences)
        pairs = [(i, j) for i in range(1, len(body)) for j in range(i + 1, len(body) + 1)]
        left, right = (np.array(side) for side in zip(*pairs))
        ahead = grammar.extension(left, right).tolist()
        back = grammar.mirrored().extension(len(sequence) - left, len(sequence) - right).tolist()
        for (i, j), forward, backward in zip(pairs, ahead, back):
            assert forward == next(k for k in range(len(body) + 1) if j + k > len(body) or sequence[i + k] != sequence[j + k])
            assert backward == next(k for k in range(len(body) + 1) if i - k < 1 or sequence[i - k - 1] != sequence[j - k - 1])


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = periods.digests(periods.collapsed(docs, periods.planted))
    assert sorted(map(tuple, found.collect())) == sorted(brute_row(r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(spark):
    rows = [
        Row(1, None, "", 0), Row(2, "", "", 0), Row(3, " \t\n", "", 0), Row(None, "a b " * 9, "", 0), Row(4, "a " * 5000, "", 0),
        Row(4, "a " * 5000, "", 0), Row(5, "x y x y x y x y x y x y", "", 0), Row(6, "A a A a A a A a", "", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = periods.digests(periods.collapsed(df)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_row(r[0], r[1], plant=False) for r in rows), key=str)
    texts = {r.doc_id: r.collapsed for r in periods.collapsed(df).collect()}
    assert texts[4] == "a" and texts[None] == "a b" and texts[3] == ""
    assert periods.digests(periods.collapsed(spark.createDataFrame([], SCHEMA))).collect() == []
