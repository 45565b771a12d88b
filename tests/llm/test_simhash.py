import random
import re
from itertools import combinations

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import Row

from foretally.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc_id -> smallest doc_id reachable, by flooding."""
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sorted(prints), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return group


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1cAbÉ\u00a0\u2003字z.", max_size=60)), min_size=1, max_size=6))
def test_fingerprint_of_any_text(texts):
    column = pa.array([t or "" for t in texts], pa.string())
    ours = simhash.majority(*simhash.shingle_hashes(column))
    assert ours.tolist() == [brute_print(t) for t in texts]


def test_long_text_passes_the_lane_width():
    words = [f"w{i % 700}" for i in range(5000)]
    texts = [" ".join(words), "", " ".join(words[:300])]
    ours = simhash.majority(*simhash.shingle_hashes(pa.array(texts)))
    assert ours.tolist() == [brute_print(t) for t in texts]


def test_components_match_flooding(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(90):
        value = base[i % 6]
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            value ^= 1 << draw.randrange(0, 64, 8 if i % 2 else 1)
        prints[i] = value
    chain = draw.getrandbits(64)  # a long chain of single steps
    for i in range(90, 120):
        chain ^= 1 << (i - 90)
        prints[i] = chain
    signed = [(d, v - (1 << 64) if v >> 63 else v) for d, v in prints.items()]
    classes = spark.createDataFrame(signed, "doc_id long, print long").groupBy("print").agg({"doc_id": "min"})
    roots = {r.node: r.root for r in simhash.components(simhash.links(classes.select("print"))).collect()}
    groups = {}
    for d, v in signed:
        groups.setdefault(roots.get(v, v), []).append(d)
    ours = {d: min(members) for members in groups.values() for d in members}
    assert ours == brute_components(prints)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(simhash.F.col("print")).alias("p"), "component_id").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {r.doc_id: r.p for r in rows} == {d: f"{v:016x}" for d, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def test_odd_rows(spark):
    schema = "doc_id long, text string, print string, component_id int"
    rows = [Row(9, None, "x", 1), Row(4, "", "x", 1), Row(None, "a b c", "x", 1), Row(7, "a b c d", "x", 1), Row(7, "a b c d", "x", 1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(4, 4), (7, 7), (7, 7), (9, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
