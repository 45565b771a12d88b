import random
import re

import pyarrow as pa

from foretally.llm import decontam


def kept(text):
    words = [w.strip(".,;:!?\"'()[]{}<>|*#$%&-_~`").lower() for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or "")]
    return [w for w in words if w]


def brute_tiles(item, doc, least=5):
    """Greedy string tiling by comparing every pair of places."""
    free_item, free_doc, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best, found = least, []
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and free_item[a + n] and free_doc[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best:
                    found.append((a, b))
        if not found:
            return covered
        for a, b in sorted(found):
            if all(free_item[a : a + best]) and all(free_doc[b : b + best]):
                covered += best
                for k in range(best):
                    free_item[a + k] = free_doc[b + k] = False


def test_tiles_against_brute_force():
    draw = random.Random(6)
    for _ in range(150):
        item = [draw.randrange(4) for _ in range(draw.randint(5, 25))]
        doc = [draw.randrange(4) for _ in range(draw.randint(0, 40))]
        cut = draw.randint(0, len(item))
        doc += item[cut:] + [9] + item[:cut]
        tiles = decontam.tile(item, dict(enumerate(doc)))
        assert sum(n for *_, n in tiles) == brute_tiles(item, doc)
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)


def test_words_and_seeds():
    texts = ["One, two | three\tFOUR five. É", "", "a b c d e f", "x"]
    hashes, offsets = decontam.word_hashes(pa.array(texts))
    assert offsets.tolist() == [0, 6, 6, 12, 13] and [len(kept(t)) for t in texts] == [6, 0, 6, 1]
    _, first = decontam.seeds_of(hashes, offsets)
    assert first.tolist() == [0, 1, 6, 7]


def sample(spark):
    draw = random.Random(9)
    items = [" ".join(f"q{draw.randrange(400)}" for _ in range(draw.randint(12, 40))) for _ in range(25)] + ["a b c", None, "", " ".join(["same"] * 12)]
    docs = []
    for i in range(160):
        words = [f"w{draw.randrange(500)}" for _ in range(80)]
        if i % 4 == 0:
            item = items[draw.randrange(25)].split()
            half = len(item) // 2
            planted = {0: item, 4: item[half:] + ["gap"] + item[:half], 8: item[:half]}[i % 12]
            words[40:40] = [w.upper() + "," for w in planted]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[3]), (502, ("filler " * 30000) + items[5]), (502, items[6]), (503, "same " * 3000), (504, "a b c d e")]
    docs.append((505, " ".join(items[:3])))
    df = spark.createDataFrame([(i, t, [1], 0.5) for i, t in docs], "doc_id long, text string, items array<int>, coverage double")
    return docs, items, df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def expected(docs, items):
    out = {}
    for doc_id, text in docs:
        words = kept(text)
        for at, item in enumerate(items):
            own = kept(item)
            seeds = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            near = [k for k in range(len(words) - 4) if tuple(words[k : k + 5]) in seeds][:60]
            if near:
                part = words[max(0, near[0] - 2) : near[-1] + 60]
                if brute_tiles(own, part[:400]) / len(own) >= 0.8:
                    out.setdefault(doc_id, set()).add(at)
    return out


def test_whole_table_both_join_ways(spark, monkeypatch):
    docs, items, df, benchmark = sample(spark)
    planted = expected(docs, items)
    assert len(planted) > 25 and 503 in planted and 505 in planted
    rows = decontam.judged(df, benchmark).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: set(r.items) for r in rows if r.contaminated} == planted
    assert all(r.coverage == 0 and r.items == [] for r in rows if not r.contaminated)
    monkeypatch.setattr(decontam, "fits_broadcast", lambda *_: False)
    again = decontam.judged(df, benchmark).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    clean = decontam.without_ids(df, decontam.contaminated(df, benchmark))
    assert clean.schema == df.schema and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - set(planted)


def test_empty_tables(spark):
    _, _, df, benchmark = sample(spark)
    assert decontam.judged(df.limit(0), benchmark).collect() == []
    assert not any(r.contaminated for r in decontam.judged(df, benchmark.limit(0)).collect())


def test_rows_of_a_null_or_repeated_id_keep_their_own_verdict(spark):
    _, items, _, benchmark = sample(spark)
    clean = [f"clean words of row {i} that no item of the benchmark has" for i in range(6)]
    rows = [(None, items[3]), (None, clean[0]), (None, clean[1]), (None, None), (7, items[4]), (7, clean[2]), (7, ""), (8, clean[3]), (8, items[5]), (8, items[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in decontam.without_contaminated(docs, benchmark).collect()), key=str)
    assert left == sorted([(None, clean[0]), (None, clean[1]), (None, None), (7, clean[2]), (7, ""), (8, clean[3])], key=str)
    found = [(r.contaminated, r.items) for r in decontam.judged(docs, benchmark).collect() if r.doc_id is None]
    assert sorted(found) == [(False, []), (False, []), (False, []), (True, [3])]
