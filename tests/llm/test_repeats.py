import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from foretally.llm import bitset, bwt, repeats

SCHEMA = "doc_id long, text string, kept string, mark int, ranges string"


def brute_cut(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept) from a dictionary of all strings."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            string = data[i : i + length]
            first[string] = min(doc_id, first.get(string, doc_id))
    result = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((doc_id, len(data), sum(gone), n_spans, kept))
    return sorted(result, key=str)


def cut(df, **options):
    return sorted((tuple(map(lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x, r)) for r in repeats.deduplicated(df, **options).collect()), key=str)


def flat(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])


def test_merged_transforms_give_the_blocks_of_sorted_suffixes():
    draw = random.Random(5)
    for _ in range(150):
        alphabet = [0, 97, 98, 255][: draw.randint(1, 4)]
        shards = [
            [bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) for _ in range(draw.randint(0, 6))] for _ in range(draw.randint(1, 4))
        ]
        depth, prefixes, made = draw.choice([5, 10, 20]), [], []
        for strings in shards:
            data, offsets = flat(strings)
            made.append(bwt.transform(data.astype(np.int64) + 1, offsets, 9))
            owner = np.repeat(np.arange(len(strings)), np.diff(offsets))
            suffixes = [(strings[owner[p]][p - offsets[owner[p]] :], owner[p]) for p in made[-1].order]
            assert suffixes == sorted(suffixes)  # equal suffixes by string
            prefixes += [s[:depth] for s, _ in suffixes]
        numbers = {p: i for i, p in enumerate(sorted(set(prefixes)))}
        assert bwt.merged_blocks(made, depth, 9).tolist() == [numbers[p] for p in prefixes]
    with pytest.raises(ValueError):
        bwt.merged_blocks(made, 7, 9)


def test_merge_by_wide_steps_gives_the_same_blocks():
    draw = random.Random(6)
    for _ in range(150):
        alphabet = [0, 97, 98, 255][: draw.randint(1, 4)]
        shards = [[bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 45))) for _ in range(draw.randint(0, 6))] for _ in range(draw.randint(1, 4))]
        depth, prefixes, made = draw.choice([10, 20, 40]), [], []
        sets = [(data.astype(np.int64) + 1, offsets) for data, offsets in map(flat, shards)]
        for strings, (symbols, offsets), numbers in zip(shards, sets, bwt.numbered(sets, 9)):
            made.append(bwt.transform(symbols, offsets, 9, numbers, depth))
            owner = np.repeat(np.arange(len(strings)), np.diff(offsets))
            prefixes += [strings[owner[p]][p - offsets[owner[p]] :][:depth] for p in made[-1].order]
        numbers = {p: i for i, p in enumerate(sorted(set(prefixes)))}
        assert bwt.merged_blocks(made, depth, 9).tolist() == [numbers[p] for p in prefixes]
        if made[0].stride == 10:
            with pytest.raises(ValueError):
                bwt.merged_blocks(made, 15, 9)


def test_stretches_are_the_runs_of_starts_with_one_name():
    draw = random.Random(8)
    for length, gram in ((50, 20), (30, 8), (12, 5), (10, 1)) * 8:
        texts = [bytes(draw.choice(b"ab") for _ in range(draw.choice([0, 5, length - 1, length, 80]))) + b"x" * draw.choice([0, 0, 200]) for _ in range(draw.randint(1, 8))]
        name, text, start, n = repeats.stretches(*flat(texts), length, gram)
        named, seen = {}, []
        for t, first, count, own in zip(text.tolist(), start.tolist(), n.tolist(), name.tolist()):
            assert 1 <= count <= repeats.STRETCH_STARTS
            for i in range(first, first + count):
                seen.append((t, i))
                string = np.frombuffer(texts[t][i : i + length], np.uint8)
                assert own == repeats.gram_hashes(string, gram).min() == named.setdefault(string.tobytes(), own)
        assert seen == [(t, i) for t, data in enumerate(texts) for i in range(len(data) - length + 1)]


def stretch_rows(segments):
    """Stretches of one name as a task gets them; document and hash are the row's number, each in one document."""
    number = pa.array(range(len(segments)), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([7] * len(segments), pa.int64()), number, pa.array(segments, pa.binary()), number, pa.array([False] * len(segments))],
        ["name", "seg", "segment", "least", "again"],
    )


def test_only_stretches_with_a_string_met_again_are_merged(monkeypatch):
    phrase = b"a passage that two of these stretches hold as a whole"
    segments = [hashlib.sha512(bytes([i])).digest() for i in range(40)]
    segments[11], segments[30] = segments[11] + phrase, phrase + segments[30]
    merged, first_documents = [], repeats.first_documents
    monkeypatch.setattr(repeats, "first_documents", lambda shards, length: merged.extend(s for part, _ in shards for s in part.to_pylist()) or first_documents(shards, length))

    def result():
        merged.clear()
        rows = stretch_rows(segments)
        return [r for batch in repeats._merge(50)(iter([rows.slice(0, 20), rows.slice(20)])) for r in batch.to_pylist()]

    starts = len(phrase) - 49
    expected = [{"name": 7, "seg": 30, "runs": [{"at": 0, "n": starts, "least": 11}, {"at": starts, "n": 64, "least": 30}]}]
    assert result() == expected and merged == [segments[11], segments[30]]
    # a hash that all strings share sends all of them to the merge, with the same result
    monkeypatch.setattr(repeats, "gram_hashes", lambda data, length: np.zeros(len(data) - length + 1, np.uint64))
    assert result() == expected and merged == segments


def test_filter_holds_all_at_any_size(spark):
    values = [random.Random(2).getrandbits(63) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    for bits in (bitset.bits_for(3000), 1 << 12):
        words = bitset.gathered(df, "h", bits)
        assert len(words) * 64 == bits and bitset.may_hold(words, np.array(values, np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert bitset.may_hold(bitset.gathered(df, "h", bitset.bits_for(3000)), others).mean() < 0.03


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute_cut([(r.doc_id, r.text) for r in docs.collect()])
    assert cut(docs) == expected
    # every limit leads to another way with the same rows
    assert cut(docs, hot=2) == expected
    assert cut(docs, most_bits=1 << 12, task_bytes=2000) == expected


def test_passages_of_every_shape(spark):
    draw = random.Random(11)
    alphabet = "ab é字\n"

    def text(n):
        return "".join(draw.choice(alphabet) for _ in range(n))

    shared = [text(k) for k in (20, 49, 50, 51, 90, 300)]
    rows = []
    for doc_id in range(60):
        parts = [draw.choice([text(draw.randint(0, 60)), draw.choice(shared), "x" * draw.choice([30, 70, 400])]) for _ in range(draw.randint(0, 5))]
        rows.append((doc_id - 20, "".join(parts)))
    rows += [(100, rows[7][1]), (100, rows[8][1]), (100, rows[8][1]), (101, rows[7][1]), (None, rows[7][1]), (None, None), (102, None), (103, "")]
    df = spark.createDataFrame([Row(d, t, "k", 1, "r") for d, t in rows], SCHEMA)
    assert cut(df) == brute_cut(rows)
    assert cut(df, hot=1) == brute_cut(rows)
    assert cut(df, length=30, gram=8) == brute_cut(rows, 30)


def test_a_passage_within_one_document_stays(spark):
    passage = "one passage that is long enough to be removed if it stood in two documents"
    df = spark.createDataFrame([Row(1, f"{passage} - {passage}", "", 0, ""), Row(2, f"<{passage}>", "", 0, "")], SCHEMA)
    rows = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.deduplicated(df).collect()}
    assert rows[1][:2] == (0, 0)
    assert rows[2] == (len(passage), 1, b"<>")


def test_hot_phrase_in_different_contexts(spark):
    rows = [(i, f"{hashlib.md5(str(i % 150).encode()).hexdigest()} the phrase that every text of this table holds {hashlib.md5(str(i % 70).encode()).hexdigest()}") for i in range(300)]
    df = spark.createDataFrame([Row(d, t, "", 0, "") for d, t in rows], SCHEMA)
    expected = brute_cut(rows)
    assert cut(df, hot=20) == expected == cut(df)


def test_no_rows(spark):
    assert repeats.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
