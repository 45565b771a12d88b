import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foretally.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'st \n\t 　.1é<|endoftext|>", max_size=60)))
def test_tokens_of_any_text(text):
    assert bpe._digests(PATH, bpe.encode(PATH, text)) == brute(text)


def test_chunks_follow_content():
    draw = random.Random(1)
    body = "".join(draw.choice("abcdé 字\n") for _ in range(20000))
    one, two = (bpe.Chunked(pa.array([body, "é" * 40, "", lead + body])) for lead in ("", "other beginning "))
    for chunks in (one, two):
        for row, text in ((0, body), (1, "é" * 40), (2, "")):
            parts = [bytes(chunks.data[chunks.borders[k] : chunks.borders[k + 1]]).decode() for k in chunks.of(row)]
            assert "".join(parts) == text
    shared = {tuple(two.hashes[k]) for k in two.of(0)} & {tuple(two.hashes[k]) for k in two.of(3)}
    assert len(shared) >= len(two.of(0)) - 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab's \n\t .1é", min_size=1, max_size=30), min_size=3, max_size=3))
def test_inner_part_stands_alone(parts):
    left, middle, right = parts
    inner = bpe.safe_inner(middle.encode())
    if inner is None:
        return
    raw = middle.encode()
    cut = [left + raw[: inner[0]].decode(), raw[inner[0] : inner[1]].decode(), raw[inner[1] :].decode() + right]
    joined = [i for p in cut for i in bpe.encode(PATH, p).tolist()]
    assert joined == LIBRARY.encode(left + middle + right, add_special_tokens=False).ids


def sample(spark):
    draw = random.Random(3)
    words = [f"{draw.choice('abcde')}{draw.randrange(900)}" for _ in range(300)]
    passages = [" ".join(draw.choices(words, k=400)) for _ in range(3)]
    rows = []
    for i in range(60):
        own = " ".join(draw.choices(words, k=draw.randrange(200)))
        rows.append((i, own + draw.choice(["", " ", "x", "é", "\n"]) + (passages[i % 3] if i % 2 else "") + draw.choice(["", "'s end", "  two"])))
    rows += [(90, None), (91, ""), (None, passages[0]), (92, "Ha " * 40000), (92, "Ha " * 40000), (93, "字" * 3000), (94, "a<|endoftext|> b"), (95, "x" * 9000)]
    return rows, spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, parts string")


def test_whole_table_against_the_library(spark):
    rows, docs = sample(spark)
    shared = bpe.shared_chunks(docs)
    assert shared.count() > 5
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs.repartition(4), PATH).collect())
    assert found == sorted((str(i), *brute(t)) for i, t in rows)
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bpe.encoded(docs, PATH, digests=False).collect()}
    assert ids[3] == LIBRARY.encode(dict(rows)[3], add_special_tokens=False).ids


def test_empty_table(spark):
    _, docs = sample(spark)
    assert bpe.encoded(docs.limit(0), PATH).collect() == []
