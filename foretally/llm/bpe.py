"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it where the hash of the last ``WINDOW`` bytes is small, so
equal passages in different documents give equal chunks. Chunks that occur more than once are
encoded once for the whole corpus; a document refers to them. At both ends of a reused chunk
the join is repaired by encoding again: from the last place before the join to the first place
after it where both sides must agree, a blank after a printing ASCII character, where no token can
reach across. A chunk without two such places agrees with nothing and is encoded with its surroundings.

A fixed-size Bloom filter tells the encoding pass which chunks may be shared. A false hit is a chunk
that is encoded once and used once. Documents without shared chunks, most of them, are
encoded and finished where they are read, and never move.

Nulls and odd input: a null text counts as empty; empty texts have no tokens; rows with a null or repeated id
are encoded one by one; the special token's string in a text becomes the special token; other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_arrow, map_pieces, pieces
from foretally.llm.decontam import filter_passes, seed_filter
from foretally.workspace import settle

#: Bytes that the rolling hash sees, mean bytes between cuts, and the least bytes worth a reference.
WINDOW = 16
MEAN_CHUNK = 512
LEAST_CHUNK = 64
_FACTOR = 0x9E3779B1
_SAFE = re.compile(rb"(?<=[!-~])[ \n]")
# How GPT-2's tokenizer file splits text and writes bytes as characters.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTING = (*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1))


def _byte_of() -> dict[str, int]:
    """The byte behind each character of the tokenizer file."""
    hidden = [b for b in range(256) if b not in PRINTING]
    return {chr(b): b for b in PRINTING} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """The tokenizer file's vocabulary; its merges must be in the order of their ids, as ranks are."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, byte_of = content["model"], _byte_of()
    if model["type"] != "BPE" or content["normalizer"] or content["pre_tokenizer"]["type"] != "ByteLevel" or content["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} isn't a plain byte-level BPE file")
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): at for token, at in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError(f"the merges of {path} aren't in the order of their ids")
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> np.ndarray:
    own = tokenizer(path)
    return own.encode_to_numpy(text, allowed_special=own.special_tokens_set, disallowed_special=())


def packed(path: str, ids: np.ndarray) -> bytes:
    """Ids on their way between stages, in two bytes each where the vocabulary allows it."""
    return ids.astype(_width(path)).tobytes()


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).max_token_value < 1 << 16 else "<u4"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in the texts' joined bytes after which a chunk ends; none is within a character."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    rolled, width = data.astype(np.uint32), 1
    while width < WINDOW:  # hashes of twice the width from two of the width
        rolled = rolled[:-width] * np.uint32(pow(_FACTOR, width, 1 << 32)) + rolled[width:]
        width *= 2
    rolled *= np.uint32(0x85EBCA6B)
    at = np.flatnonzero(rolled < np.uint32((1 << 32) // MEAN_CHUNK)) + WINDOW
    for _ in range(3):
        at = at[at < len(data)]
        at = np.where((data[at] & 0xC0) == 0x80, at + 1, at)
    at = np.unique(at[at < len(data)])
    text = np.searchsorted(offsets, at, side="right") - 1
    return at[(at - offsets[text] >= WINDOW)]


class Chunked:
    """The chunks of a column of texts: their borders, their texts and their 128-bit hashes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = memoryview(texts.buffers()[2])[raw[0] : raw[-1]] if raw[-1] > raw[0] else memoryview(b"")
        self.offsets = raw - raw[0]
        found = cuts(np.frombuffer(self.data, np.uint8), self.offsets)
        self.borders = np.unique(np.concatenate([self.offsets, found]))
        self.sizes = np.diff(self.borders)
        digest = xxhash.xxh3_128_digest
        spans = zip(self.borders[:-1].tolist(), self.borders[1:].tolist())
        hashes = b"".join(digest(self.data[a:b]) for a, b in spans)
        self.hashes = np.frombuffer(hashes, np.int64).reshape(-1, 2)

    def of(self, row: int) -> range:
        """The chunks of a text."""
        begin, end = np.searchsorted(self.borders, self.offsets[row : row + 2])
        return range(int(begin), int(end))


def _chunk_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Each chunk of a piece once, with how often it occurs in it."""
    chunks = Chunked(filled(piece.column(0)))
    hashes = chunks.hashes[chunks.sizes >= LEAST_CHUNK]
    both, counts = np.unique(hashes, axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(counts)], ["h1", "h2", "n"])


def shared_chunks(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(h1, h2) of the chunks that occur more than once."""
    rows = map_pieces(docs.select(F.col(text_column).alias("text")), _chunk_rows, "h1 long, h2 long, n long", "text")
    return settle(rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2"), "shared-chunks")


def safe_inner(chunk: bytes) -> tuple[int, int] | None:
    """The part of a chunk whose tokens don't depend on what is around it."""
    places = [m.start() for m in _SAFE.finditer(chunk)]
    return (places[0], places[-1]) if len(places) > 1 else None


def _digests(path: str, ids: np.ndarray) -> tuple[int, str, str]:
    decoded = tokenizer(path).decode(ids.tolist())
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_PARTS = "array<struct<ids:binary,h1:bigint,h2:bigint,text:binary>>"
_PART = pa.list_(pa.struct([("ids", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("text", pa.binary())]))


def _document_parts(path: str, chunks: Chunked, row: int, shared: np.ndarray, sent: set[tuple[int, int]]) -> list[dict] | None:
    """A text as encoded stretches and references to shared chunks; None if it has no such chunk."""
    parts: list[dict] = []
    start, stop = (int(o) for o in chunks.offsets[row : row + 2])
    at = start
    for k in chunks.of(row):
        if not shared[k]:
            continue
        chunk = bytes(chunks.data[chunks.borders[k] : chunks.borders[k + 1]])
        inner = safe_inner(chunk)
        if inner is None:
            continue
        begin = int(chunks.borders[k])
        if begin + inner[0] > at:  # what is between two reused parts, the edges of both chunks included
            stretch = bytes(chunks.data[at : begin + inner[0]]).decode()
            parts.append({"ids": packed(path, encode(path, stretch))})
        h1, h2 = (int(h) for h in chunks.hashes[k])
        own = {"h1": h1, "h2": h2}
        if (h1, h2) not in sent:
            sent.add((h1, h2))
            own["text"] = chunk[inner[0] : inner[1]]
        parts.append(own)
        at = begin + inner[1]
    if not parts:
        return None
    if stop > at:
        parts.append({"ids": packed(path, encode(path, bytes(chunks.data[at:stop]).decode()))})
    return parts


def encoded(docs: DataFrame, path: str, digests: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), or (doc_id, ids) if ``digests`` is false, of every document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(seed_filter(shared_chunks(docs, text_column).select(F.col("h1").alias("seed"))))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    names = [field.split()[0] for field in made.split(", ")]

    def finished(ids: np.ndarray) -> tuple:
        return _digests(path, ids) if digests else (ids.astype("<u4").tobytes(),)

    def arrays(results: list[tuple]) -> list[pa.Array]:
        kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.binary(),)
        return [pa.array([r[i] for r in results], k) for i, k in enumerate(kinds)]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = filled(piece.column(1))
                chunks = Chunked(texts)
                shared = np.zeros(len(chunks.sizes), bool)
                shared[filter_passes(np.ascontiguousarray(chunks.hashes[:, 0]).view(np.uint64), held.value)] = True
                shared &= chunks.sizes >= LEAST_CHUNK
                sent: set[tuple[int, int]] = set()
                results, parts = [], []
                for row in range(len(texts)):
                    own = _document_parts(path, chunks, row, shared, sent) if shared[chunks.of(row)].any() else None
                    parts.append(own)
                    results.append((None,) * len(names) if own else finished(encode(path, texts[row].as_py())))
                numbers = pa.array(number + np.arange(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [numbers, piece.column(0), *arrays(results), pa.array(parts, _PART)], ["row", "doc_id", *names, "parts"]
                )
                number += len(texts)

    first = settle(map_arrow(rows, first_pass, f"row long, doc_id {kind}, {made}, parts {_PARTS}"), "encoded")
    open_ = first.where("parts is not null")
    refers = open_.select("row", F.posexplode("parts").alias("pos", "part")).select("row", "pos", "part.*")

    def encode_chunks(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = [packed(path, encode(path, t.as_py().decode())) for t in piece.column("text")]
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    # each task sends a chunk once a piece; of those texts, all equal, one is encoded
    texts = refers.where("text is not null").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    store = map_pieces(texts, encode_chunks, "h1 long, h2 long, ids binary", "text")
    reused = refers.where("h1 is not null").select("row", "pos", "h1", "h2").join(store, ["h1", "h2"])
    gathered = reused.groupBy("row").agg(F.collect_list(F.struct("pos", "ids")).alias("reused"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                results = []
                for parts, reused_ in zip(piece.column("parts").to_pylist(), piece.column("reused").to_pylist()):
                    known = {r["pos"]: r["ids"] for r in reused_}
                    joined = b"".join(known[i] if part["h1"] is not None else part["ids"] for i, part in enumerate(parts))
                    results.append(finished(np.frombuffer(joined, _width(path)).astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), *arrays(results)], ["doc_id", *names])

    stripped = F.transform("parts", lambda p: p.dropFields("text")).alias("parts")
    rest = open_.select("row", "doc_id", stripped).join(gathered, "row").select("doc_id", "parts", "reused")
    return first.where("parts is null").select("doc_id", *names).union(map_arrow(rest, second_pass, f"doc_id {kind}, {made}"))
