"""Benchmark decontamination by greedy string tiling.

Five-word seeds that a document shares with an item start everything: a scan tests every
five-word window of a document against a fixed-size Bloom filter of the benchmark's seeds, and
the windows that pass are joined exactly with the seeds of the items. For each document and
item, greedy string tiling repeatedly marks the longest matches that don't overlap, found by
Karp-Rabin hashes of the unmarked windows; tiles keep neither the order nor the place of a
passage, so reordered passages are found too. A document is contaminated by an item if tiles
cover ``COVERAGE`` or more of the item's words.

Words are lower-cased and trimmed of punctuation; words of punctuation alone are skipped. Words are
compared by their 64-bit hashes.

Nulls and odd input: a null or empty text is clean; items of fewer than five words (or null) have no
seed and match nothing; a null item_id counts like any other id; rows that share a doc_id are judged
one by one and reported together as one document, rows with a null doc_id each for itself; the filter
drops a row by its own text alone; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_arrow, pieces, text_mark, words_of
from foretally.llm.toxicity import normal_form
from foretally.workspace import fits_broadcast, settle

SEED_WORDS = 5
COVERAGE = 0.8
FILTER_BITS = 1 << 24
_PROBES = 3
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each kept word, and where each text's words start."""
    words, offsets = words_of(texts)
    coded = pc.dictionary_encode(words)
    forms = normal_form(coded.dictionary).to_pylist()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(f) for f in forms), np.uint64, count=len(forms))
    kept = np.fromiter((bool(f) for f in forms), bool, count=len(forms))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = kept[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return (hashes[codes][keep] if len(codes) else np.zeros(0, np.uint64)), before[offsets]


def seeds_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of five words inside a text."""
    n = len(hashes) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = hashes[:n].copy()
    for k in range(1, SEED_WORDS):
        rolled *= np.uint64(_BASE)
        rolled += hashes[k : n + k]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(_MIX)
    rolled ^= rolled >> np.uint64(29)
    inside = np.ones(n, bool)
    for k in range(1, SEED_WORDS):  # windows over a border of two texts
        ends = offsets[1:-1] - k
        inside[ends[(ends >= 0) & (ends < n)]] = False
    first = np.flatnonzero(inside)
    return rolled[first], first


def benchmark_seeds(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words) of every item that has seeds, and (seed, item, place)."""
    rows = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, offsets = word_hashes(filled(piece.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(piece.num_rows)), piece.column(0), lists], ["item", "item_id", "words"])
                number += piece.num_rows

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            seed, first = seeds_of(hashes, offsets - offsets[0])
            row = np.searchsorted(offsets - offsets[0], first, side="right") - 1
            places = first - (offsets - offsets[0])[row]
            items = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(items), pa.array(places.astype(np.int32))], ["seed", "item", "place"])

    items = settle(map_arrow(rows, split, f"item long, item_id {kind}, words array<long>").where(F.size("words") >= SEED_WORDS), "items")
    return items, settle(map_arrow(items.select("item", "words"), windows, "seed long, item long, place int"), "seeds")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of all seeds, of ``FILTER_BITS`` bits whatever their number."""
    probes = [F.shiftrightunsigned("seed", 20 * i).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(_PROBES)]
    bits = seeds.select(F.explode(F.array(*probes)).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    table = cells.toArrow()  # at most FILTER_BITS / 64 rows
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[table.column("cell").to_numpy()] = table.column("mask").to_numpy()
    return held.view(np.uint64)


def filter_passes(seed: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the seeds that the filter may hold."""
    chosen = np.arange(len(seed))
    for i in range(_PROBES):
        bit = (seed[chosen] >> np.uint64(20 * i)) & np.uint64(FILTER_BITS - 1)
        chosen = chosen[(held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return chosen


def tile(item: list[int], document: dict[int, int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, length): the longest matches first, none overlapping on either side.

    ``document`` has the word at each place that may match. Ties go to the smaller item place, then
    the smaller document place.
    """
    mask = (1 << 61) - 1
    marked_item, free = [False] * len(item), dict(document)
    power = pow(_BASE, least - 1, mask)

    def rolled(words: list[int]) -> list[int]:
        """Karp-Rabin hashes of all windows of ``least`` words."""
        value, out = 0, []
        for i, word in enumerate(words):
            if i >= least:
                value -= (words[i - least] % mask) * power
            value = (value * _BASE + word) % mask
            if i >= least - 1:
                out.append(value)
        return out

    tiles: list[tuple[int, int, int]] = []
    while True:
        index: dict[int, list[int]] = defaultdict(list)
        for begin, end in _runs([i for i, m in enumerate(marked_item) if not m]):
            for k, value in enumerate(rolled(item[begin:end])):
                index[value].append(begin + k)
        best, found = least, []
        for begin, end in _runs(sorted(free)):
            for k, value in enumerate(rolled([free[p] for p in range(begin, end)])):
                place = begin + k
                for at in index.get(value, ()):
                    if at and not marked_item[at - 1] and free.get(place - 1) == item[at - 1]:
                        continue  # part of a longer match that began before
                    length = 0
                    while at + length < len(item) and not marked_item[at + length] and free.get(place + length) == item[at + length]:
                        length += 1
                    if length >= best:
                        if length > best:
                            best, found = length, []
                        found.append((at, place))
        if not found:
            return tiles
        for at, place in sorted(found):
            if not any(marked_item[at : at + best]) and all(p in free for p in range(place, place + best)):
                tiles.append((at, place, best))
                for k in range(best):
                    marked_item[at + k] = True
                    del free[place + k]


def _runs(places: list[int]) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of consecutive numbers."""
    begin = None
    for i, place in enumerate(places):
        if begin is None:
            begin = place
        if i + 1 == len(places) or places[i + 1] != place + 1:
            yield begin, place + 1
            begin = None


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, coverage) for every row and item that share a seed; mark is the hash of the row's text."""
    items, seeds = benchmark_seeds(benchmark)
    held = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))  # of fixed size
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), text_mark(F.col(text_column)).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, offsets = word_hashes(filled(piece.column(1)))
                seed, first = seeds_of(hashes, offsets)
                hit = filter_passes(seed, held.value)
                row = np.searchsorted(offsets, first[hit], side="right") - 1
                places = (first[hit] - offsets[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(row)),
                        piece.column(2).take(pa.array(row)),
                        pa.array(number + row),
                        pa.array(places),
                        pa.array(seed[hit].view(np.int64)),
                    ],
                    ["doc_id", "mark", "row", "pos", "seed"],
                )
                number += piece.num_rows

    hits = settle(map_arrow(rows, scan, f"doc_id {kind}, mark long, row long, pos int, seed long"), "hits")
    small = fits_broadcast(seeds.schema, n_seeds := seeds.count()) and n_seeds
    matched = hits.join(F.broadcast(seeds) if small else seeds, "seed")
    grouped = matched.groupBy("row", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.collect_list(F.struct("pos", "place")).alias("shared")
    )
    paired = grouped.join(F.broadcast(items) if small else items, "item")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for words, shared in zip(batch.column("words").to_pylist(), batch.column("shared")):
                pos, place = (shared.values.field(i).to_pylist() for i in (0, 1))
                document = {p + k: words[a + k] for p, a in zip(pos, place) for k in range(SEED_WORDS)}
                shares.append(sum(length for *_, length in tile(words, document)) / len(words))
            own = [batch.column(c) for c in ("doc_id", "mark", "item_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shares, pa.float64())], ["doc_id", "mark", "item_id", "coverage"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, item_id {item_kind}, coverage double"
    return map_arrow(paired.select("doc_id", "mark", "item_id", "words", "shared"), cover, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, by: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, coverage, items) of the contaminated documents: their best coverage and the items found.

    ``by`` has the columns of a group: doc_id and mark for each row's own verdict.
    """
    found = overlaps(docs, benchmark).where(F.col("coverage") >= coverage)
    return settle(found.groupBy(*by).agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("items")), "contaminated")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, coverage, items) of every row; clean rows have no items and coverage 0."""
    unnamed = F.col("doc_id").isNull()  # such rows are no common document
    found = contaminated(docs, benchmark, by=("doc_id", F.when(unnamed, F.col("mark")).alias("mark")))
    found = found.withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    rows = docs.select("doc_id", F.when(unnamed, text_mark(F.col("text"))).alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & F.col("mark").eqNullSafe(F.col("found_mark"))
    joined = rows.join(found, same, "left")
    none = F.array().cast(found.schema["items"].dataType)
    return joined.select(
        "doc_id",
        F.col("coverage").isNotNull().alias("contaminated"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("items", none).alias("items"),
    )


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in the written table ``ids``.

    The ids are broadcast if their measured number fits the limit; else both sides are shuffled.
    """
    dropped = ids.select(F.col("doc_id").alias("dropped_id"))
    gone = docs["doc_id"].eqNullSafe(dropped["dropped_id"])
    return docs.join(F.broadcast(dropped) if fits_broadcast(dropped.schema, dropped.count()) else dropped, gone, "left_anti")


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't those of a row of the written table ``rows`` (doc_id, mark)."""
    dropped = rows.select(F.col("doc_id").alias("dropped_id"), F.col("mark").alias("dropped_mark"))
    gone = docs["doc_id"].eqNullSafe(dropped["dropped_id"]) & (text_mark(docs["text"]) == dropped["dropped_mark"])
    return docs.join(F.broadcast(dropped) if fits_broadcast(dropped.schema, dropped.count()) else dropped, gone, "left_anti")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text is clean; a null or repeated doc_id takes no other row along."""
    return without_rows(docs, contaminated(docs, benchmark, by=("doc_id", "mark")))
