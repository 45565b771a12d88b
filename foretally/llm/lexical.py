"""Ranked lexical search: each item's best documents by an integer score of shared terms.

1. One scan counts, for every document, its terms and those of them that an item asks for. Totals and document
   frequencies are sums over the written counts.
2. A term's weight belongs to the item's vector and a term's damped frequency to the document's, so a score is an inner
   product of sparse vectors of whole numbers. Tasks pack the documents they read into ball trees of
   ``TREE_ROWS`` and search each for all items (``balltree``), holding on to each item's best scores from tree to
   tree; the best of all tasks are ranked by a window.

Only the terms of the items are looked for, so what each task holds grows with the items. Items are asked in rounds
of about ``ROUND_TERMS`` pairs of item and term; a round is a scan of its own, and rounds change nothing in the
result.

Nulls and odd input: a null or empty text has no terms, a document without terms counts for nothing, an item without
terms finds nothing. Documents with a null id count in all statistics but can't be ranked; items with a null id
don't ask. Of items that share an id the one with the smallest text asks. Documents that share an id are ranked one
by one. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.balltree import Best, Tree, Vectors
from foretally.llm.common import bytes_of, filled, map_arrow, map_pieces, split_words
from foretally.workspace import settle, spread

K = 20
ROUND_TERMS = 1 << 17
TREE_ROWS = 4096
#: Parts of vectors in a tree, about: long documents make smaller trees.
TREE_PARTS = 1 << 20
BLOCK_ITEMS = 16
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"


@functools.cache
def _plain() -> bytes:
    """For each byte: letters A-Z in lower case, other bytes of terms as they are, the rest a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for low, high, shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0)):
        table[low:high] = bytes(range(low + shift, high + shift))
    return bytes(table)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, and where each text's terms start."""
    data, offsets = bytes_of(texts)
    plain = pa.py_buffer(data.tobytes().translate(_plain()))
    return split_words(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), plain]))


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id, term, count) of every item that has terms; written."""
    texts = items.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("item_id")).agg(F.min(text_column).alias("text"))
    kind = texts.schema["item_id"].dataType.simpleString()

    def split(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = terms_of(filled(piece.column(1)))
        owner = pa.array(np.repeat(np.arange(piece.num_rows), np.diff(offsets)))
        return pa.RecordBatch.from_arrays([piece.column(0).take(owner), words], ["item_id", "term"])

    terms = map_pieces(texts, split, f"item_id {kind}, term string", "text")
    return settle(terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count")), "item-terms")


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: how many, and how often each of the vocabulary's; written."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = terms_of(filled(piece.column(1)))
        n = np.diff(offsets)
        codes = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.flatnonzero(codes >= 0)
        keys, counts = np.unique(np.repeat(np.arange(len(n)), n)[held] * len(vocabulary) + codes[held], return_counts=True)
        starts = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * len(vocabulary)).astype(np.int32))
        terms = pa.ListArray.from_arrays(starts, pa.array((keys % len(vocabulary)).astype(np.int32)))
        batch = pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n), terms, pa.ListArray.from_arrays(starts, pa.array(counts.astype(np.int64)))], ["doc_id", "n", "terms", "counts"]
        )
        return batch.filter(pa.array(n > 0))

    return settle(map_pieces(docs, count, _POSTINGS, "text"), "postings")


def _weights(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, all their terms, weight by term); one row a term reaches the driver."""
    total, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    holders = np.zeros(terms, np.int64)
    holders[held.column("term").to_numpy()] = held.column("n").to_numpy()
    return total, length, np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * h + 1))) for h in holders.tolist()], np.int64)


def _trees(batches: Iterator[pa.RecordBatch], total: int, length: int, weights: np.ndarray) -> Iterator[Tree]:
    """Trees over the documents of a task, as they come."""
    kept, rows, parts = [], 0, 0

    def tree() -> Tree:
        table = pa.Table.from_batches(kept).combine_chunks()
        counts = table.column("counts").combine_chunks()
        sizes = counts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, tf = table.column("n").to_numpy(), counts.flatten().to_numpy(zero_copy_only=False)
        mass = np.repeat(100 - 25 + 25 * n * total // length, sizes)
        values = 1_000_000_000 * tf // (1000 * tf + 12 * mass)
        terms = table.column("terms").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return Tree(table.column("doc_id").to_numpy(), Vectors(np.concatenate([[0], np.cumsum(sizes)]), terms, values), weights)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            kept.append(piece)
            rows, parts = rows + piece.num_rows, parts + len(piece.column("terms").flatten())
            if rows >= TREE_ROWS or parts >= TREE_PARTS:
                yield tree()
                kept, rows, parts = [], 0, 0
    if kept:
        yield tree()


def _round(docs: DataFrame, asked: pa.Table, kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score): candidates for the items of a round, k of each task and item at most; written."""
    vocabulary = pc.unique(asked.column("term"))
    items = pc.unique(asked.column("item_id"))
    found = postings(docs, vocabulary)
    total, length, weights = _weights(found, len(vocabulary))
    item = pc.index_in(asked.column("item_id"), value_set=items).to_numpy().astype(np.int64)
    term = pc.index_in(asked.column("term"), value_set=vocabulary).to_numpy().astype(np.int64)
    order = np.lexsort((term, item))
    item, term, count = item[order], term[order], asked.column("count").to_numpy()[order]
    blocks = []
    for at in range(0, len(items), BLOCK_ITEMS):
        a, b = np.searchsorted(item, [at, at + BLOCK_ITEMS])
        size = min(BLOCK_ITEMS, len(items) - at)
        blocks.append(Vectors(np.searchsorted(item[a:b], np.arange(at, at + size + 1)), term[a:b], count[a:b] * weights[term[a:b]]))
    held = docs.sparkSession.sparkContext.broadcast((items, blocks, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, blocks, weights = held.value
        best = [[Best(k) for _ in range(len(block))] for block in blocks]
        for tree in _trees(batches, total, length, weights):
            for block, own in zip(blocks, best):
                tree.search(block, own)
        flat = [b for own in best for b in own]
        names = pa.array(np.repeat(np.arange(len(flat)), [len(b.ids) for b in flat]))
        if len(names):
            columns = [items.take(names), pa.array(np.concatenate([b.ids for b in flat])), pa.array(np.concatenate([b.scores for b in flat]))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    ranked = found.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    return settle(map_arrow(spread(ranked), search, f"item_id {kind}, doc_id long, score long"), "candidates")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    round_terms: int = ROUND_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, higher scores first, then smaller ids."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = item_terms(items, item_column, item_text_column)
    kind = asked.schema["item_id"].dataType.simpleString()
    n_rounds = -(-asked.count() // round_terms)
    results = []
    for number in range(n_rounds):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_rounds)) == number).toArrow()  # about round_terms rows
        if own.num_rows:
            results.append(_round(rows, own, kind, k))
    if not results:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = functools.reduce(DataFrame.union, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
