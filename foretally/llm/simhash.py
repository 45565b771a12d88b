"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour at distance one or
less from both. Every distinct fingerprint therefore emits the 65 values of its ball of radius
one; the shuffle on these values brings all linked fingerprints together. A value's bucket
holds at most 65 fingerprints, whatever the data, since they all lie in the ball around the
value; they also lie within two bits of each other, so tying each to the smallest one loses no
link for the components. Equal fingerprints are folded first, so copies are never paired.

Nulls and odd input: a null text counts as empty (fingerprint zero); a row with a null
doc_id is left out, as it can neither be named nor be a component; repeated rows are kept and
share their component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_pieces, text_mark, words_of
from foretally.workspace import settle

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
#: Shingles summed at once in eight-bit lanes.
_LANE = 255


@functools.cache
def _spread_table() -> np.ndarray:
    """For a byte, its eight bits as the eight byte lanes of one integer."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and where each text's shingles start."""
    words, offsets = words_of(texts)
    counts = np.diff(offsets)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    # one buffer of all words, each followed by a space: a shingle is a slice of it
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
    buffer = memoryview(joined[0].as_buffer()) if len(words) else memoryview(b"")
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    per_text = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(per_text)])
    first = np.arange(starts[-1]) - np.repeat(starts[:-1], per_text) + np.repeat(offsets[:-1], per_text)
    last = np.minimum(first + SHINGLE_WORDS, np.repeat(offsets[1:], per_text))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[first].tolist(), (begins[last] - 1).tolist())
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in spans), np.uint64, count=len(first))
    return hashes, starts


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's hashes."""
    n = np.diff(starts)
    result = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return result
    lanes = -(-n[full] // _LANE)
    lane_of = np.concatenate([[0], np.cumsum(lanes)])
    within = np.arange(lane_of[-1]) - np.repeat(lane_of[:-1], lanes)
    cuts = np.repeat(starts[:-1][full], lanes) + within * _LANE
    table, octets = _spread_table(), hashes.view(np.uint8).reshape(-1, 8)
    for octet in range(8):
        packed = np.add.reduceat(table[octets[:, octet]], cuts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), lane_of[:-1], axis=0)
        over = np.packbits(counts * 2 > n[full][:, None], axis=1, bitorder="little").ravel()
        result[full] |= over.astype(np.uint64) << np.uint64(8 * octet)
    return result


def _fingerprint_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
    prints = majority(*shingle_hashes(filled(piece.column(1))))
    return pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def _marked_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
    prints = majority(*shingle_hashes(filled(piece.column(1))))
    return pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(prints.view(np.int64))], ["doc_id", "mark", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print) with the 64 bits of the fingerprint as a signed long."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_pieces(rows.where("doc_id is not null"), _fingerprint_piece, "doc_id long, print long", "text")


def ball(value: Column) -> Column:
    """The value and its 64 neighbours at one bit."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(BITS)])


def links(prints: DataFrame) -> DataFrame:
    """(lo, hi): links between distinct fingerprints that connect all within two bits of each other.

    The ball values are shuffled once; a bucket's rows, at most 65, are tied to its smallest fingerprint.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few numbers a row here, but each becomes 65 rows below
    even = prints.select("print").repartition(parts, "print")
    near = even.select(F.col("print").alias("hi"), F.explode(ball(F.col("print"))).alias("near"))
    tied = near.withColumn("lo", F.min("hi").over(Window.partitionBy("near"))).where("lo <> hi")
    return tied.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= 2).select("lo", "hi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of an edge can reach, by rounds of star contraction.

    Each round ties the neighbours of a node to its smallest neighbour, first the larger ones,
    then the smaller ones; minima are combined before the shuffle and hubs are joined, where
    adaptive execution splits them, never gathered. Rounds grow with the logarithm of the
    longest chain.
    """

    def with_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    current = settle(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")), "star")
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "star")
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = with_least(oriented)
        small = small.select(F.col("v").alias("a"), "m").union(small.select(F.col("u").alias("a"), "m"))
        current = settle(small.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "star")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = now


def _firsts(prints: DataFrame, order: Column) -> DataFrame:
    """(print, first): the smallest ``order`` of the rows that links reach from a fingerprint."""
    classes = settle(prints.groupBy("print").agg(F.min(order).alias("least")), "classes")
    roots = settle(components(links(classes.select("print"))), "roots")
    labelled = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    labelled = settle(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("first"))
    return labelled.select("print", "root").join(least, "root").select("print", "first")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print, component_id): component_id is the smallest doc_id that links reach."""
    prints = settle(fingerprints(docs, id_column, text_column), "prints")
    named = _firsts(prints, F.col("doc_id")).withColumnRenamed("first", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def hex_digits(value: Column) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def repeated_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, mark, drop): rows, named by id and hash of the text, that aren't their component's first, or are it more than once.

    A component's first row is that with the smallest doc_id, then the smallest hash. ``drop`` is false for a
    first row that exact repeats share.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), text_mark(F.col(text_column)).alias("mark"))
    prints = settle(map_pieces(rows.where("doc_id is not null"), _marked_piece, "doc_id long, mark long, print long", "text"), "prints")
    row = F.struct("doc_id", "mark")
    found = prints.join(_firsts(prints, row), "print").select("doc_id", "mark", (row != F.col("first")).alias("drop"))
    counted = found.groupBy("doc_id", "mark").agg(F.bool_or("drop").alias("drop"), F.count(F.lit(1)).alias("n"))
    return settle(counted.where("drop or n > 1").drop("n"), "repeats")


def repeats_folded(docs: DataFrame, repeats: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of exact repeats that the written table ``repeats`` (doc_id, mark) names; only those are moved."""
    if repeats.isEmpty():
        return docs
    twice = repeats.select(F.col("doc_id").alias("twice_id"), F.col("mark").alias("twice_mark"))
    here = (docs[id_column].cast("long") == twice["twice_id"]) & (text_mark(docs[text_column]) == twice["twice_mark"])
    whole = F.struct(*[F.col(c) for c in docs.columns])
    moved = docs.join(twice, here, "left_semi").select(id_column, text_mark(F.col(text_column)).alias("mark"), whole.alias("row"))
    once = moved.groupBy(id_column, "mark").agg(F.first("row").alias("row")).select("row.*")
    return docs.join(twice, here, "left_anti").union(once)
