"""Removal of byte passages that an earlier document holds, by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

1. Exact copies are folded by digest: the copy with the smallest doc_id stands for all, the others go whole.
2. Every string of ``LENGTH`` bytes is named by the smallest hash among its grams of ``GRAM`` bytes. Equal strings
   have equal names, so only names that two rows or more hold matter. A filter of these names (its size follows
   their measured number, see ``bitset``) picks the stretches of text that go on: first as hashes alone, which tell
   the names with one stretch from those with several, then the bytes of the latter, folded where equal.
3. The stretches of a name are dealt to one task. Each batch there is a shard: it sorts its suffixes into a
   Burrows-Wheeler transform, and the shards' transforms are merged by interleave refinement (``bwt``), which
   gives the intervals of equal strings and with them each string's first document. A name with one stretch has one
   such interval for each string and needs no merge, nor does a stretch none of whose strings has a hash that its
   task meets again. A name with more than ``HOT_ROWS`` rows isn't dealt to one
   task: its different stretches are cut into single strings, which Spark groups by their bytes.
4. What a document has to give up goes back to it by (doc_id, hash of the text); copies get theirs in the same join.

Nulls and odd input: a null text is empty. A row with a null doc_id has no place in the order: it loses nothing
and takes nothing from others. Rows that share a doc_id are one document to others and take nothing from each
other; each gets its own result. Texts under ``LENGTH`` bytes lose nothing. An empty table gives an empty
result; other columns are ignored. Texts are cut in bytes, so what is kept needn't be whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm import bitset, bwt
from foretally.llm.common import bytes_of, map_arrow, map_pieces, pieces, text_mark
from foretally.workspace import BROADCAST_BYTES, attach, settle

LENGTH = 50
GRAM = 20
#: Stretches of one name, copies included, up to which the name is dealt to one task: with ``STRETCH_STARTS``, 7 MB at most.
HOT_ROWS = 1 << 16
#: Strings that start in a stretch, at most: a longer one is cut into several that overlap.
STRETCH_STARTS = 64
#: Bytes of stretches that a task merges, about.
TASK_BYTES = 8 << 20
_MERGE_BYTES = 1 << 20
_HASH_PIECE = 1 << 16
_RUN = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("least", pa.int64())])
_SPANS = "spans array<struct<start: long, stop: long>>"
_RUNS = "runs array<struct<at: int, n: int, least: long>>"


def _words(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes (1, 2, 4 or 8) that start at each byte as one number."""
    words, covered = data, 1
    for kind in (np.uint16, np.uint32, np.uint64)[: width.bit_length() - 1]:
        wide = words.astype(kind)
        words, covered = wide[:-covered] | wide[covered:] << kind(8 * covered), 2 * covered
    return words


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes that start at each byte, from words of up to eight bytes that cover them."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    width = min(8, 1 << (length.bit_length() - 1))
    words = _words(data, width)
    hashes = np.zeros(len(data) - length + 1, np.uint64)
    mixed = np.empty_like(hashes)
    for at in [*range(0, length - width, width), length - width]:
        hashes += words[at : at + len(hashes)]
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        np.right_shift(hashes, np.uint64(32), out=mixed)
        hashes ^= mixed
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(hashes, np.uint64(29), out=mixed)
    hashes ^= mixed
    return hashes


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, first start, starts): maximal runs of starts in a text whose strings share a name."""
    if len(data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    least, wide, width = gram_hashes(data, gram), 1, length - gram + 1
    while wide * 2 <= width:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    # a run also begins where a text does, and where a text has no more starts
    begin = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=begin[1:-1])
    long = np.flatnonzero(np.diff(offsets) >= length)
    begin[offsets[:-1][long]] = True
    begin[offsets[1:][long] - (length - 1)] = True
    first = np.flatnonzero(begin)
    first, n = first[:-1], np.diff(first)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(first, offsets)))
    inside = np.flatnonzero(first + length <= offsets[1:][text])
    first, n, text = first[inside], n[inside], text[inside]
    # long runs are cut at every STRETCH_STARTS starts from their first
    cuts = -(-n // STRETCH_STARTS)
    if len(cuts) and cuts.max() > 1:
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, n, text = (np.repeat(x, cuts) for x in (first, n, text))
        first, n = first + part * STRETCH_STARTS, np.minimum(n - part * STRETCH_STARTS, STRETCH_STARTS)
    return least[first], text, first - offsets[:-1][text], n


def _slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of ``data`` as binary values."""
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))])


def _runs(least: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each stretch its starts' first documents, equal neighbours as one run."""
    offsets = np.concatenate([[0], np.cumsum(starts)])
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[offsets[:-1]] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(offsets, first, side="right") - 1
    n = np.diff(np.append(first, len(least)))
    values = pa.StructArray.from_arrays(
        [pa.array((first - offsets[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least[first])], fields=list(_RUN)
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, offsets).astype(np.int32)), values)


def first_documents(shards: list[tuple[pa.Array, np.ndarray]], length: int) -> np.ndarray:
    """The smallest document of the equal strings at each start of the stretches, shard by shard.

    A shard is its stretches' bytes and their documents. Every stretch has ``length`` bytes or more.
    """
    flat = [bytes_of(segments) for segments, _ in shards]
    held = np.bincount(np.concatenate([data for data, _ in flat]), minlength=256) > 0
    codes, bits = np.where(held, np.cumsum(held), 0).astype(np.uint16), int(held.sum()).bit_length()
    numbers = bwt.numbered([(codes[data], offsets) for data, offsets in flat], bits) if length % (2 * bwt.STRIDE) == 0 else [None] * len(flat)
    transforms, left, documents = [], [], []
    for (data, offsets), (_, least), own in zip(flat, shards, numbers):
        made = bwt.transform(codes[data], offsets, bits, own, length)
        transforms.append(made)
        sizes = np.diff(offsets)
        left.append((np.repeat(offsets[1:], sizes) - np.arange(len(data)))[made.order].astype(np.int32))
        documents.append(np.repeat(least, sizes)[made.order])
    del numbers, own
    blocks = bwt.merged_blocks(transforms, length, bits)
    whole = np.concatenate(left) >= length
    smallest = np.full(int(blocks.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, blocks[whole], np.concatenate(documents)[whole])
    parts, at = [], 0
    for made, own in zip(transforms, left):
        n = len(made.order)
        found, is_start = np.empty(n, np.int64), np.empty(n, bool)
        found[made.order] = smallest[blocks[at : at + n]]
        is_start[made.order] = own >= length
        parts.append(found[is_start])
        at += n
    return np.concatenate(parts)


def shared(shards: list[pa.Array], length: int) -> list[np.ndarray]:
    """For each stretch of the shards, whether the hash of a string of it is met a second time.

    Equal strings have equal hashes, so a stretch that isn't marked holds no string that another start has.
    """
    flat = [bytes_of(segments) for segments in shards]
    starts = [np.diff(offsets) - (length - 1) for _, offsets in flat]
    hashes = []
    for (data, offsets), n in zip(flat, starts):
        place = np.arange(n.sum()) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
        hashes.append(gram_hashes(data, length)[place])
    hashes = np.concatenate(hashes)
    place = np.uint64((1 << len(hashes).bit_length()) - 1)
    keyed = np.sort(hashes & ~place | np.arange(len(hashes), dtype=np.uint64))
    again = np.flatnonzero((keyed[1:] ^ keyed[:-1]) <= place)
    starts = np.concatenate(starts)
    met = np.zeros(len(hashes) + 1, np.int64)
    met[1 + (keyed[np.concatenate([again, again + 1])] & place).astype(np.int64)] = 1
    up_to, ends = np.cumsum(met), np.cumsum(starts)
    marked = up_to[ends] > up_to[ends - starts]
    return np.split(marked, np.cumsum([len(segments) for segments in shards])[:-1])


def _merge(length: int):
    """The runs of a task's stretches that a later document may need: its batches are the shards of its merges.

    Names share no strings, so a task merges a part of its names at a time. A stretch without a string whose hash is
    met again needs no merge: its strings' first document is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        merges = -(-sum(batch.column("segment").nbytes for batch in given) // _MERGE_BYTES)
        turns = [(batch.column("name").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(7)) % np.uint64(max(1, merges)) for batch in given]
        for turn in range(merges):
            shards = [shard for batch, own in zip(given, turns) if (shard := batch.filter(pa.array(own == turn))).num_rows]
            if not shards:
                continue
            merging = [pa.array(own) for own in shared([s.column("segment") for s in shards], length)]
            parts = [part for shard, own in zip(shards, merging) if (part := shard.filter(own)).num_rows]
            merged = first_documents([(p.column("segment"), p.column("least").to_numpy(zero_copy_only=False)) for p in parts], length) if parts else np.zeros(0, np.int64)
            at = 0
            for shard, own in zip(shards, merging):
                starts = np.diff(bytes_of(shard.column("segment"))[1]) - length + 1
                least = np.repeat(shard.column("least").to_numpy(zero_copy_only=False), starts)
                inside = np.repeat(own.to_numpy(zero_copy_only=False), starts)
                found, n = least.copy(), int(inside.sum())
                found[inside] = merged[at : at + n]
                at += n
                # a stretch of one document whose strings come first there takes nothing from any row
                use = shard.column("again").to_numpy(zero_copy_only=False) | (np.minimum.reduceat(found - least, np.cumsum(starts) - starts) < 0)
                kept = shard.filter(pa.array(use))
                runs = _runs(found[np.repeat(use, starts)], starts[use])
                yield pa.RecordBatch.from_arrays([kept.column("name"), kept.column("seg"), runs], ["name", "seg", "runs"])

    return run


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), text_mark(text).alias("mark"))


def copies(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark) of rows whose whole text a smaller doc_id has; written."""
    ids = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    ids = settle(ids.select("doc_id", "mark", F.unhex(F.md5("text")).alias("digest")), "digests")
    firsts = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return settle(ids.join(firsts, "digest").where("doc_id > first").select("doc_id", "mark").distinct(), "copies")


def shared_names(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Names that two rows or more hold; written."""

    def names(piece: pa.RecordBatch) -> pa.RecordBatch:
        name, text, _, _ = stretches(*bytes_of(piece.column("text")), length, gram)
        # equal pairs are neighbours after one sort of their hashes with the place in the low bits; the pairs decide
        place = np.uint64((1 << len(name).bit_length()) - 1)
        hashes = name ^ text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = (np.sort(hashes & ~place | np.arange(len(name), dtype=np.uint64)) & place).astype(np.int64)
        name, text = name[order], text[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        return pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64))], ["name"])

    held = map_pieces(docs.select("text"), names, "name long", "text", _HASH_PIECE)
    return settle(held.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")


def _filter_of(names: DataFrame, most_bits: int):
    """A broadcast filter of written names, sized by their number."""
    return names.sparkSession.sparkContext.broadcast(bitset.gathered(names, "name", bitset.bits_for(names.count(), most_bits)))


def _held_stretches(docs: DataFrame, names: DataFrame, length: int, gram: int, most_bits: int, with_bytes: bool) -> DataFrame:
    """The stretches whose name the filter of ``names`` may hold, as (doc_id, mark, start, n, name, seg) or (doc_id, name, seg, segment)."""
    held = _filter_of(names, most_bits)

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = bytes_of(piece.column("text"))
        name, text, start, n = stretches(data, offsets, length, gram)
        keep = np.flatnonzero(bitset.may_hold(held.value, name))
        name, text, start, n = name[keep], text[keep], start[keep], n[keep]
        begin = offsets[:-1][text] + start
        buffer, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        ends = zip(begin.tolist(), (begin + n + length - 1).tolist())
        seg = pa.array(np.fromiter((digest(buffer[a:b]) for a, b in ends), np.uint64, count=len(begin)).view(np.int64))
        rows, name = pa.array(text), pa.array(name.view(np.int64))
        doc_id = piece.column("doc_id").take(rows)
        if with_bytes:
            return pa.RecordBatch.from_arrays([doc_id, name, seg, _slices(data, begin, n + length - 1)], ["doc_id", "name", "seg", "segment"])
        mark = piece.column("mark").take(rows)
        return pa.RecordBatch.from_arrays([doc_id, mark, pa.array(start), pa.array(n), name, seg], ["doc_id", "mark", "start", "n", "name", "seg"])

    schema = "doc_id long, name long, seg long, segment binary" if with_bytes else "doc_id long, mark long, start long, n long, name long, seg long"
    return map_pieces(docs.select("doc_id", "mark", "text"), cut, schema, "text", _HASH_PIECE)


def _merged_runs(docs: DataFrame, several: DataFrame, length: int, gram: int, hot: int, most_bits: int, task_bytes: int) -> DataFrame:
    """(name, seg, runs) of the stretches of names that have more than one; ``several`` has (name, n) with all their rows counted."""
    spark = docs.sparkSession
    found = _held_stretches(docs, several, length, gram, most_bits, True)
    # a filter lets some other names through: they go with the join below
    folded = found.groupBy("name", "segment").agg(F.min("doc_id").alias("least"), F.min("seg").alias("seg"), (F.min("doc_id") < F.max("doc_id")).alias("again"))
    distinct = settle(folded, "distinct")
    crowded = settle(several.where(F.col("n") > hot).select("name"), "crowded")
    n_crowded = crowded.count()
    total = distinct.agg(F.sum(F.length("segment"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    few = attach(distinct, crowded, ["name"], n_crowded, "left_anti") if n_crowded else distinct
    merged = map_arrow(few.repartition(parts, "name"), _merge(length), f"name long, seg long, {_RUNS}")
    if not n_crowded:
        return merged
    starts = F.sequence(F.lit(1), F.length("segment") - (length - 1))
    strings = F.transform(starts, lambda i: F.substring(F.col("segment"), i, F.lit(length)))
    single = attach(distinct, crowded, ["name"], n_crowded, "left_semi").select("name", "seg", "least", F.posexplode(strings).alias("at", "string"))
    single = settle(single, "strings")
    earliest = single.groupBy("string").agg(F.min("least").alias("least"))
    cut = single.drop("least").join(earliest, "string")
    return merged.union(cut.groupBy("name", "seg").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "least")).alias("runs")))


def passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_ROWS, most_bits: int = bitset.MOST_BITS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, mark, whole, spans) of rows that lose bytes: the whole text, or spans of it; written."""
    whole = copies(docs, length)
    own = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    own = attach(own, whole.select("doc_id", "mark"), ["doc_id", "mark"], whole.count(), "left_anti")
    found = settle(_held_stretches(own, shared_names(own, length, gram), length, gram, most_bits, False), "stretches")
    by_name = found.groupBy("name").agg(
        F.min("seg").alias("seg"), F.max("seg").alias("last_seg"), F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.max("n").alias("starts"), F.count(F.lit(1)).alias("n")
    )
    by_name = settle(by_name.where("least < last"), "by-name")
    only = by_name.where("seg = last_seg").select("name", "seg", F.array(F.struct(F.lit(0).alias("at"), F.col("starts").cast("int").alias("n"), "least")).alias("runs"))
    several = by_name.where("seg <> last_seg").select("name", "n")
    runs = settle(only.union(_merged_runs(own, several, length, gram, hot, most_bits, task_bytes)), "runs")
    later = F.filter("runs", lambda r: r["least"] < F.col("doc_id"))
    ranges = F.transform(later, lambda r: F.struct((F.col("start") + r["at"]).alias("at"), r["n"].alias("n"))).alias("ranges")
    hits = found.select("doc_id", "mark", "start", "name", "seg").join(runs, ["name", "seg"]).select("doc_id", "mark", ranges)
    gathered = hits.where(F.size("ranges") > 0).groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    spans = map_arrow(gathered, _joined(length), f"doc_id long, mark long, {_SPANS}")
    nothing = F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("spans")
    return settle(spans.select("doc_id", "mark", F.lit(False).alias("whole"), "spans").union(whole.select("doc_id", "mark", F.lit(True), nothing)), "passages")


def _joined(length: int):
    """The starts of a row's strings as spans of bytes that neither meet nor overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges")
            row = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy(zero_copy_only=False))
            start = ranges.flatten().field("at").to_numpy(zero_copy_only=False)
            stop = start + ranges.flatten().field("n").to_numpy(zero_copy_only=False) + (length - 1)
            order = np.lexsort((start, row))
            row, start, stop = row[order], start[order], stop[order]
            far = row * (stop.max(initial=0) + 1)  # rows apart, so that one running maximum serves all
            reach = np.maximum.accumulate(far + stop)
            first = np.ones(len(row), bool)
            first[1:] = far[1:] + start[1:] > np.maximum(reach[:-1], far[1:] - 1)
            at = np.flatnonzero(first)
            ends = (reach - far)[np.append(at[1:], len(row)) - 1] if len(row) else start
            spans = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(ends)], ["start", "stop"])
            cuts = pa.array(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.ListArray.from_arrays(cuts, spans)], ["doc_id", "mark", "spans"])

    return run


def _covered(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the piece's texts, where the texts start, and which bytes go."""
    data, offsets = bytes_of(piece.column("text"))
    spans = piece.column("spans")
    base = np.repeat(offsets[:-1], spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start, stop = (base + spans.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("start", "stop"))
    whole = np.flatnonzero(piece.column("whole").fill_null(False).to_numpy(zero_copy_only=False))
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.concatenate([start, offsets[whole]]), 1)
    np.add.at(change, np.concatenate([stop, offsets[whole + 1]]), -1)
    return data, offsets, np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) with the remaining bytes of every row."""
    rows = _keyed(docs, id_column, text_column)
    lost = passages(rows, length, gram, **limits)
    n_rows, n_spans = lost.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("spans"), F.lit(0)))).first()
    small = 64 * n_rows + 32 * (n_spans or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(lost) if small else lost, ["doc_id", "mark"], "left")

    def remove(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, gone = _covered(piece)
        up_to = np.concatenate([[0], np.cumsum(gone)])
        removed = up_to[offsets[1:]] - up_to[offsets[:-1]]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        edge[inner] = gone[inner]  # a text's first byte starts a span of its own
        spans = np.concatenate([[0], np.cumsum(edge)])
        n_spans = spans[offsets[1:]] - spans[offsets[:-1]]
        kept = _slices(data[~gone], (offsets[:-1] - up_to[offsets[:-1]]), np.diff(offsets) - removed)
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), kept],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    chosen = joined.select("doc_id", "text", "whole", "spans")
    return map_pieces(chosen, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", "text")
