"""Periodic runs of words in a document, found on a grammar made by recompression.

A run is a stretch of consecutive words with smallest period q whose length is at least ``LEAST_WORDS`` and
``LEAST_POWER`` * q, and that no neighbouring word extends. For each period p, the words at multiples of p are compared
with those p later: a run of period p has three multiples in a row that agree. Each such place is a candidate, and
longest common extensions to both sides, asked on the grammar of the task's texts and on its mirror image, tell
exactly how far period p goes. Stretches found for multiples of a smaller period are the same stretch, and keep the
smallest. Periods of one word are the blocks of the grammar's first level.

A document is one row of work, its texts never meet others' (fences stand between them), and nothing is shuffled.
Work grows as n log n with a text's words.

Nulls and odd input: a null, empty or blank text has no words and no runs. A row with a null doc_id is treated like
any other. Repeated rows are treated one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_pieces, split_words
from foretally.llm.recompression import Grammar

LEAST_WORDS = 6
LEAST_POWER = 4
#: Candidates whose extensions are asked for at once.
_ASKED = 1 << 19
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _candidates(sequence: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(p, places) where the symbols at three multiples of p in a row equal those p later."""
    found = []
    for p in range(2, longest // LEAST_POWER + 1):
        grid = sequence[::p]
        agrees = grid[1:] == grid[:-1]
        places = np.flatnonzero(agrees[:-2] & agrees[1:-1] & agrees[2:])
        if len(places):
            found.append((p, places * p))
    return found


def runs_of(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; ``codes`` has equal numbers for equal words."""
    n_texts = len(offsets) - 1
    if not len(codes):
        return (np.zeros(0, np.int64),) * 4
    # a fence before each text and after the last, each a symbol of its own
    fence_at = offsets + np.arange(n_texts + 1)
    sequence = np.empty(len(codes) + n_texts + 1, np.int64)
    fences = np.zeros(len(sequence), bool)
    fences[fence_at] = True
    sequence[~fences] = codes
    sequence[fence_at] = int(codes.max()) + 1 + np.arange(n_texts + 1)
    grammar = Grammar.of(sequence, fences)
    block = np.flatnonzero(np.diff(grammar.levels[0].starts) >= LEAST_WORDS) if grammar.levels else np.zeros(0, np.int64)
    begins, ends, periods = [], [], []
    if len(block):
        begins, ends = [grammar.levels[0].starts[block]], [grammar.levels[0].starts[block + 1]]
        periods = [np.ones(len(block), np.int64)]
    found = _candidates(sequence, int(np.diff(offsets).max()))
    if found:
        at = np.concatenate([places for _, places in found])
        p = np.repeat([period for period, _ in found], [len(places) for _, places in found])
        backward = grammar.mirrored()
        for first in range(0, len(at), _ASKED):
            g, q = at[first : first + _ASKED], p[first : first + _ASKED]
            end = g + q + grammar.extension(g, g + q)
            begin = g - backward.extension(len(sequence) - g, len(sequence) - g - q)
            long = end - begin >= np.maximum(LEAST_WORDS, LEAST_POWER * q)
            begins.append(begin[long])
            ends.append(end[long])
            periods.append(q[long])
    if not begins:
        return (np.zeros(0, np.int64),) * 4
    begin, end, period = np.concatenate(begins), np.concatenate(ends), np.concatenate(periods)
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[first], end[first], period[first]
    text = np.searchsorted(fence_at, begin, side="right") - 1
    start = begin - fence_at[text] - 1
    order = np.lexsort((period, start, text))
    return text[order], start[order], (end - begin)[order], period[order]


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """For every tenth document by its id's checksum the places of its words with a periodic tail, else None."""
    if doc_id is None or not n:
        return None
    tenth, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return None
    first = tenth % n
    period = 1 + (n - first) // (3 + tenth % 8)
    return np.concatenate([np.arange(first), first + np.arange(n - first) % period])


def collapsed(
    docs: DataFrame,
    reorder: Callable[[object, int], np.ndarray | None] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, runs, collapsed): a document's runs, and its words without the repeats, joined by one space.

    Of each run the first period stays. ``reorder`` may give, from an id and a number of words, the places of the words to
    take in their stead.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def collapse(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = split_words(filled(piece.column(1)))
        if reorder:
            place = np.arange(len(words))
            for row, doc_id in enumerate(piece.column(0).to_pylist()):
                other = reorder(doc_id, int(offsets[row + 1] - offsets[row]))
                if other is not None:
                    place[offsets[row] : offsets[row + 1]] = offsets[row] + other
            words = words.take(pa.array(place))
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, start, length, period = runs_of(codes, offsets)
        change = np.zeros(len(words) + 1, np.int64)
        begin = offsets[:-1][text] + start
        np.add.at(change, begin + period, 1)
        np.add.at(change, begin + length, -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), " ")
        runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period.astype(np.int64))], fields=list(_RUN))
        cuts = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(cuts), runs), texts], ["doc_id", "runs", "collapsed"])

    schema = f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_pieces(rows, collapse, schema, "text")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["small"]).alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """The operator's rows with the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = longest_run(F.col("runs"))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
