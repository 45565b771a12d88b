"""Helpers shared by the text operators: bounded Arrow pieces, ASCII words, table reading."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in unpacked form at a time; a longer single row is a piece of its own.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` that hold about ``limit`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver found it.

    On a cluster the package is installed or given at submit time; a path that isn't there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return df.mapInArrow(function, schema)


def map_pieces(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over pieces of bounded text, one output batch for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                yield function(piece)

    return map_arrow(df, run, schema)


def filled(column: pa.Array) -> pa.Array:
    """Text with nulls as empty texts."""
    return pc.fill_null(column, "")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts."""
    binary = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    wide = np.int32 if pa.types.is_binary(binary.type) else np.int64
    offsets = np.frombuffer(binary.buffers()[1], wide)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
    buffer = binary.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_mark(text: Column) -> Column:
    """A 64-bit hash of a text, a null one as empty: with the doc_id it names a row, but for exact repeats."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """ASCII-lower-cased words between ASCII white space, and where each text's words start (and the end)."""
    return split_words(pc.ascii_lower(texts))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space as they are, and where each text's words start (and the end)."""
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    if not pc.all(real, min_count=0).as_py():
        keep = real.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, words = before[offsets], words.filter(real)
    return words, offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
