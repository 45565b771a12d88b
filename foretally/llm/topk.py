"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of one dimension; every block of queries meets every block of
candidates and all their scores are taken. Each pass adds up, over all blocks, a histogram per
query of the scores inside the interval that still holds its k-th value, and keeps the one bin
that holds it; after the last pass the interval is that value itself. A last pass keeps what
lies above it, breaks ties by the smaller id and ranks at most k rows a block and query.

Query blocks are broadcast in rounds of at most ``ROUND_BYTES``, so memory is bounded at any
number of queries; the rounds change nothing in the result.

Nulls and odd input: vectors that are null or hold a null or non-finite component, and rows with
a null id, take no part. Vectors meet only vectors of their own length. Rows that repeat a
query's id aren't its candidates; of usable query rows that repeat an id, the smallest vector asks. Components saturate
at 64 bits and scores wrap around as 64-bit integers. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.common import map_arrow
from foretally.workspace import settle

SCALE = 256
K = 5
BLOCK_ROWS = 256
ROUND_BYTES = 32 << 20
BIN_BITS = 9
_EXACT = float(1 << 53)

_BLOCK = "block long, dim int, n int, peak double, ids binary, data binary"


def _usable(column: pa.Array) -> np.ndarray:
    """Rows whose list is there and holds only finite numbers."""
    good = np.asarray(column.is_valid())
    flat = column.flatten()
    bad = ~(np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)))
    if bad.any():
        lengths = np.where(good, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        good = good.copy()
        good[np.unique(np.repeat(np.arange(len(column)), lengths)[bad])] = False
    return good


def _quantise(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    return np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)


def blocks(vectors: DataFrame, id_column: str, vector_column: str, scale: int, rows: int) -> DataFrame:
    """The table's usable vectors, quantised, in blocks of at most ``rows`` of one length."""
    chosen = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.filter(pa.array(_usable(batch.column(1))))
            if not batch.num_rows:
                continue
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                same = batch.filter(pa.array(lengths == dim))
                ids = same.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = same.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                data = _quantise(flat, scale).reshape(len(ids), dim)
                for at in range(0, len(ids), rows):
                    part, own = data[at : at + rows], ids[at : at + rows]
                    peak = float(np.sqrt((part.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
                    out = [[number], [dim], [len(own)], [peak], [own.tobytes()], [part.tobytes()]]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(out, kinds)], ["block", "dim", "n", "peak", "ids", "data"]
                    )
                    number += 1

    return map_arrow(chosen.where("id is not null"), pack, _BLOCK)


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, dim)


def _scores(queries: np.ndarray, others: np.ndarray, bound: float) -> np.ndarray:
    """Inner products; by floating point where that is exact for integers of this size."""
    if bound < _EXACT:
        return (queries.astype(np.float64) @ others.astype(np.float64).T).astype(np.int64)
    return queries @ others.T


class _Pair:
    """One query block and one candidate block of a row."""

    def __init__(self, row: dict):
        self.block, n, m, dim = row["q_block"], row["q_n"], row["n"], row["dim"]
        self.q_ids, self.ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        scores = _scores(_matrix(row["q_data"], n, dim), _matrix(row["data"], m, dim), row["peak"] * row["q_peak"] * dim + 1)
        self.order = scores.view(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in the order of the signed scores
        self.other = self.q_ids[:, None] != self.ids[None, :]
        self.scores = scores
        self.prefix = np.frombuffer(row["prefix"], np.uint64)[:, None]
        self.need = np.frombuffer(row["need"], np.int64)
        self.every = np.frombuffer(row["every"], np.bool_)[:, None]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pair]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield _Pair(batch.slice(at, 1).to_pylist()[0])


def _histogram(shift: int, before: int):
    """Counts of each query's scores by ``order >> shift``, within the bin of ``order >> before``.

    Bins below a block's own need-th score can't hold the k-th one of all blocks, and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each(batches):
            inside = pair.other & ~pair.every
            if before < 64:
                inside &= (pair.order >> np.uint64(before)) == pair.prefix
            at, column = np.nonzero(inside)
            bins = pair.order[at, column] >> np.uint64(shift)
            # by query, highest bin first
            order = np.lexsort((~bins, at))
            at, bins = at[order], bins[order]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (bins[1:] != bins[:-1])])) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(at)))
            at, bins = at[first], bins[first]
            above = np.cumsum(counts) - counts
            start = np.searchsorted(at, at)
            above -= above[start] if len(at) else 0
            keep = above < pair.need[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(keep.sum(), pair.block)),
                    pa.array(at[keep].astype(np.int32)),
                    pa.array(bins[keep].view(np.int64)),
                    pa.array(counts[keep].astype(np.int64)),
                ],
                ["q_block", "pos", "bin", "count"],
            )

    return run


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above each query's k-th value, and of those equal to it the smallest ids."""
    for pair in _each(batches):
        above = pair.other & (pair.every | (pair.order > pair.prefix))
        ties = pair.other & ~pair.every & (pair.order == pair.prefix)
        at, column = np.nonzero(ties)
        order = np.lexsort((pair.ids[column], at))
        at, column = at[order], column[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < pair.need[at]
        more, where = np.nonzero(above)
        at, column = np.concatenate([more, at[keep]]), np.concatenate([where, column[keep]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair.q_ids[at]), pa.array(pair.ids[column]), pa.array(pair.scores[at, column])],
            ["query_id", "vec_id", "score"],
        )


def _packed(state: DataFrame) -> DataFrame:
    """One row a query block: its queries' states in order of their place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            sides = [[s["pos"] for s in row["states"]] for row in rows]
            order = [np.argsort(side) for side in sides]

            def column(name: str, kind) -> pa.Array:
                return pa.array([np.array([s[name] for s in row["states"]], kind)[o].tobytes() for row, o in zip(rows, order)], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column("prefix", np.int64), column("need", np.int64), column("every", np.bool_)],
                ["q_block", "prefix", "need", "every"],
            )

    gathered = state.groupBy("q_block").agg(F.collect_list(F.struct("pos", "prefix", "need", "every")).alias("states"))
    return map_arrow(gathered, pack, "q_block long, prefix binary, need binary, every binary")


def _rounds(queries: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The query blocks with a round number each, no round over ``limit`` bytes (but for a lone block)."""
    size = F.octet_length("q_data") + F.octet_length("q_ids")
    total, largest = queries.agg(F.sum(size), F.max(size)).first()
    if not total:
        return queries.withColumn("round", F.lit(0)), 0
    each = max(1, limit // largest)
    window = Window.orderBy("q_block")  # one row for each block of queries
    numbered = queries.select("q_block", F.floor((F.row_number().over(window) - 1) / each).cast("int").alias("round"))
    return queries.join(F.broadcast(numbered), "q_block"), -(-queries.count() // each)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    rows: int = BLOCK_ROWS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors for each row of ``queries``."""
    others = settle(blocks(vectors, id_column, vector_column, scale, rows), "candidates")
    finite = F.forall(vector_column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is greatest
    once = queries.where(F.col(vector_column).isNotNull() & finite).groupBy(id_column).agg(F.min(vector_column).alias(vector_column))
    asked = blocks(once, id_column, vector_column, scale, rows)
    asked = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "n", "peak", "ids", "data")])
    asked, n_rounds = _rounds(settle(asked, "queries"), round_bytes)
    peak, q_peak, dim = (
        others.agg(F.max("peak")).first()[0] or 0.0,
        asked.agg(F.max("q_peak")).first()[0] or 0.0,
        others.agg(F.max("dim")).first()[0] or 0,
    )
    bound = peak * q_peak + dim + 1  # of a score's size, by Cauchy and Schwarz
    # order = score + 2**63: the bits above the bound's only tell the sign
    bits = 64 if bound >= 2.0**61 else int(bound).bit_length() + 1
    results = []
    for number in range(n_rounds):
        own = settle(asked.where(F.col("round") == number).drop("round"), "round")
        places = own.select("q_block", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("pos"))
        state = places.select("q_block", "pos", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("every"))

        def pairs(state: DataFrame) -> DataFrame:
            ready = settle(own.join(_packed(state), "q_block"), "ready")
            return others.join(F.broadcast(ready), "dim")

        before, shift = 64, bits
        while before:
            shift = max(0, (bits if before == 64 else before) - BIN_BITS)
            counted = map_arrow(pairs(state), _histogram(shift, before), "q_block long, pos int, bin long, count long")
            bins = counted.groupBy("q_block", "pos", "bin").agg(F.sum("count").alias("count"))
            state = settle(_kth_bin(state, bins), "state")
            before = shift
        results.append(settle(map_arrow(pairs(state), _winners, "query_id long, vec_id long, score long"), "winners"))
    found = functools.reduce(DataFrame.union, results) if results else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _kth_bin(state: DataFrame, bins: DataFrame) -> DataFrame:
    """The state after a pass: the bin that holds the k-th score, and how many of it are still needed."""
    key = ["q_block", "pos"]
    down = Window.partitionBy(*key).orderBy(_unsigned(F.col("bin")).desc())
    summed = bins.withColumn("to", F.sum("count").over(down))
    joined = summed.join(state, key)
    hit = joined.where((F.col("to") >= F.col("need")) & (F.col("to") - F.col("count") < F.col("need")))
    found = hit.select(*key, F.col("bin").alias("new_prefix"), (F.col("need") - F.col("to") + F.col("count")).alias("new_need"))
    after = state.join(found, key, "left")
    every = F.col("every") | F.col("new_prefix").isNull()  # fewer candidates than k: all of them
    return after.select(*key, F.coalesce("new_prefix", "prefix").alias("prefix"), F.coalesce("new_need", "need").alias("need"), every.alias("every"))


def _unsigned(value: Column) -> Column:
    """A long whose signed order is the unsigned order of ``value``."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))
