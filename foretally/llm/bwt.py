"""Burrows-Wheeler transforms of small sets of byte strings, and their merge by interleave refinement.

A shard's transform lists, for its suffixes in order, the symbols that stand before each. Shards are
merged without comparing suffixes: the interleave says which shard the next suffix in the common order
comes from. If it is right for the first d symbols of all suffixes, reading the transforms along it and
sorting by the symbols read (stably) gives the interleave that is right for ``STRIDE`` symbols more, or twice as many where their grams are numbered.
Blocks of suffixes that agree so far are refined along with it, so after d symbols the blocks are the
intervals of suffixes with a common prefix of d or more.

A string's end sorts below every symbol. Equal suffixes keep the order of shards, then of strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 5
_PACKED = 7
_LOW = np.uint64((1 << 32) - 1)


def _left(offsets: np.ndarray) -> np.ndarray:
    """For each symbol, how many there are from it to its string's end."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])


def _grams(symbols: np.ndarray, left: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The next ``length`` symbols at each place as one number; beyond a string's end they are zero."""
    padded = np.append(symbols.astype(np.int64), np.zeros(length, np.int64))
    keys = np.zeros(len(symbols), np.int64)
    for k in range(length):
        keys <<= bits
        keys |= np.where(left > k, padded[k : k + len(symbols)], 0)
    return keys


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks from 1 of keys of that many bits, and their stable order; with its place in one number, a key is sorted fastest."""
    n = len(keys)
    width = max(1, (n - 1).bit_length())
    ranks = np.empty(n, np.uint64)
    if bits + width <= 64:
        keyed = np.sort(keys.astype(np.uint64) << np.uint64(width) | np.arange(n, dtype=np.uint64))
        order, ordered = (keyed & np.uint64((1 << width) - 1)).astype(np.int64), keyed >> np.uint64(width)
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    ranks[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ranks, order


def _doubled(ranks: np.ndarray, left: np.ndarray, covered: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and order by twice the ``covered`` symbols of the given ranks."""
    width = int(ranks.max()).bit_length()
    following = np.zeros(len(ranks), np.uint64)
    inside = np.flatnonzero(left[: len(ranks) - covered] > covered)
    following[inside] = ranks[inside + covered]
    return _ranks(ranks << np.uint64(width) | following, 2 * width)


def numbered(shards: list[tuple[np.ndarray, np.ndarray]], bits: int) -> list[np.ndarray]:
    """For each shard the numbers of the grams of 2 * ``STRIDE`` symbols at its places, in order from 1, the same for all shards."""
    symbols, sizes = np.concatenate([symbols for symbols, _ in shards]), np.cumsum([len(symbols) for symbols, _ in shards])
    left = np.concatenate([_left(offsets) for _, offsets in shards])
    if not len(symbols):
        return [np.zeros(0, np.uint32) for _ in shards]
    ranks, _ = _ranks(_grams(symbols, left, STRIDE, bits), STRIDE * bits)
    return np.split(_doubled(ranks, left, STRIDE)[0].astype(np.uint32), sizes[:-1])


def suffix_order(symbols: np.ndarray, offsets: np.ndarray, bits: int, numbers: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """The places of all suffixes of a shard's strings in order (of their first ``depth`` symbols), by doubling what the ranks cover."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    left = _left(offsets)
    if numbers is None:
        covered = _PACKED if (_PACKED * bits + (n + 1).bit_length() <= 64) else 4
        ranks, order = _ranks(_grams(symbols, left, covered, bits), covered * bits)
    else:
        covered, ranks, order = 2 * STRIDE, numbers.astype(np.uint64), None
    longest = min(int(left.max()), depth or n)
    while covered < longest and (order is None or ranks.max() < n):
        (ranks, order), covered = _doubled(ranks, left, covered), 2 * covered
    return order if order is not None else np.argsort(numbers, kind="stable")


@dataclass
class Transform:
    """A shard's suffixes in order, and the grams of ``stride`` symbols that the merge reads.

    ``before`` has the gram that stands before each suffix, -1 where fewer symbols do. ``short`` has the
    grams of the suffixes that are no longer than a gram, in order: nothing precedes them.
    """

    order: np.ndarray
    before: np.ndarray
    short: np.ndarray
    stride: int = STRIDE


def transform(symbols: np.ndarray, offsets: np.ndarray, bits: int, numbers: np.ndarray | None = None, depth: int | None = None) -> Transform:
    """Of strings of symbols from 1 to below 2 ** ``bits``, which has nine bits at most.

    With its grams' ``numbers`` (see ``numbered``) the merge reads 2 * ``STRIDE`` symbols a step. Suffixes that a merge to
    ``depth`` symbols is for need no order beyond.
    """
    order, left = suffix_order(symbols, offsets, bits, numbers, depth), _left(offsets)
    stride = STRIDE if numbers is None else 2 * STRIDE
    grams = _grams(symbols, left, STRIDE, bits) if numbers is None else numbers.astype(np.int64)
    start = np.repeat(offsets[:-1], np.diff(offsets))[order]
    before = np.where(order - stride >= start, grams[np.maximum(order - stride, 0)], -1)
    return Transform(order, before, grams[order[left[order] <= stride]], stride)


def merged_blocks(shards: list[Transform], depth: int, bits: int) -> np.ndarray:
    """For each suffix (shard by shard, in the shard's order) its block among all with the same first ``depth`` symbols.

    Blocks are numbered from 0 in the merged order. ``depth`` is a multiple of the shards' stride.
    """
    stride = shards[0].stride
    if depth % stride:
        raise ValueError(f"the depth must be a multiple of {stride}")
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    if len(shards) > 1 << 16:
        raise ValueError("too many shards for one merge")
    grams = np.concatenate([part for shard in shards for part in (shard.before, shard.short)])
    if not len(grams):
        return np.zeros(0, np.int64)
    coded = np.where(grams < 0, np.uint64(0), _ranks(grams + 1, STRIDE * bits + 1)[0] if stride == STRIDE else grams.astype(np.uint64))
    cut = np.cumsum([0] + [len(part) for shard in shards for part in (shard.before, shard.short)])
    named = [coded[a:b] for a, b in zip(cut, cut[1:])]
    before, short = np.concatenate(named[0::2]), np.concatenate(named[1::2])
    del grams, coded, named
    sources = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards]).astype(kind)
    short_sources = np.repeat(np.arange(len(shards)), [len(s.short) for s in shards]).astype(kind)
    number = np.arange(len(sources), dtype=np.uint64)
    # a place in the interleave: the block it is in so far, and below it the shard
    state, ends = np.int64(1) << 16 | sources.astype(np.int64), np.int64(1) << 16 | short_sources.astype(np.int64)
    for _ in range(depth // stride):
        read = np.empty(len(sources), np.uint64)
        read[np.argsort((state & 0xFFFF).astype(kind), kind="stable")] = before
        reading = np.flatnonzero(read)
        keyed = np.sort(np.concatenate([short, read[reading]]) << np.uint64(32) | number)
        state = np.concatenate([ends, state[reading]])[(keyed & _LOW).astype(np.int64)]
        gram, following = keyed >> np.uint64(32), state >> 16
        block = np.cumsum(np.concatenate([[1], (gram[1:] != gram[:-1]) | (following[1:] != following[:-1])]))
        state = block << 16 | state & 0xFFFF
        ends = ends & 0xFFFF  # a suffix that ends with its gram is followed by nothing, which is in a block of its own from now on
    return (state >> 16)[np.argsort((state & 0xFFFF).astype(kind), kind="stable")] - 1
