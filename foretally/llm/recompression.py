"""A run-length grammar of a sequence by recompression, and longest common extensions on it.

Each round first replaces blocks of one repeated symbol, then pairs of a left and a right symbol, where symbols
are called left or right at random; equal stretches are replaced alike, but for a symbol at either end. A common
extension is found by climbing: at each level one step brings two places to where the next level's symbols
begin, or to a difference; from a difference the way down takes one step a level again. All queries go through the
levels together.

Names are exact: a new symbol stands for one block or pair, numbered by its own table at its level.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd

_MOST_ROUNDS = 80


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of the distinct (first, second); both are small enough for one key."""
    return pd.factorize(first << 32 | second)[0]


class _Level:
    """Symbols, and the next level's symbols as stretches of them."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        self.symbols = symbols
        self.starts = np.append(starts, len(symbols))

    @functools.cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def mirrored(self) -> _Level:
        return _Level(self.symbols[::-1], len(self.symbols) - self.starts[:0:-1])


class Grammar:
    """Levels from the sequence upwards, blocks and pairs in turn, and the symbols at the top.

    ``fences`` marks symbols that occur once; they are in no pair, so nothing is replaced across them. The sequence
    begins and ends with one.
    """

    def __init__(self, levels: list[_Level], top: np.ndarray):
        self.levels, self.top = levels, top

    @classmethod
    def of(cls, sequence: np.ndarray, fences: np.ndarray, seed: int = 3) -> Grammar:
        draw, levels, symbols = np.random.default_rng(seed), [], sequence.astype(np.int64)
        for _ in range(_MOST_ROUNDS):
            if len(symbols) <= 2 * fences.sum():
                break
            starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            levels.append(_Level(symbols, starts))
            symbols = _named(symbols[starts], np.diff(np.append(starts, len(symbols))))
            fences = fences[starts]
            right = draw.integers(0, 2, int(symbols.max()) + 1, dtype=np.int8).astype(bool)[symbols]
            second = np.zeros(len(symbols), bool)
            second[1:] = right[1:] & ~right[:-1] & ~fences[1:] & ~fences[:-1]
            starts = np.flatnonzero(~second)
            levels.append(_Level(symbols, starts))
            follower = np.append(np.where(second, symbols + 1, 0)[1:], 0)[starts]
            symbols, fences = _named(symbols[starts], follower), fences[starts]
        return cls(levels, symbols)

    def mirrored(self) -> Grammar:
        """The grammar of the reversed sequence."""
        return Grammar([level.mirrored() for level in self.levels], self.top[::-1])

    def extension(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many symbols from each place of ``left`` on equal those from the same place of ``right`` on."""
        x, y = left.astype(np.int64), right.astype(np.int64)
        stopped = np.full(len(x), len(self.levels))  # the level at which a difference was met
        climbing = np.arange(len(x))
        for height, level in enumerate(self.levels):
            at, to = x[climbing], y[climbing]
            own, other = level.owner[at], level.owner[to]
            inside = (level.starts[own] != at) | (level.starts[other] != to)
            rest, other_rest = level.starts[own + 1] - at, level.starts[other + 1] - to
            if height % 2:  # of a pair, one symbol is stepped over
                rest = other_rest = np.ones(len(at), np.int64)
            same = level.symbols[at] == level.symbols[to]
            step = np.where(inside & same, np.minimum(rest, other_rest), 0)
            at, to = at + step, to + step
            ends = inside & (~same | (rest != other_rest))
            x[climbing], y[climbing] = at, to
            stopped[climbing[ends]] = height
            climbing = climbing[~ends]
            at, to = x[climbing], y[climbing]
            x[climbing], y[climbing] = level.owner[at], level.owner[to]
        while len(climbing):
            climbing = climbing[self.top[x[climbing]] == self.top[y[climbing]]]
            x[climbing] += 1
            y[climbing] += 1
        for height in range(len(self.levels) - 1, -1, -1):
            level, down = self.levels[height], np.flatnonzero(stopped > height)
            own, other = x[down], y[down]
            at, to = level.starts[own], level.starts[other]
            same = level.symbols[at] == level.symbols[to]
            step = np.where(same, 1 if height % 2 else np.minimum(level.starts[own + 1] - at, level.starts[other + 1] - to), 0)
            x[down], y[down] = at + step, to + step
        return x - left
