"""Membership filters of 64-bit hashes whose size follows the measured number of hashes, up to a limit.

A filter only spares work: what it lets through by mistake meets an exact step later. Above the limit it gets
fuller and lets more through; no result changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_EACH = 16
MOST_BITS = 1 << 28
_LEAST_BITS = 1 << 12
_PROBES = 2


def bits_for(count: int, most: int = MOST_BITS) -> int:
    """A power of two: ``BITS_EACH`` bits or more for each of ``count`` hashes, ``most`` at most."""
    return min(most, max(_LEAST_BITS, 1 << (BITS_EACH * count - 1).bit_length()))


def gathered(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter's words; what reaches the driver is at most one row for each 64 of its bits."""
    probes = [F.shiftrightunsigned(column, 31 * i).bitwiseAND(F.lit(bits - 1)) for i in range(_PROBES)]
    single = hashes.select(F.explode(F.array(*probes)).alias("bit"))
    cells = single.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    table = cells.toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[table.column("cell").to_numpy()] = table.column("mask").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each unsigned hash, whether the filter may hold it."""
    last = np.uint64(len(words) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for i in range(_PROBES):
        bit = (hashes >> np.uint64(31 * i)) & last
        found &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found
