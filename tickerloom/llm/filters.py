"""Filters of bounded size that tasks hold, so that rows without a partner need no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: sixteen for each digest within these bounds, so at most 8 MB. A filter that is too full lets more rows through, no fewer.
FILTER_BITS = (1 << 16, 1 << 26)


def filter_bits(digests: int) -> int:
    return min(max(1 << (16 * digests).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def held_digests(windows: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits with two of them for each digest, put together from at most bits / 64 aggregated words."""
    low = F.explode(F.array("digest", F.shiftrightunsigned("digest", 32))).alias("x")
    words = windows.select(low).select(F.col("x").bitwiseAND(F.lit(bits - 1)).alias("x")).groupBy(F.shiftright("x", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))).alias("held"))
    held = np.zeros(bits // 64, np.int64)
    found = words.toArrow()  # compact, unlike rows
    held[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return held.view(np.uint8)


def may_hold(held: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) digests the filter may hold; true for all that it was made from."""
    mask = np.uint64(len(held) * 8 - 1)
    one, two = (held[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1 for x in (digests & mask, (digests >> np.uint64(32)) & mask))
    return (one & two).astype(np.bool_)
