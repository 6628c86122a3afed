"""Bloom filters of bounded size, built by aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB at most, however many names there are. A filter that is too full says yes
#: too often, which costs work in what follows and no result.
MOST_BITS = 26


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.astype(np.int64).view(np.uint64)
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


def build(names: DataFrame, n: int, column: str = "h") -> tuple[int, np.ndarray]:
    """The filter (bits as a power of two, 64-bit words) of n hashes in a long column."""
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    first, second = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(column, 64 - bits)
    at = names.select(F.explode(F.array(first, second)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toPandas()  # at most 2^(bits - 6) rows
    table[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return bits, table


def has(h: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    p, q = positions(h, bits)
    return ((table[p >> 6] >> (p & 63)) & (table[q >> 6] >> (q & 63)) & 1).astype(bool)
