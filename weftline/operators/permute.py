"""Keyed permutations: exact Fisher-Yates below 2**17, a stateless Feistel network from there on.

The large regime is a pure function of the position, so shuffling n rows is a column over
``range(n)``: no sort, no exchange, and any slice of positions can be made alone. The small
regime is bounded by 131071 pairs, which the driver computes and Spark may broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.rng import PERMUTATION, PERMUTATION_ROUND, key64, philox, splitmix64

LARGE = 1 << 17


def permutation_key(seed: int, epoch: int) -> int:
    return splitmix64(key64(seed, epoch) ^ (PERMUTATION << 1 | 1))


def small_permutation(n: int, seed: int, epoch: int) -> np.ndarray:
    """Backward exchange shuffle with rejection; each rejected word uses up a draw."""
    if n >= LARGE:
        raise ValueError("a domain of this size is permuted without a table")
    key, out, draw, upper = permutation_key(seed, epoch), list(range(n)), 0, n
    pool: list[int] = []
    while upper > 1:
        if not pool:
            many = np.arange(draw, draw + max(64, upper), dtype=np.uint64)
            pool = philox((many, 8, PERMUTATION_ROUND, 0), key)[:, 0].tolist()[::-1]
        word, draw = pool.pop(), draw + 1
        if word < (1 << 32) - (1 << 32) % upper:
            pick = word % upper
            upper -= 1
            out[upper], out[pick] = out[pick], out[upper]
    return np.array(out, np.int64)


def _cipher(value: np.ndarray, bits: int, key: int) -> np.ndarray:
    """Eight rounds over a high and a low part whose widths change places each round."""
    low_bits, high_bits = bits // 2, bits - bits // 2
    widths = (high_bits, low_bits)
    high, low = value >> np.uint64(low_bits), value & np.uint64((1 << low_bits) - 1)
    for r in range(8):
        mask = np.uint64((1 << widths[r % 2]) - 1)
        high, low = low, (high + (philox((low, r, PERMUTATION_ROUND, 0), key)[..., 0] & mask)) & mask
    return (high << np.uint64(low_bits)) | low


def large_permutation(positions: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The image of each position; values that leave the domain walk on until they return."""
    if n < LARGE:
        raise ValueError("a domain of this size is permuted by a table")
    bits, key = (n - 1).bit_length(), permutation_key(seed, epoch)
    out = positions.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        out[open_] = _cipher(out[open_], bits, key)
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(position: Column, n: int, seed: int, epoch: int) -> Column:
    """Index of a position, as a column; both regimes, no join."""
    if n < LARGE:
        table = small_permutation(n, seed, epoch)  # at most one megabyte

        @F.pandas_udf("long")
        def run(at: pd.Series) -> pd.Series:
            return pd.Series(table[at.to_numpy()])
    else:

        @F.pandas_udf("long")
        def run(at: pd.Series) -> pd.Series:
            return pd.Series(large_permutation(at.to_numpy(), n, seed, epoch))

    return run(position)


def permutation(spark: SparkSession, n: int, seed: int, epoch: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """``(pos, index)`` of a slice of the permutation of ``range(n)``."""
    if n < 0 or start < 0 or (end is not None and end > n):
        raise ValueError("positions must lie in the domain")
    return spark.range(start, n if end is None else end).select(F.col("id").alias("pos"), permuted(F.col("id"), n, seed, epoch).alias("index"))
