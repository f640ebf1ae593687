"""Counter-based randomness: every draw is a pure function of (seed, epoch, coordinate, draw).

Vector code is numpy on unsigned integers, wrapped as Arrow-batched pandas UDFs; nothing here has
state, so results never depend on partitioning, retries or task order.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1

# Fixed values of the stream contract: ids of the random streams.
SAMPLE, COLLATE, PERMUTATION, PERMUTATION_ROUND = 0, 1, 2, 3
ACCESSOR_TORCH, ACCESSOR_NUMPY, ACCESSOR_RANDOM = 4, 5, 6
STATE_RANDOM, STATE_NUMPY = 7, 8

# Fixed values of Philox4x32 with ten rounds (public Random123 constants).
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
WEYL = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10


def splitmix64(value: int) -> int:
    """The SplitMix64 finaliser, without its additive step."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = ((value ^ (value >> shift)) * factor) & MASK64
    return value ^ (value >> 31)


def mixed64(value: Column, modulo: int | None = None) -> Column:
    """The SplitMix64 finaliser of a BIGINT as one, or its unsigned value modulo ``modulo``."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy().astype(np.int64).view(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
        v ^= v >> np.uint64(31)
        return pd.Series((v if modulo is None else v % np.uint64(modulo)).view(np.int64))

    return run(value)


def key64(seed: int, epoch: int) -> int:
    return splitmix64(seed & MASK64) ^ splitmix64(((epoch << 32) | 0x9E37) & MASK64)


def philox(counter: tuple, key: int) -> np.ndarray:
    """Four words for each counter: any of its parts may be an array. Rows are draws."""
    c = list(np.broadcast_arrays(*(np.asarray(x, np.uint64) for x in counter)))
    low = np.uint64(0xFFFFFFFF)
    k = [key & 0xFFFFFFFF, key >> 32]
    for _ in range(ROUNDS):
        p0, p1 = c[0] * np.uint64(MULTIPLIERS[0]), c[2] * np.uint64(MULTIPLIERS[1])
        half = np.uint64(32)
        c = [(p1 >> half) ^ c[1] ^ np.uint64(k[0]), p1 & low, (p0 >> half) ^ c[3] ^ np.uint64(k[1]), p0 & low]
        k = [(k[i] + WEYL[i]) & 0xFFFFFFFF for i in (0, 1)]
    return np.stack(c, axis=-1)


def block(seed: int, epoch: int, coord, draw=0, stream: int = SAMPLE) -> np.ndarray:
    """The four words of each coordinate's draw."""
    return keyed_block(key64(seed, epoch), coord, draw, stream)


def keyed_block(key: int, coord, draw=0, stream: int = SAMPLE) -> np.ndarray:
    at = np.asarray(coord)
    at = at.astype(np.int64).view(np.uint64) if at.dtype.kind == "i" else at.astype(np.uint64)
    return philox((at & np.uint64(0xFFFFFFFF), draw, stream, at >> np.uint64(32)), key)


def words(coord: Column, seed: int, epoch: int, draw: int = 0, stream: int = SAMPLE) -> Column:
    """The four words of a BIGINT coordinate as ``struct<w0,w1,w2,w3: bigint>``."""

    @F.pandas_udf("w0 long, w1 long, w2 long, w3 long")
    def run(at: pd.Series) -> pd.DataFrame:
        found = block(seed, epoch, at.to_numpy(), draw, stream).astype(np.int64)
        return pd.DataFrame(found, columns=["w0", "w1", "w2", "w3"])

    return run(coord)


def torch_seed(w: Column) -> Column:
    """The unsigned 64-bit seed in the first two words, as DECIMAL(20,0)."""
    return (w["w0"].cast("decimal(20,0)") + w["w1"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(20,0)")


def uniform53(w: Column, first: int = 0) -> Column:
    """A double in [0, 1) from two successive words."""
    return (F.shiftright(w[f"w{first}"], 5) * 67108864.0 + F.shiftright(w[f"w{first + 1}"], 6)) * (2.0**-53)


def randbits(w: Column, k: int) -> Column:
    """``k`` random bits, at most 32: the high bits of the first word."""
    if not 0 < k <= 32:
        raise ValueError("k must be between 1 and 32")
    return F.shiftright(w["w0"], 32 - k)


class PhiloxRandom(random.Random):
    """``random.Random`` over the words of one coordinate's stream."""

    def __new__(cls, key: int, coord: int, stream: int = STATE_RANDOM):
        return super().__new__(cls)

    def __init__(self, key: int, coord: int, stream: int = STATE_RANDOM):
        self._where, self._draw, self._words = (key, coord, stream), 0, []
        super().__init__()

    def seed(self, *args, **kwargs) -> None:
        """The stream is fixed by its coordinate; only the cached Gaussian is dropped."""
        self.gauss_next = None

    def _word(self) -> int:
        if not self._words:
            if self._draw >= 1 << 32:
                raise OverflowError("the draw counter of this stream is exhausted")
            key, coord, stream = self._where
            self._words = keyed_block(key, np.uint64(coord), self._draw, stream)[::-1].tolist()
            self._draw += 1
        return self._words.pop()

    def random(self) -> float:
        high = self._word() >> 5
        return (high * 67108864.0 + (self._word() >> 6)) * 2.0**-53

    def getrandbits(self, k: int) -> int:
        if k < 0:
            raise ValueError("number of bits must be non-negative")
        out = done = 0
        while done < k:
            width = min(32, k - done)
            out |= (self._word() >> (32 - width)) << done
            done += width
        return out


class RowRng:
    """The random surfaces of one row, for user functions; made from its coordinate alone."""

    def __init__(self, seed: int, epoch: int, coord: int):
        self.key, self.coord = key64(seed, epoch), coord

    def random(self) -> PhiloxRandom:
        return PhiloxRandom(self.key, self.coord, ACCESSOR_RANDOM)

    def state_random(self) -> PhiloxRandom:
        return PhiloxRandom(self.key, self.coord, STATE_RANDOM)

    def numpy(self, stream: int = ACCESSOR_NUMPY) -> np.random.Generator:
        key = [self.key ^ splitmix64(stream), 0]
        return np.random.Generator(np.random.Philox(counter=np.array([self.coord, 0, 0, 0], np.uint64), key=np.array(key, np.uint64)))

    def numpy_legacy(self) -> np.random.RandomState:
        """The old-style generator, whose state can be read and set; seeded by the low 32 bits of
        the key of the numpy state stream."""
        return np.random.RandomState((self.key ^ splitmix64(STATE_NUMPY)) & 0xFFFFFFFF)

    def torch_seed(self, stream: int = SAMPLE) -> int:
        w = keyed_block(self.key, np.uint64(self.coord), 0, stream)
        return int(w[0]) | (int(w[1]) << 32)
