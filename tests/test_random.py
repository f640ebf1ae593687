import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import rng
from weftline.operators import permute


def scalar_philox(counter, key):
    """An independent scalar model of the public generator."""
    c, k = list(counter), [key & 0xFFFFFFFF, key >> 32]
    for r in range(10):
        if r:
            k = [(k[0] + 0x9E3779B9) % 2**32, (k[1] + 0xBB67AE85) % 2**32]
        a, b = 0xD2511F53 * c[0], 0xCD9E8D57 * c[2]
        c = [(b >> 32) ^ c[1] ^ k[0], b % 2**32, (a >> 32) ^ c[3] ^ k[1], a % 2**32]
    return c


def test_zero_vector():
    assert rng.philox((0, 0, 0, 0), 0).tolist() == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]


def test_vector_code_equals_scalar_model():
    pick = random.Random(4)
    for _ in range(200):
        counter, key = tuple(pick.getrandbits(32) for _ in range(4)), pick.getrandbits(64)
        assert rng.philox(counter, key).tolist() == scalar_philox(counter, key)


def test_known_keys_and_blocks():
    assert rng.key64(11, 3) == 0x1AF63FA47EC0F63E
    assert permute.permutation_key(11, 3) == 3473315987 | 1394983725 << 32
    assert rng.block(11, 3, 29).tolist() == [1917943625, 104451856, 3195208028, 2838705496]


def test_coordinates_beyond_63_bits_keep_their_high_word():
    high = np.array([1 << 63], np.uint64)
    assert rng.block(1, 0, high)[0].tolist() == scalar_philox((0, 0, 0, 1 << 31), rng.key64(1, 0))


def test_row_random_is_pure_and_uses_high_bits():
    a, b = rng.RowRng(5, 2, 77).random(), rng.RowRng(5, 2, 77).random()
    assert [a.random() for _ in range(9)] == [b.random() for _ in range(9)]
    words = rng.block(5, 2, 77, 0, rng.ACCESSOR_RANDOM).tolist()
    assert rng.RowRng(5, 2, 77).random().getrandbits(40) == words[0] | (words[1] >> 24) << 32
    assert rng.RowRng(5, 2, 77).random().random() == ((words[0] >> 5) * 67108864 + (words[1] >> 6)) / 2**53
    assert rng.RowRng(5, 2, 77).numpy().normal() == rng.RowRng(5, 2, 77).numpy().normal()


@pytest.mark.parametrize(
    "args, values",
    [((10, 1701, 0), [8, 5, 4, 0, 9, 2, 1, 7, 3, 6]), ((10, 1701, 1), [3, 1, 8, 0, 9, 5, 2, 6, 4, 7]),
     ((25, 42, 0), [18, 20, 8, 19, 2, 13, 15, 7, 21, 24, 4, 12, 11, 6, 22, 23, 16, 9, 3, 17, 0, 5, 10, 1, 14])],
)
def test_small_permutation(args, values):
    assert permute.small_permutation(*args).tolist() == values


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, permute.LARGE - 1])
def test_small_permutation_is_a_bijection(n):
    assert sorted(permute.small_permutation(n, 3, 1)) == list(range(n))


@pytest.mark.parametrize("n", [permute.LARGE, permute.LARGE + 1, 300_000])
def test_large_permutation_is_a_bijection(n):
    assert len(np.unique(permute.large_permutation(np.arange(n), n, 17, 4))) == n


def test_large_permutation_known_values():
    assert permute.large_permutation(np.arange(5), 131072, 17, 4).tolist() == [105101, 85695, 2499, 112787, 35136]
    assert permute.large_permutation(np.arange(5), 600000, 42, 0).tolist() == [279370, 202220, 182038, 257648, 32731]


def test_permutation_does_not_depend_on_partitioning(spark):
    rows = permute.permutation(spark, 140_000, 7, 1)
    other = spark.range(140_000).repartition(13).select(F.col("id").alias("pos"), permute.permuted(F.col("id"), 140_000, 7, 1).alias("index"))
    assert rows.exceptAll(other).count() == 0


def test_permutation_needs_no_exchange(spark):
    plan = permute.permutation(spark, 1 << 18, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_legacy_numpy_surface():
    row = rng.RowRng(9, 1, 5)
    a, b = row.numpy_legacy(), row.numpy_legacy()
    state = a.get_state()
    first = a.rand(3).tolist()
    assert first == b.rand(3).tolist()
    a.set_state(state)
    assert a.rand(3).tolist() == first
    expected = np.random.RandomState((rng.key64(9, 1) ^ rng.splitmix64(8)) % 2**32).rand(3).tolist()
    assert first == expected
