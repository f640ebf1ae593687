"""SQL generators of the random contract, for the oracle side of the registered queries."""

from __future__ import annotations

from weftline.functions.rng import MULTIPLIERS, ROUNDS, WEYL, key64
from weftline.operators.permute import permutation_key

LOW = 4294967295


def philox(source: str, counter: tuple[str, str, str, str], key: int) -> str:
    """A query with the columns of ``source`` and the four words x0..x3 of each row's counter."""
    start = ", ".join(f"({c})::UBIGINT AS x{i}" for i, c in enumerate(counter))
    sql = f"SELECT *, {start} FROM ({source})"
    k0, k1 = key & LOW, key >> 32
    m0, m1 = (f"{m}::UBIGINT" for m in MULTIPLIERS)
    for _ in range(ROUNDS):
        sql = (
            f"SELECT * EXCLUDE (x0, x1, x2, x3), xor(xor(({m1} * x2) >> 32, x1), {k0}::UBIGINT) AS x0, ({m1} * x2) & {LOW} AS x1, "
            f"xor(xor(({m0} * x0) >> 32, x3), {k1}::UBIGINT) AS x2, ({m0} * x0) & {LOW} AS x3 FROM ({sql})"
        )
        k0, k1 = (k0 + WEYL[0]) & LOW, (k1 + WEYL[1]) & LOW
    return sql


def block(source: str, coord: str, seed: int, epoch: int, draw: int = 0, stream: int = 0) -> str:
    return philox(source, (f"({coord}) & {LOW}", str(draw), str(stream), f"({coord}) >> 32"), key64(seed, epoch))


def small_permutation(n: str, seed: int, epoch: int) -> str:
    """``pos, index`` for a table size given by the scalar query ``n``."""
    words = philox(
        f"SELECT unnest(range(0, ({n}) * 2 + 64)) AS draw", ("draw", "8", "3", "0"), permutation_key(seed, epoch)
    )
    return f"""
(WITH RECURSIVE size AS (SELECT ({n})::BIGINT AS n),
words AS MATERIALIZED (SELECT list(x0::BIGINT ORDER BY draw) AS w FROM ({words})),
step(upper, draw, p) AS (
  SELECT n, 0::BIGINT, range(0, n) FROM size
  UNION ALL
  SELECT CASE WHEN ok THEN upper - 1 ELSE upper END, draw + 1,
         CASE WHEN ok THEN list_concat(list_concat(list_concat(p[1:pick], [p[upper]]), CASE WHEN pick = upper - 1 THEN [] ELSE p[pick + 2:upper - 1] END),
                                       CASE WHEN pick = upper - 1 THEN p[upper + 1:] ELSE list_concat([p[pick + 1]], p[upper + 1:]) END)
              ELSE p END
  FROM (SELECT upper, draw, p, w[draw + 1] % upper AS pick, w[draw + 1] < 4294967296 - 4294967296 % upper AS ok FROM step, words WHERE upper > 1)),
last AS (SELECT p FROM step WHERE upper <= 1 LIMIT 1)
SELECT unnest(range(0, len(p))) AS pos, unnest(p) AS index FROM last)"""


def large_permutation(n: int, seed: int, epoch: int) -> str:
    """``pos, index`` over a whole domain of at least 2**17."""
    bits, key = (n - 1).bit_length(), permutation_key(seed, epoch)
    low_bits, high_bits = bits // 2, bits - bits // 2

    def cipher(source: str) -> str:
        sql = f"SELECT pos, (v >> {low_bits})::UBIGINT AS hi, (v & {(1 << low_bits) - 1})::UBIGINT AS lo FROM ({source})"
        for r in range(8):
            mask = (1 << (high_bits, low_bits)[r % 2]) - 1
            sql = f"SELECT pos, lo AS hi, (hi + (x0 & {mask})) & {mask} AS lo FROM ({philox(sql, ('lo', str(r), '3', '0'), key)})"
        return f"SELECT pos, (hi << {low_bits}) | lo AS v FROM ({sql})"

    return f"""
(WITH RECURSIVE walk(pos, v, step) AS (
  SELECT pos, v, 1 FROM ({cipher(f'SELECT unnest(range(0, {n})) AS pos, unnest(range(0, {n}))::UBIGINT AS v')})
  UNION ALL
  SELECT pos, v, step + 1 FROM ({cipher(f'SELECT pos, v FROM walk WHERE v >= {n}').replace('SELECT pos, (hi', 'SELECT pos, (hi', 1)}), (SELECT max(step) AS step FROM walk))
SELECT pos, v::BIGINT AS index FROM walk WHERE v < {n})"""
