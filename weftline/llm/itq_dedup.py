"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Fit (driver, numpy): centre, PCA and the ITQ rotation over ``fit_rows`` unit vectors, the
   first by a hash of their id. This bound is the only one; every vector is encoded and indexed.
2. Encode: one Arrow pass; equal vectors of one label are a single row with a multiplicity.
3. Retrieve: the code is cut into parts, one Hamming table for each. A code posts each part once
   and probes it with up to a few bits flipped; a pair counts in the first table only. With more
   codes of a label, ``LAYOUTS`` takes fewer and wider parts and flips more bits, so candidates
   don't grow with the square of the rows: 4 parts and 1 flip (every pair of codes within 7 bits
   meets, and most beyond), then 3 and 2 (within 8), then 2 and 3 (within 7).
4. Rerank: the vectors behind each pair of codes are compared by cosine in double precision.
   Cells of more than ``block_rows`` vectors are dealt in blocks, so a task holds two blocks at
   most; each block pair returns sums and a spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, link with nothing. Vectors of different length never link. Copies count
as links of each other. A repeated vec_id is one row for each occurrence; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, materialise

LAYOUTS = ((4, 1), (3, 2), (2, 3))  # parts of a code, bits flipped in each
OWN = 2  # the side of a block that meets itself


def fit_itq(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are balanced binary codes of unit vectors."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    reduced = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        signs = np.where(reduced @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ reduced)
        rotation = (left @ right).T
    return mean, axes @ rotation


def encode(units: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as signed 64-bit integers, bit 0 lowest."""
    bits = np.zeros((len(units), 64), np.uint8)
    bits[:, : projection.shape[1]] = (units - mean) @ projection > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, zero-padded to ``dim``."""
    out = np.zeros((len(column), dim))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.repeat(np.arange(len(column)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at, np.arange(len(flat)) - start] = flat
    return out


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors; scaled by powers of two first, so that neither tiny
    nor huge components are lost in their squares."""
    x = matrix(column, dim)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def flip_masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in held) for n in range(flips + 1) for held in combinations(range(width), n)]


def layout(codes: int, bits: int) -> tuple[int, int]:
    """The layout with the fewest probes and candidates for so many codes of one label."""

    def rows(parts: int, flips: int) -> float:
        width = -(-bits // parts)
        probes = sum(math.comb(width, n) for n in range(flips + 1))
        return parts * probes * codes * (1 + codes / 2**width)

    return min(LAYOUTS, key=lambda x: rows(*x))


def is_valid() -> Column:
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull()
    return F.coalesce(known & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def block_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which rows of ``x`` link with which of ``y`` (of ``x`` itself, without the diagonal)."""
    near = x @ (x if y is None else y).T >= threshold
    if y is None:
        np.fill_diagonal(near, False)
    return near


def forest(ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each row within a symmetric link matrix."""
    low = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(near, low[None, :], top).min(1, initial=top))
        if (new == low).all():
            return low
        low = new


def rerank(cells: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``(head, linked, root)`` sums from rows sorted by ``pair`` and ``pair2``; side 0 meets side 1, and a
    block of side OWN meets itself."""

    def one(side: np.ndarray, heads: np.ndarray, copies: np.ndarray, x: np.ndarray):
        a, b = side == 0, side == 1
        if side[0] == OWN:
            near = block_links(x, None, threshold)
        else:
            near = np.zeros((len(x), len(x)), bool)
            near[np.ix_(a, b)] = block_links(x[a], x[b], threshold)
            near |= near.T
        hit = near.any(1)
        if hit.any():
            near = near[np.ix_(hit, hit)]
            yield heads[hit], near @ copies[hit], forest(heads[hit], near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool):
            pair, twin = t["pair"].to_numpy(), t["pair2"].to_numpy()
            edge = np.flatnonzero((pair[1:] != pair[:-1]) | (twin[1:] != twin[:-1])) + 1
            starts = np.concatenate([[0], edge]) if len(pair) else np.zeros(0, int)
            ends = np.concatenate([edge, [len(pair)]]) if len(pair) else np.zeros(0, int)
            if not last and len(starts):
                starts, ends = starts[:-1], ends[:-1]
            upto = int(ends[-1]) if len(ends) else 0
            if upto:
                part = t.slice(0, upto).combine_chunks()
                x = unit_rows(part["embedding"].chunk(0), dim)
                side, heads, copies = (part[c].to_numpy() for c in ("side", "head", "copies"))
                found = [r for s, e in zip(starts, ends, strict=True) for r in one(side[s:e], heads[s:e], copies[s:e], x[s:e])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["head", "linked", "root"])
            return t.slice(upto)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None or not rest.num_rows else pa.concat_tables([rest, t])
            rest = yield from groups(t, False)
        if rest is not None and rest.num_rows:
            yield from groups(rest, True)

    return cells.mapInArrow(run, "head long, linked long, root long")


def code_pairs(codes: DataFrame, bits: int, radius: int, tables: int, most_flips: int) -> DataFrame:
    """``(label, dim, a, b)`` of different codes that meet in a Hamming table, each pair once."""
    width = -(-bits // tables)
    parts = [(lo, min(lo + width, bits)) for lo in range(0, bits, width)]

    def part(c, lo: int, hi: int):
        return F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))

    posts = codes.select(
        "label", "dim", F.col("code").alias("b"),
        F.posexplode(F.array(*(part(F.col("code"), lo, hi) for lo, hi in parts))).alias("t", "k"),
    )
    # Constant arrays, folded to literals once.
    flips = F.array(*(F.split(F.lit(",".join(map(str, flip_masks(hi - lo, most_flips)))), ",").cast("array<bigint>") for lo, hi in parts))
    probes = codes.select(
        "label", "dim", F.col("code").alias("a"),
        F.posexplode(F.array(*(part(F.col("code"), lo, hi) for lo, hi in parts))).alias("t", "own"),
    )
    probes = probes.select("label", "dim", "a", "t", "own", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    probes = probes.select("label", "dim", "a", "t", F.col("own").bitwiseXOR(F.col("flip")).alias("k"))
    # Spark's size estimate takes an exploded table for as small as its source and would broadcast
    # all probes through the driver; a sort-merge join keeps them on the executors at any size.
    met = probes.join(posts.hint("merge"), ["label", "dim", "t", "k"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, (lo, hi) in enumerate(parts[:-1]):
        earlier = earlier | ((F.col("t") > i) & (F.bit_count(part(differ, lo, hi)) <= most_flips))
    return met.where(~earlier).where(F.bit_count(differ) <= radius).select("label", "dim", "a", "b")


def itq_near_dedup(
    vectors: DataFrame, threshold: float = 0.98, fit_rows: int = 20_000, radius: int = 16, block_rows: int = 256
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    spark = vectors.sparkSession
    number = "double" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    good = rows.where(is_valid())
    # One row for all copies of a vector; partial aggregation, so a hot copy stays cheap.
    heads = materialise(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")), "itq-heads",
    )
    dim = heads.agg(F.max("dim")).first()[0]
    alone = rows.where(~is_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if dim is None:
        return alone
    sample = heads.select("embedding").orderBy(F.xxhash64("head"), "head").limit(fit_rows).toArrow()
    units = unit_rows(sample["embedding"].combine_chunks(), dim)
    bits = min(64, dim)
    mean, projection = fit_itq(units, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(batch.column("embedding"), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encode(x, mean, projection))], [*batch.schema.names, "code"])

    indexed = materialise(
        heads.mapInArrow(run, f"label {dict(heads.dtypes)['label']}, embedding array<{number}>, head long, copies long, dim int, code long"),
        "itq-codes",
    )
    cells = indexed.groupBy("label", "dim", "code").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cells = materialise(cells, "itq-cells")
    most = cells.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    met = code_pairs(cells.select("label", "dim", "code"), bits, radius, *layout(most, bits))
    own = cells.select("label", "dim", F.col("code").alias("a"), F.col("code").alias("b"))
    sized = (
        met.unionByName(own)
        .join(cells.select("label", "dim", F.col("code").alias("a"), F.col("blocks").alias("na")), ["label", "dim", "a"])
        .join(cells.select("label", "dim", F.col("code").alias("b"), F.col("blocks").alias("nb")), ["label", "dim", "b"])
    )
    dealt = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"))
    dealt = dealt.select("*", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("nb") - 1)).alias("j"))
    # Two hashes of 64 bits name a pair of blocks: one could be shared by pairs of other labels.
    names = ("label", "dim", "a", "b", "i", "j")
    dealt = dealt.withColumn("pair", F.xxhash64(*names)).withColumn("pair2", F.xxhash64(F.lit("second"), *names))
    twin = F.col("a").eqNullSafe(F.col("b")) & (F.col("i") == F.col("j"))
    posted = dealt.select(
        "label", "dim", "pair", "pair2", F.explode(
            F.when(twin, F.array(F.struct(F.lit(OWN).alias("side"), F.col("a").alias("code"), F.col("i").alias("block"))))
            .otherwise(F.array(
                F.struct(F.lit(0).alias("side"), F.col("a").alias("code"), F.col("i").alias("block")),
                F.struct(F.lit(1).alias("side"), F.col("b").alias("code"), F.col("j").alias("block")),
            ))
        ).alias("p"),
    ).select("label", "dim", "pair", "pair2", "p.side", "p.code", "p.block")
    members = indexed.join(cells, ["label", "dim", "code"]).withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    meeting = posted.join(members, ["label", "dim", "code", "block"]).select("pair", "pair2", "side", "head", "copies", "embedding")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meeting = meeting.repartition(n, "pair").sortWithinPartitions("pair", "pair2", "side")
    found = materialise(rerank(meeting, dim, threshold), "itq-links")
    sums = found.groupBy("head").agg(F.sum("linked").alias("linked"))
    member = components(found.select(F.col("head").alias("u"), F.col("root").alias("v")), "itq-components")
    labelled = (
        heads.join(sums, "head", "left").join(member, heads["head"] == member["id"], "left")
        .select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "head").alias("c"))
    )
    linked = good.join(labelled, ["label", "embedding"]).select(
        "vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept")
    )
    return linked.unionByName(alone)
