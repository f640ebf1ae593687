"""Placement of stream positions on ranks, batches and offsets, as columns over a range.

Nothing is shuffled: a plan is ``range`` and integer arithmetic, so resuming starts the range at
the first open batch instead of filtering what came before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.permute import permuted


@dataclass(frozen=True)
class Geometry:
    """Batch geometry of one epoch. ``distributed=False`` never pads."""

    length: int
    batch_size: int = 1
    world_size: int = 1
    drop_last: bool = False
    exact_count: bool = False
    distributed: bool = True

    def __post_init__(self) -> None:
        if self.length < 0:
            raise ValueError("length must be nonnegative")
        if self.batch_size <= 0:
            raise ValueError("batch_size must be positive")
        if self.world_size <= 0:
            raise ValueError("world_size must be positive")
        if not self.distributed and self.world_size != 1:
            raise ValueError("a single process has world_size 1")
        if self.batch_size * self.world_size >= 1 << 63 or self.padded >= 1 << 63:
            raise ValueError("stream positions exceed 63 bits")

    @property
    def global_batch(self) -> int:
        return self.batch_size * self.world_size

    @property
    def full(self) -> int:
        return self.length // self.global_batch * self.global_batch

    @property
    def padded(self) -> int:
        return -(-self.length // self.global_batch) * self.global_batch

    @property
    def regular_end(self) -> int:
        """Positions that lie in whole global batches, padding included."""
        if not self.distributed:
            return self.full if self.drop_last else self.length
        return self.full if self.drop_last or self.exact_count else self.padded

    @property
    def end(self) -> int:
        """All positions of the epoch."""
        tail = self.distributed and self.exact_count and not self.drop_last
        return self.length if tail else self.regular_end

    @property
    def num_batches(self) -> int:
        return -(-self.end // self.global_batch)

    def elastic(self, world_size: int) -> Geometry:
        """The same global batches over another number of ranks."""
        if world_size <= 0 or self.global_batch % world_size:
            raise ValueError(f"a global batch of {self.global_batch} does not divide over {world_size} ranks")
        return Geometry(self.length, self.global_batch // world_size, world_size, self.drop_last, self.exact_count, self.distributed)


def plan(spark: SparkSession, g: Geometry, seed: int = 0, epoch: int = 0, shuffle: bool = False, cursor: int = 0, rank: int | None = None) -> DataFrame:
    """``pos, coord, rank, batch_id, offset, index`` from batch ``cursor`` on.

    A padded position repeats an index but keeps its own coordinate, and so its own randomness.
    An exact tail is dealt in contiguous, unequal parts.
    """
    if cursor < 0 or cursor > g.num_batches:
        raise ValueError("loader state cursor exceeds the delivery batch count")
    if rank is not None and not 0 <= rank < g.world_size:
        raise ValueError("rank must lie in [0, world_size)")
    start = min(cursor * g.global_batch, g.end)
    pos, n = F.col("id"), F.lit(g.length)
    regular = pos < F.lit(g.regular_end)
    tail = max(g.end - g.regular_end, 1)
    tail_rank = F.floor(((pos - g.regular_end + 1) * g.world_size - 1) / tail).cast("long")
    if g.end == g.regular_end:
        rank_of, offset = F.floor(F.pmod(pos, F.lit(g.global_batch)) / g.batch_size).cast("long"), F.pmod(pos, F.lit(g.batch_size))
    else:
        own = F.floor(F.pmod(pos, F.lit(g.global_batch)) / g.batch_size).cast("long")
        rank_of = F.when(regular, own).otherwise(tail_rank)
        begin = F.lit(g.regular_end) + F.floor(tail_rank * tail / g.world_size).cast("long")
        offset = F.when(regular, F.pmod(pos, F.lit(g.batch_size))).otherwise(pos - begin)
    rows = spark.range(start, g.end).select(
        pos.alias("pos"), pos.alias("coord"), rank_of.alias("rank"),
        F.floor(pos / g.global_batch).cast("long").alias("batch_id"), offset.cast("long").alias("offset"),
        (F.when(pos < n, pos).otherwise(F.pmod(pos - n, n)) if g.length else pos).alias("src"),
    )
    if rank is not None:
        rows = rows.where(F.col("rank") == rank)
    index = permuted(F.col("src"), g.length, seed, epoch) if shuffle and g.length else F.col("src")
    return rows.withColumn("index", index).drop("src")


def with_batch_sampler(batches: DataFrame) -> DataFrame:
    """``(batch_id, offset, index)`` of user batches of any size, with running coordinates.

    A coordinate is a row's dense place in the order of batch and offset, found by ranges."""
    from weftline.sources.readers import dense_index

    rows = batches.select("batch_id", "offset", "index")
    return dense_index(rows, ["batch_id", "offset"], "coord").select("batch_id", "offset", "index", "coord")


def gather(plan_rows: DataFrame, source: DataFrame, index: str = "index") -> DataFrame:
    """The source row of each planned position; Catalyst picks the join by size."""
    columns = [c for c in source.columns if c != index]
    clash = set(columns) & set(plan_rows.columns)
    if clash:
        raise ValueError(f"source columns clash with plan columns: {sorted(clash)}")
    return plan_rows.join(source, index)
