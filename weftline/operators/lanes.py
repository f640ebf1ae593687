"""Iterable lanes: stride shards, whole-batch round robin, coordinates and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.readers import dense_index

RANK_LIMIT, LANE_LIMIT, ARRIVAL_LIMIT = 1 << 12, 1 << 12, 1 << 40


def stride_lane(position: Column, rank: int, world_size: int, lanes: int) -> Column:
    """The lane of this rank that a source position belongs to; null for other ranks."""
    slot = F.pmod(position, F.lit(world_size * lanes)) - rank * lanes
    return F.when((slot >= 0) & (slot < lanes), slot)


def coordinate(rank: Column, lane: Column, arrival: Column) -> Column:
    """rank, lane and arrival in 12, 12 and 40 bits."""

    def bounded(name: str, c: Column, limit: int) -> Column:
        message = F.concat(F.lit(f"iterable {name} must be in [0, {limit}): "), c.cast("string"))
        return F.when((c >= 0) & (c < limit), c.cast("long")).otherwise(F.raise_error(message).cast("long"))

    r, ln, a = bounded("rank", rank, RANK_LIMIT), bounded("lane", lane, LANE_LIMIT), bounded("arrival", arrival, ARRIVAL_LIMIT)
    return F.shiftleft(r, 52).bitwiseOR(F.shiftleft(ln, 40)).bitwiseOR(a)


def round_robin(rows: DataFrame, batch_size: int, drop_last: bool = False, cursors: dict[int, int] | None = None, lane_order: list[int] | None = None) -> DataFrame:
    """Adds ``lane_batch``, ``offset`` and the batch's ``delivery`` ordinal to (lane, arrival) rows.

    Whole batches are taken from the lanes in turn until each is exhausted, which is the order
    (lane_batch, lane). After a restore, ``cursors`` are the batches already delivered of each
    lane and ``lane_order`` the rotation. The ordinal is a dense index over one row for each batch."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    out = rows.withColumn("lane_batch", F.floor(F.col("arrival") / batch_size).cast("long")).withColumn("offset", F.pmod(F.col("arrival"), F.lit(batch_size)))
    batches = out.groupBy("lane", "lane_batch").agg(F.count("*").alias("_n"))
    if drop_last:
        batches = batches.where(F.col("_n") == batch_size)
    done, place = F.lit(0), F.col("lane")
    for lane, n in (cursors or {}).items():
        done = F.when(F.col("lane") == lane, n).otherwise(done)
    for i, lane in enumerate(lane_order or []):
        place = F.when(F.col("lane") == lane, i).otherwise(place)
    batches = batches.withColumn("_round", F.col("lane_batch") - done).where("_round >= 0").withColumn("_place", place)
    ranked = dense_index(batches.select("lane", "lane_batch", "_round", "_place"), ["_round", "_place"], "delivery")
    return out.join(ranked.select("lane", "lane_batch", "delivery"), ["lane", "lane_batch"])


def select_snapshot(snapshots: DataFrame, delivered: DataFrame) -> DataFrame:
    """The newest snapshot of each lane at or before its delivered arrival."""
    joined = snapshots.join(delivered, "lane").where(F.col("arrival") <= F.col("delivered_arrival"))
    return joined.groupBy("lane").agg(F.max("arrival").alias("arrival"), F.max_by("payload", "arrival").alias("payload"))
