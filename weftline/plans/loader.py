"""The public facade: a deterministic, resumable stream of batches as lazy DataFrames."""

from __future__ import annotations

import copy
import dataclasses
import secrets
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline import CONTRACT_VERSION
from weftline.functions import stats
from weftline.operators import batch, placement
from weftline.plans import fingerprint as fp
from weftline.plans import state as st


@dataclass(frozen=True)
class Options:
    """Choices that can change results; all else is Spark's configuration."""

    batch_size: int | None = 1
    shuffle: bool = False
    drop_last: bool = False
    exact_count: bool = False
    rank: int | None = None
    world_size: int | None = None
    delivery: str = "in-order"
    collate: str = "row"


class BatchStream:
    """Batches of a source ``(index, columns...)`` whose index is dense from 0.

    ``sampler`` is a DataFrame ``(pos, index)``, ``batch_sampler`` one of ``(batch_id, offset,
    index)``. Iteration collects one batch at a time; ``plan()``, ``rows()`` and ``batches()``
    are DataFrames for distributed use."""

    def __init__(
        self, source: DataFrame, batch_size: int | None = 1, shuffle: bool = False, sampler: DataFrame | None = None,
        batch_sampler: DataFrame | None = None, drop_last: bool = False, exact_count: bool = False, rank: int | None = None,
        world_size: int | None = None, seed: int | None = None, delivery: str = "in-order", collate: str = "row",
        collate_fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, collate_schema: str | None = None,
    ) -> None:
        if (rank is None) != (world_size is None):
            raise TypeError("rank and world_size go together: give both or neither")
        own_batches = batch_sampler is not None
        for wrong, why in (
            (sampler is not None and shuffle, "a sampler gives the order, so shuffle can't"),
            (own_batches and (batch_size != 1 or drop_last), "a batch_sampler makes the batches, so batch_size and drop_last can't"),
            (own_batches and (shuffle or sampler is not None), "a batch_sampler gives the order, so neither shuffle nor a sampler can"),
            (batch_size is None and drop_last, "without batches (batch_size=None) there is no last one to drop"),
            (batch_size is not None and (type(batch_size) is not int or batch_size < 1), f"batch_size is a whole number from 1 on, not {batch_size!r}"),
            (delivery not in ("in-order", "on-completion"), f"delivery is in-order or on-completion, not {delivery!r}"),
            (collate not in ("row", "column"), f"collate is row or column, not {collate!r}"),
            ((collate_fn is None) != (collate_schema is None), "collate_fn and collate_schema go together"),
            (seed is not None and not 0 <= seed < 1 << 64, f"seed has 64 bits at most, {seed!r} doesn't fit"),
        ):
            if wrong:
                raise ValueError(why)
        self.source, self.sampler, self.batch_sampler = source, sampler, batch_sampler
        self.options = Options(batch_size, shuffle, drop_last, exact_count, rank, world_size, delivery, collate)
        self.collate_fn, self.collate_schema = collate_fn, collate_schema
        self.seed = secrets.randbits(64) if seed is None else seed
        self.epochs, self.cursor, self.ahead = st.EpochClock(), 0, set()
        self._topology = (rank, world_size)
        self._seen = stats.Ledger()
        self._length: int | None = None
        self._delivered: st.Delivered | None = None

    @property
    def spark(self):
        return self.source.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self.source.columns if c != "index"]

    @property
    def length(self) -> int:
        if self._length is None:
            self._length = (self.sampler or self.source).count()
        return self._length

    @property
    def geometry(self) -> placement.Geometry:
        o = self.options
        return placement.Geometry(self.length, o.batch_size or 1, o.world_size or 1, o.drop_last, o.exact_count, o.rank is not None)

    @property
    def num_batches(self) -> int:
        if self.batch_sampler is not None:
            return self.batch_sampler.select("batch_id").distinct().count()
        return self.geometry.num_batches

    def plan(self, epoch: int | None = None) -> DataFrame:
        """Positions that are still to be delivered, with their source index."""
        epoch = self.epochs.current if epoch is None else epoch
        if self.batch_sampler is not None:
            rows = placement.with_batch_sampler(self.batch_sampler).select(F.col("coord").alias("pos"), "coord", F.lit(0).cast("long").alias("rank"), "batch_id", "offset", "index")
            return st.open_batches(rows, self.cursor, self.ahead)
        rows = placement.plan(self.spark, self.geometry, self.seed, epoch, self.options.shuffle, self.cursor, self.options.rank)
        if self.sampler is not None:
            picks = self.sampler.select(F.col("pos").alias("index"), F.col("index").alias("_index"))
            rows = rows.join(picks, "index").drop("index").withColumnRenamed("_index", "index")
        return st.open_batches(rows, self.cursor, self.ahead)

    def rows(self, epoch: int | None = None) -> DataFrame:
        return placement.gather(self.plan(epoch), self.source)

    def batches(self, epoch: int | None = None) -> DataFrame:
        """One row for each batch, in batch order for in-order delivery."""
        rows = self.rows(epoch)
        if self.options.batch_size is None:
            out = rows.select("rank", "batch_id", *self.columns)
        elif self.collate_fn is not None:
            out = batch.user_collate(rows, self.collate_fn, self.collate_schema, ["rank", "batch_id"])
        else:
            out = batch.collate(rows, self.columns, ["rank", "batch_id"], strict=self.options.collate == "row")
        return out.orderBy("rank", "batch_id") if self.options.delivery == "in-order" else out

    def __iter__(self) -> Iterator[Row]:
        if self.epochs.turn("start"):
            warnings.warn("the abandoned epoch was advanced; call set_epoch to replay it", stacklevel=2)
        self.check_topology()
        epoch, base = self.epochs.running, self.cursor
        self._delivered = st.Delivered(base, set(self.ahead))
        for row in self.batches(epoch).toLocalIterator(prefetchPartitions=True):
            if "batch_id" in row:
                self._delivered.mark(row["batch_id"])
            self.epochs.turn("deliver", epoch)
            self._seen.delivered(row)
            yield row
        self.epochs.turn("finish", epoch)
        self._seen.seal(epoch)
        self.cursor, self.ahead, self._delivered = 0, set(), None

    def set_epoch(self, epoch: int) -> None:
        self.epochs.hold(epoch)

    def check_topology(self) -> None:
        """Rank and world size are fixed when the stream is made."""
        if (self.options.rank, self.options.world_size) != self._topology:
            raise RuntimeError("rank or world_size changed after the stream was made; make a new one and restore its state")

    def copy(self) -> BatchStream:
        """A stream of the same rows and position whose deliveries don't count here."""
        other = copy.copy(self)
        other.epochs, other.ahead, other._seen = dataclasses.replace(self.epochs), set(self.ahead), stats.Ledger()
        return other

    def stats(self) -> dict:
        """Counters of the running epoch and of the last whole one, and the bytes delivered."""
        return self._seen.report()

    @property
    def contract(self) -> list[tuple[str, object]]:
        """What must hold for a checkpoint to be resumed; neither seed nor cluster is in it."""
        o = self.options
        kind = "batch_sampler" if self.batch_sampler is not None else "sampler" if self.sampler is not None else "permutation" if o.shuffle else "identity"
        return [
            ("contract.version", CONTRACT_VERSION), ("dataset.schema", self.source.schema.jsonValue()), ("dataset.rows", self.source.count()),
            ("sampler", kind), ("placement.B_g", self.geometry.global_batch), ("placement.exact_count", o.exact_count), ("delivery", o.delivery),
            ("drop_last", o.drop_last), ("collate", o.collate if self.collate_fn is None else fp.callable_identity(self.collate_fn)),
        ]

    @property
    def shape(self) -> dict:
        """Batch shape; the per-rank size is left out, as it changes with the world."""
        return batch.batch_shape(self.source.drop("index").schema, self.geometry.global_batch)

    def _sampler_checksum(self, batches: int) -> int:
        """Checksum of the user's indices delivered so far; nothing but it comes to the driver."""
        if self.sampler is not None:
            return st.positions_checksum(self.sampler.where(F.col("pos") < batches * self.geometry.global_batch), ["pos"])
        if self.batch_sampler is not None:
            return st.positions_checksum(self.batch_sampler.where(F.col("batch_id") < batches), ["batch_id", "offset"])
        return 0

    def state_dict(self) -> dict:
        at = self._delivered or st.Delivered(self.cursor, set(self.ahead))
        epoch = self.epochs.current if self.epochs.running is None else self.epochs.running
        return {
            "root_seed": self.seed, "epoch": epoch, "cursor": at.base, "B_g": self.geometry.global_batch,
            "sampler_checksum": self._sampler_checksum(at.base), "delivered_bitmap": at.bitmap().hex(), "fingerprint": fp.document(self.contract),
            "batch_shape": self.shape,
        }

    def load_state_dict(self, state: dict) -> None:
        g, o = self.geometry, self.options
        has_sampler = self.sampler is not None or self.batch_sampler is not None
        ahead = st.check_restore(state, self.contract, g.global_batch, self.shape, self.num_batches, o.delivery == "in-order", has_sampler, g.batch_size, g.world_size)
        if has_sampler and self._sampler_checksum(state["cursor"]) != state["sampler_checksum"]:
            raise ValueError("sampler_checksum does not match the sampler's delivered indices")
        self.seed, self.cursor, self.ahead, self._delivered = state["root_seed"], state["cursor"], ahead, None
        self.epochs.hold(state["epoch"])
        self.epochs.running = None
