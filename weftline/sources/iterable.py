"""Iterable sources as Python data sources: one input partition for each lane, batch and stream.

``make(lane, lanes, rank, world_size)`` returns an iterator of row tuples. A lane's rows get
their arrival number; the stream reader's offset is the number of rows each lane has delivered,
so a restart replays from the checkpoint's offsets, whatever the cluster's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weftline.streaming import lane_state
from weftline.streaming.control import LaneHistory

_MAKERS: dict[str, tuple[Callable, T.StructType]] = {}


class Lane(InputPartition):
    def __init__(self, lane: int, start: int, end: int | None):
        super().__init__((lane, start, end))
        self.lane, self.start, self.end = lane, start, end


class _Options:
    def __init__(self, make: Callable, options: dict, init: Callable | None = None):
        self.make, self.init = make, init
        self.lanes, self.rank, self.world = (int(options.get(k, d)) for k, d in (("lanes", 1), ("rank", 0), ("world_size", 1)))
        self.step = int(options.get("rows_per_trigger", 1000))
        limit = options.get("limit")
        self.limit = None if limit is None else int(limit)
        if self.lanes <= 0 or self.world <= 0 or not 0 <= self.rank < self.world or self.step <= 0:
            raise ValueError("lanes, rank and world_size must describe a topology")

        self.seed, self.resume = int(options.get("seed", 0)), lane_state.starts(options.get("resume"))

    def source(self, lane: int):
        lane_state.init_of(self.init, lane, self.lanes, self.rank, self.world, self.seed)
        return self.make(lane, self.lanes, self.rank, self.world)

    def rows(self, part: Lane) -> Iterator[tuple]:
        """A part's rows; of a resumed lane, arrivals go on from what it had delivered."""
        delivered, snapshot = self.resume.get(part.lane, (0, None))
        start, end = max(part.start, delivered), part.end
        values = lane_state.resumed(self.source(part.lane), start, snapshot)
        for arrival, row in enumerate(islice(values, None if end is None else max(end - start, 0)), start):
            yield (part.lane, arrival, *row)

    def states(self, part: Lane, batch_size: int) -> Iterator[tuple]:
        """``(lane, arrival, payload)`` of a lane's states at every batch boundary."""
        source = self.source(part.lane)
        history = LaneHistory(keep=1 << 30)
        for _ in islice(lane_state.histories(source, batch_size, history), part.end):
            pass
        yield from ((part.lane, a, s) for a, s in zip(history.arrivals, history.states, strict=True))


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self):
        return [Lane(i, 0, self.options.limit) for i in range(self.options.lanes)]

    def read(self, partition):
        return self.options.rows(partition)


class _StateReader(_Reader):
    def __init__(self, options: _Options, batch_size: int):
        super().__init__(options)
        self.batch_size = batch_size

    def read(self, partition):
        return self.options.states(partition, self.batch_size)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options, self.seen = options, 0

    def initialOffset(self) -> dict:
        return {"arrival": 0}

    def latestOffset(self) -> dict:
        """Each call admits ``rows_per_trigger`` more rows of every lane, up to the limit."""
        self.seen += self.options.step
        return {"arrival": self.seen if self.options.limit is None else min(self.seen, self.options.limit)}

    def partitions(self, start: dict, end: dict):
        self.seen = max(self.seen, end["arrival"])
        return [Lane(i, start["arrival"], end["arrival"]) for i in range(self.options.lanes)]

    def read(self, partition):
        return self.options.rows(partition)


def source_class(name: str, make: Callable, schema: str, init: Callable | None = None) -> type[DataSource]:
    """A data source class named ``name`` over ``make``; register it with ``spark.dataSource``.

    ``init`` is called with each lane's description before its source is made. The option
    ``states`` (a batch size) reads a stateful source's states instead of its rows."""
    states = T.StructType.fromDDL("lane long, arrival long, payload binary")
    full = T.StructType([T.StructField("lane", T.LongType()), T.StructField("arrival", T.LongType()), *T.StructType.fromDDL(schema).fields])

    class Iterable(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return states if "states" in self.options else full

        def reader(self, schema):
            own = _Options(make, dict(self.options), init)
            return _StateReader(own, int(self.options["states"])) if "states" in self.options else _Reader(own)

        def streamReader(self, schema):
            return _StreamReader(_Options(make, dict(self.options), init))

    return Iterable


def register(spark: SparkSession, name: str, make: Callable, schema: str, init: Callable | None = None) -> None:
    spark.dataSource.register(source_class(name, make, schema, init))


def read_lanes(spark: SparkSession, name: str, **options) -> DataFrame:
    """All rows of all lanes; every lane must end or have a ``limit``."""
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()


def stream_lanes(spark: SparkSession, name: str, **options) -> DataFrame:
    return spark.readStream.format(name).options(**{k: str(v) for k, v in options.items()}).load()
