"""Checkpoints of iterable streams: one record a lane, restored by replay.

A source is what ``make(lane, lanes, rank, world_size)`` returns: an iterator of row tuples. One
with ``state_dict`` and ``load_state_dict`` is stateful: its states are kept by arrival, and a
lane goes on from the newest at or before its delivered arrival, drawing again only what lies
between. Another source is drawn again from its first row.
"""

from __future__ import annotations

import json
import pickle
import warnings
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lanes import select_snapshot
from weftline.plans import fingerprint as fp
from weftline.streaming.control import LaneHistory

RECORD = "lane long, delivered_arrival long, stateful boolean, snapshot_arrival long, snapshot binary"


def is_stateful(source: object) -> bool:
    return all(callable(getattr(source, n, None)) for n in ("state_dict", "load_state_dict"))


def captured(source: object) -> bytes:
    """A source's state; it must be a dict that pickles."""
    state = source.state_dict()
    if not isinstance(state, dict):
        raise TypeError(f"state_dict() of an iterable source gives a dict, not {type(state).__name__}")
    try:
        return pickle.dumps(state, pickle.HIGHEST_PROTOCOL)
    except Exception as error:
        raise TypeError("the state of an iterable source can't be pickled") from error


def resumed(source: object, delivered: int, snapshot: tuple[int, bytes] | None = None) -> Iterator[tuple]:
    """The rows after ``delivered`` ones, from the snapshot on."""
    at = 0
    if snapshot is not None:
        if not is_stateful(source):
            raise ValueError("a lane's snapshot needs a source with load_state_dict")
        at = snapshot[0]
        source.load_state_dict(pickle.loads(snapshot[1]))
    elif delivered and not is_stateful(source):
        warnings.warn("a source without state is drawn again from its first row", stacklevel=2)
    if at > delivered:
        raise ValueError(f"the snapshot of arrival {at} lies beyond the {delivered} delivered")
    rows = iter(source)
    if sum(1 for _ in islice(rows, delivered - at)) < delivered - at:
        raise RuntimeError("the source ended before the rows that were delivered")
    return rows


def histories(source: object, batch_size: int, history: LaneHistory) -> Iterator[tuple]:
    """A lane's rows, its states kept in ``history`` at batch boundaries."""
    keeps = is_stateful(source)
    if keeps and history.wanted(0, force=True):
        history.add(0, captured(source))
    batches = 0
    for arrival, row in enumerate(source, 1):
        if keeps and not arrival % batch_size:
            batches += 1
            if history.wanted(batches):
                history.add(arrival, captured(source))
        yield row


def records(delivered: DataFrame, snapshots: DataFrame, stateful: bool = True) -> DataFrame:
    """A checkpoint record for each lane of ``delivered(lane, delivered_arrival)``, with the newest
    of ``snapshots(lane, arrival, payload)`` that doesn't lie beyond it."""
    newest = select_snapshot(snapshots, delivered).select("lane", F.col("arrival").alias("snapshot_arrival"), F.col("payload").alias("snapshot"))
    return delivered.join(newest, "lane", "left").select("lane", "delivered_arrival", F.lit(stateful).alias("stateful"), "snapshot_arrival", "snapshot")


def document(lanes: DataFrame, contract: list, root_seed: int, epoch: int, world_size: int, lane_order: list[int]) -> dict:
    """The whole checkpoint; its lanes are as many as the stream has readers."""
    held = [r.asDict() for r in lanes.orderBy("lane").collect()]
    for r in held:
        r["snapshot"] = None if r["snapshot"] is None else bytes(r["snapshot"])
    return {
        "kind": "iterable", "root_seed": root_seed, "epoch": epoch, "world_size": world_size, "lane_count": len(held), "lane_order": list(lane_order),
        "lanes": held, "fingerprint": fp.document(contract),
    }


def check(doc: dict, contract: list, world_size: int, lane_count: int) -> dict[int, dict]:
    """Lane records by lane of a checkpoint that this stream can go on from."""

    def whole(value: object) -> bool:
        return type(value) is int and value >= 0

    if not isinstance(doc, dict) or doc.get("kind") != "iterable":
        raise ValueError("not a checkpoint of an iterable stream")
    lanes, order = doc.get("lanes"), doc.get("lane_order")
    if not isinstance(lanes, list) or not isinstance(order, list):
        raise TypeError("lanes and lane_order of a checkpoint are lists")
    for name in ("root_seed", "epoch", "world_size", "lane_count"):
        if not whole(doc.get(name)):
            raise ValueError(f"the checkpoint's {name} is {doc.get(name)!r}, not a whole number from 0 on")
    if (doc["world_size"], doc["lane_count"]) != (world_size, lane_count):
        raise ValueError(f"lanes can't be dealt anew: {doc['world_size']} ranks of {doc['lane_count']} lanes were saved, this stream has {world_size} of {lane_count}")
    if sorted(r.get("lane", -1) for r in lanes) != list(range(lane_count)):
        raise ValueError("every lane has one record")
    if len(set(order)) < len(order) or not set(order) <= set(range(lane_count)):
        raise ValueError("lane_order names lanes, each once at most")
    for r in lanes:
        place = f"lane {r['lane']}: "
        if not whole(r.get("delivered_arrival")) or type(r.get("stateful")) is not bool:
            raise TypeError(place + "delivered_arrival is a whole number and stateful a boolean")
        at, state = r.get("snapshot_arrival"), r.get("snapshot")
        if (at is None) != (state is None):
            raise ValueError(place + "snapshot and snapshot_arrival go together")
        if state is not None and (not r["stateful"] or not whole(at) or at > r["delivered_arrival"] or not isinstance(state, bytes)):
            raise ValueError(place + "its snapshot is no state of a stateful source at or before what was delivered")
    fp.require_match(fp.parsed(doc["fingerprint"]), contract)
    return {r["lane"]: r for r in lanes}


def option(lanes: dict[int, dict]) -> str:
    """The reader option ``resume`` that starts every lane after what it has delivered."""
    return json.dumps({k: [r["delivered_arrival"], r["snapshot_arrival"], r["snapshot"] and r["snapshot"].hex()] for k, r in lanes.items()})


def starts(text: str | None) -> dict[int, tuple[int, tuple[int, bytes] | None]]:
    return {int(k): (d, None if at is None else (at, bytes.fromhex(s))) for k, (d, at, s) in json.loads(text or "{}").items()}


def init_of(init: Callable | None, lane: int, lanes: int, rank: int, world: int, seed: int) -> None:
    """Call a lane's hook with what it may know of itself, before its source is made."""
    if init is not None:
        init({"lane": lane, "lanes": lanes, "rank": rank, "world_size": world, "seed": seed + lane})
