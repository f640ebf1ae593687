"""What a stream's counters say about its speed, and what may be advised from them."""

from __future__ import annotations

import time
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import functions as F

from weftline.functions import stats

SIGNALS = ("wait_fraction", "occupancy")


@dataclass(frozen=True)
class Report:
    record: dict
    text: str


def probe(stream, batches: int) -> dict:
    """Deliver a few batches without touching the stream's own state, and time them."""
    copy = stream.copy()
    start, waited, seen = time.monotonic_ns(), 0, 0
    rows = iter(copy)
    for _ in range(batches):
        at = time.monotonic_ns()
        if next(islice(rows, 1), None) is None:
            break
        waited, seen = waited + time.monotonic_ns() - at, seen + 1
    whole = max(time.monotonic_ns() - start, 1)
    return {"batches": seen, "wait_fraction": waited / whole, "elapsed_ns": whole}


def advice(stream, evidence: dict) -> dict:
    """The configuration to keep, with the evidence there is. A gain is told only where a matched
    comparison was made, and a single stream's counters are none."""
    o = stream.options
    return {
        "candidate": {"batch_size": o.batch_size, "delivery": o.delivery, "collate": o.collate, "partitions": int(stream.spark.conf.get("spark.sql.shuffle.partitions"))},
        "evidence": [{"signal": s, "value": evidence.get(s)} for s in SIGNALS],
        "gain_percent": None, "why": "no matched runs of two configurations were observed",
    }


def diagnose(stream, active: bool = False, probe_batches: int = 4) -> Report:
    """Counters, the cause they point to and advice, as a record and as text."""
    found = probe(stream, probe_batches) if active else None
    tracker = stream.spark.sparkContext.statusTracker()
    running, slots = len(tracker.getActiveStageIds()), stream.spark.sparkContext.defaultParallelism
    evidence = {"wait_fraction": None if found is None else found["wait_fraction"], "occupancy": min(1.0, running / max(slots, 1))}
    waits = F.lit(evidence["wait_fraction"] or 0.0)
    cause = stream.spark.range(1).select(stats.attribution(F.lit(None), waits, F.lit(False), F.lit(evidence["occupancy"]))).first()[0]
    record = {"mode": "active" if active else "passive", "probe": found, "counters": stream.stats(), "cause": cause, "advice": advice(stream, evidence)}
    lines = [f"observed: {record['mode']}", f"cause: {cause}", *(f"{k}: {'unknown' if v is None else round(v, 4)}" for k, v in evidence.items()), f"gain: not stated ({record['advice']['why']})"]
    return Report(record, "\n".join(lines))
